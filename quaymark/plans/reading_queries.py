"""Driver queries over readings: owners, codes, numbers, check digits, gates and whole strategies, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import codes
from quaymark.operators import boxes, ranking, routing, tokens, voting
from quaymark.plans import recognition
from quaymark.plans.code_queries import _CANDIDATES, _CHECK, _CLEAN, _DIGIT, _LETTER, _OWNER, _READINGS, _readings

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digits(n: Column, size: int) -> Column:
    return F.lpad((n % 10**size).cast("string"), size, "0")


# Two tokens for each part: letters of its name, and digits.

_TWO = """p as (select p_partkey as k, upper(substr(replace(p_name, ' ', ''), 1, 3 + cast(p_partkey % 3 as int))) as t0, (p_partkey % 64) / 64.0::double as s0,
  substr(lpad(cast(p_partkey * 7919 % 10000019 % 10000000 as varchar), 7, '0'), 1, 5 + cast(p_partkey % 3 as int)) as t1, (p_partkey * 7 % 64) / 64.0::double as s1 from part),
g as (select k, 0 as grp, t0 as raw, s0 as score from p union all select k, 1, t1, s1 from p union all select k, 2, t0 || t1, (s0 + s1) / 2 from p union all select k, 3, t0 || ' ' || t1, (s0 + s1) / 2 from p)"""


def _two(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    t0 = F.upper(F.substr(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(1), (3 + k % 3).cast("int")))
    t1 = F.substr(_digits(k * 7919 % 10000019, 7), F.lit(1), (5 + k % 3).cast("int"))
    both = F.array(F.struct(t0.alias("text"), (k % 64 / 64.0).alias("score")), F.struct(t1.alias("text"), (k * 7 % 64 / 64.0).alias("score")))
    return part.select(k.alias("k"), F.posexplode(both).alias("ord", "t")).select("k", "ord", "t.text", "t.score")


_LETTERS_OF = f"regexp_replace({_LETTER.format(_CLEAN.format('raw'))}, '[^A-Z]', '', 'g')"
_OWNERS = f"""l as (select *, {_LETTERS_OF} as s, length({_CLEAN.format('raw')}) as n from g),
c as (select k, grp, raw, score, n, 0 as cand, s as w, 0.12::double as bonus from l where length(s) = 4 union all
  select k, grp, raw, score, n, 1 + i, substr(s, 1, cast(i as int)) || substr(s, cast(i as int) + 2), 0.07::double from l, unnest(range(5)) t(i) where length(s) = 5 union all
  select k, grp, raw, score, n, 10 + i, substr(s, cast(i as int), 4), 0.03::double from l, unnest(range(1, length(s) - 2)) t(i))"""


@query(f"""with {_TWO}, {_OWNERS}, f as (select k, grp, cand, raw, substr(w, 1, 3) || 'U' as code, score + bonus + case when n = 4 then 0.03::double else 0 end as final from c),
r as (select *, row_number() over (partition by k order by final desc, grp, cand) as i from f) select k, code, round(final, 9) as final, raw from r where i = 1""")
def best_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.best_owner(_two(_t(spark, sf_dir, "part")), ["k"]).select("k", "code", F.round("final", 9).alias("final"), "raw")


@query(f"""with {_TWO}, {_OWNERS}, f as (select k, grp, substr(w, 1, 3) || 'U' as code, bonus, cand from c),
u as (select k, grp, code, arg_min(bonus, cand) as bonus, min(cand) as cand from f group by 1, 2, 3)
select k, grp, code, bonus, cast(row_number() over (partition by k, grp order by cand) - 1 as int) as place from u""")
def owner_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = tokens.collected(_two(_t(spark, sf_dir, "part")), ["k"]).select("k", F.posexplode(tokens.candidate_groups("pairs")).alias("grp", "g"))
    return groups.select("k", "grp", F.posexplode(codes.owner_candidates("g.raw")).alias("place", "c")).select("k", "grp", "c.code", "c.bonus", "place")


_CODE = """p as (select p_partkey as k, ['TCKU', 'MSKU', 'CSQU', 'TGH0'][p_partkey % 4 + 1] as t0, (p_partkey % 64) / 64.0::double as s0, lpad(cast(p_partkey * 7919 % 10000000 as varchar), 7, '0') as t1, (p_partkey * 7 % 64) / 64.0::double as s1 from part),
w as (select *, substr(t0, 1, 3) || 'U' || t1 as code from p)"""


def _code_tokens(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    t0 = F.element_at(F.array(*map(F.lit, ("TCKU", "MSKU", "CSQU", "TGH0"))), (k % 4 + 1).cast("int"))
    both = F.array(F.struct(t0.alias("text"), (k % 64 / 64.0).alias("score")), F.struct(_digits(k * 7919, 7).alias("text"), (k * 7 % 64 / 64.0).alias("score")))
    return part.select(k.alias("k"), F.posexplode(both).alias("ord", "t")).select("k", "ord", "t.text", "t.score")


_VALID = f"cast({_CHECK.format(b='substr(code, 1, 10)')} as varchar) = substr(code, 11, 1)"


@query(f"""with {_CODE}, v as (select *, {_VALID} as valid from w)
select k, code, round(0.75::double * ((s0 + s1) / 2) + 0.25::double * case when valid then 1.0::double else 0.95::double end + case when valid then 0.1::double else 0 end, 9) as final, t0 || t1 as raw from v""")
def best_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.best_code(_code_tokens(_t(spark, sf_dir, "part")), ["k"]).select("k", "code", F.round("final", 9).alias("final"), "raw")


@query(f"""with {_CODE} select k, code, round(case when {_VALID} then 1.0::double else 0.95::double end, 9) as quality, 0.0::double as no_quality, 1.0::double as base_quality from w""")
def code_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.best_code(_code_tokens(_t(spark, sf_dir, "part")), ["k"])
    return rows.select("k", "code", F.round(codes.code_quality("code"), 9).alias("quality"), codes.code_quality(F.substring("code", 1, 10)).alias("no_quality"), codes.base_quality(F.substring("code", 1, 10)).alias("base_quality"))


@query("""
with d as (select user_id, event_id, lpad(cast(event_id * 31 % 100 as varchar), 2, '0') as t, (event_id % 64) / 64.0::double as score from events),
m as (select *, translate(t, '012345678', 'OIZBASGZB') as m from d), n as (select *, length(regexp_replace(m, '[^A-Z]', '', 'g')) as many from m),
l as (select user_id, event_id, i, substr(m, cast(i as int) + 1, 1) as letter, score + case when many = 1 then 0.12::double else -0.03::double * (many - 1) end + 0.05::double + 0.02::double as final from n, unnest(range(2)) t(i) where substr(m, cast(i as int) + 1, 1) between 'A' and 'Z'),
w as (select *, row_number() over (partition by user_id order by final desc, event_id, i) as k from l) select user_id, letter, round(final, 9) as final from w where k = 1""")
def best_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), F.lpad((F.col("event_id") * 31 % 100).cast("string"), 2, "0").alias("text"), ((F.col("event_id") % 64) / 64.0).alias("score"))
    return tokens.best_letter(rows, ["user_id"]).select("user_id", "letter", F.round("final", 9).alias("final"))


@query(f"""with {_READINGS}, f as (select *, score + case when length(text) >= 7 then 0.18::double else 0.08::double end as final from r where length(text) >= 6),
w as (select *, row_number() over (partition by user_id order by final desc, ord) as k from f) select user_id, substr(text, 1, 6) as base6, substr(text, 7, 1) as check_digit, round(final, 9) as final, text as raw from w where k = 1""")
def best_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.best_number(_readings(_t(spark, sf_dir, "events")), ["user_id"]).select("user_id", "base6", "check_digit", F.round("final", 9).alias("final"), "raw")


@query("""
with d as (select o_custkey as k, o_orderkey as ord, case when o_orderkey % 41 = 0 then '' else cast(o_orderkey % 10 as varchar) end as digit, (o_orderkey % 16) / 16.0::double - 0.25::double as score from orders)
select k, case when count(*) filter (digit = '') > 0 then '' else string_agg(digit, '' order by ord) end as text, round(case when count(*) filter (digit = '') > 0 then -1.0::double else avg(greatest(score, 0)) end, 9) as score from d group by k""")
def mean_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), o.alias("ord"), F.when(o % 41 == 0, "").otherwise((o % 10).cast("string")).alias("digit"), (o % 16 / 16.0 - 0.25).alias("score"))
    return tokens.mean_sequence(rows, ["k"]).select("k", "text", F.round("score", 9).alias("score"))


@query(f"""with {_TWO}, x as (select *, regexp_extract_all({_DIGIT.format(_CLEAN.format('raw'))}, '[0-9]+') as runs from g),
r as (select k, grp, raw, score, cast(i - 1 as int) as i, runs[cast(i as int)] as run from x, unnest(range(1, len(runs) + 1)) t(i)),
c as (select *, substr(run, 1, 5) as chunk, round_even(score * 1000, 0) as th from r where length(run) >= 4), w as (select *, row_number() over (partition by k, chunk, th order by grp, i) as n from c)
select k, cast(grp as int) as grp, i, chunk, round(score, 9) as score, raw from w where n = 1""")
def digit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.digit_chunks(_two(_t(spark, sf_dir, "part")), ["k"], 4, 5)
    return rows.select("k", "ord.grp", "ord.i", "chunk", F.round("score", 9).alias("score"), "raw")


_MIXED = """m as (select p_partkey as k, case p_partkey % 3 when 0 then t0 || '-' || t1 when 1 then t1 || t0 else 'X9' || t0 || '7' || t1 end as raw from (
  select p_partkey, ['TCKU', 'MSK0', 'CSQUX', 'T6HU'][p_partkey % 4 + 1] as t0, lpad(cast(p_partkey * 7919 % 1000000 as varchar), 6, '0') as t1 from part))"""


@query(f"""with {_MIXED}, s as (select k, {_CLEAN.format('raw')} as s from m), x as (select * from s where length(s) >= 10),
c as (select k, 0 as kind, i, 0 as j, substr(s, cast(i as int), 10) as w from x, unnest(range(1, length(s) - 8)) t(i) union all
  select k, 1, i, 0, substr(b, 7) || substr(b, 1, 6) from (select k, i, r[cast(i as int)] as b from (select k, regexp_extract_all(s, '[0-9]{{6}}[A-Z]{{4}}') as r from x), unnest(range(1, len(r) + 1)) t(i)) union all
  select k, 2, i, j, substr(l[cast(i as int)], 1, 4) || substr(d[cast(j as int)], 1, 6) from (select k, regexp_extract_all(s, '[A-Z]{{4,}}') as l, regexp_extract_all(s, '[0-9]{{6,}}') as d from x), unnest(range(1, len(l) + 1)) t(i), unnest(range(1, len(d) + 1)) u(j)),
o as (select k, kind, i, j, ({_OWNER.format(x='substr(w, 1, 4)')}) || {_DIGIT.format('substr(w, 5)')} as code from c),
f as (select k, code, min(kind * 1000000 + i * 1000 + j) as spot from o where regexp_full_match(code, '[A-Z]{{4}}[0-9]{{6}}') group by 1, 2)
select k, code, cast(row_number() over (partition by k order by spot) as int) as place from f""")
def base_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    t0, t1 = F.element_at(F.array(*map(F.lit, ("TCKU", "MSK0", "CSQUX", "T6HU"))), (k % 4 + 1).cast("int")), _digits(k * 7919, 6)
    raw = F.when(k % 3 == 0, F.concat(t0, F.lit("-"), t1)).when(k % 3 == 1, F.concat(t1, t0)).otherwise(F.concat(F.lit("X9"), t0, F.lit("7"), t1))
    return _t(spark, sf_dir, "part").select(k.alias("k"), F.posexplode(codes.base_windows(raw)).alias("i", "code")).select("k", "code", (F.col("i") + 1).alias("place"))


# Numbers and their check digits.

#: Candidates with their source and place `o` in the order in which they arise.
_ORDERED = f"""{_READINGS}, chk as (select user_id, ord, 0 as j, text as digit, score + 0.03::double as s from r where length(text) = 1 union all
  select user_id, ord, 0, substr(text, 1, 1), score - 0.05::double from r where length(text) = 2 union all select user_id, ord, 1, substr(text, 2, 1), score - 0.03::double from r where length(text) = 2),
al as (select user_id, 0 as kind, ord as a, 0 as c, 0 as e, text as base6, '' as check_digit, score + 0.04::double as score, false as direct, 'base6' as source, text as raw from r where length(text) = 6 union all
  select user_id, 0, ord, 0, 0, substr(text, 1, 6), substr(text, 7, 1), score + 0.14::double, true, 'direct7', text from r where length(text) = 7 union all
  select x.user_id, 1, x.ord, y.ord, y.j, x.text, y.digit, 0.82::double * x.score + 0.18::double * greatest(y.s, 0) + 0.05::double + case when y.ord > x.ord then 0.02::double else 0 end, false, 'combo', x.text || y.digit from r x join chk y on x.user_id = y.user_id where length(x.text) = 6),
cand as (select *, row_number() over (partition by user_id order by kind, a, c, e) as o from al),
bv as (select user_id, base6, sum(score) as vote, min(o) as f from cand group by 1, 2), bw as (select *, row_number() over (partition by user_id order by vote desc, f) as n from bv), base as (select user_id, base6, vote from bw where n = 1)"""


@query(f"""with {_ORDERED}, dv as (select user_id, check_digit, sum(score + case when direct then 0.1::double else 0 end) as vote, min(o) as f from cand join base using (user_id, base6) where check_digit <> '' group by 1, 2),
dw as (select *, row_number() over w as n, lead(vote) over w as nxt, count(*) over (partition by user_id) as many from dv window w as (partition by user_id order by vote desc, f)), d as (select * from dw where n = 1),
dir as (select user_id, bool_or(direct and check_digit <> '') as has_direct_full from cand group by 1)
select b.user_id, b.base6, coalesce(d.check_digit, '') as check_digit, round(coalesce(d.vote, b.vote), 9) as score, dir.has_direct_full, coalesce(d.many, 0) as check_vote_count, round(coalesce(d.vote - coalesce(d.nxt, 0), 0), 9) as check_margin
from base b join dir using (user_id) left join d on d.user_id = b.user_id""")
def pick_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = voting.pick_number(voting.numeric_candidates(_readings(_t(spark, sf_dir, "events")), ["user_id"]), ["user_id"])
    return found.select("user_id", "base6", "check_digit", F.round("score", 9).alias("score"), "has_direct_full", "check_vote_count", F.round("check_margin", 9).alias("check_margin"))


_SIDE = """sv as (select user_id, event_id as ord, cast(event_id % 10 as varchar) as digit, (event_id % 32) / 32.0::double as score, case event_id % 3 when 0 then 'square' when 1 then 'square_inner' else 'zone' end as source from events)"""


def _side(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    source = F.when(i % 3 == 0, "square").when(i % 3 == 1, "square_inner").otherwise("zone")
    return events.select("user_id", i.alias("ord"), (i % 10).cast("string").alias("digit"), (i % 32 / 32.0).alias("score"), source.alias("source"))


@query(f"""with {_ORDERED}, {_SIDE}, own as (select c.*, case source when 'direct7' then score + 0.34::double when 'combo' then greatest(0, score * 0.74::double) else greatest(0, score * 0.66::double) end as weight from cand c join base using (user_id, base6) where check_digit <> ''),
seen as (select user_id, check_digit as digit, bool_or(source = 'direct7') as dir from own group by 1, 2), have as (select distinct user_id from own),
side as (select sv.user_id, sv.digit, sv.ord, case when sv.source like 'square%' then score + 0.18::double else greatest(0, score - 0.12::double) end + case when seen.dir then 0.08::double else 0 end as weight, sv.source like 'square%' as square
  from sv join base using (user_id) left join seen on seen.user_id = sv.user_id and seen.digit = sv.digit where seen.digit is not null or sv.user_id not in (select user_id from have)),
ev as (select user_id, check_digit as digit, weight, 0 as kind, o as spot, source = 'direct7' as dir, false as square from own union all select user_id, digit, weight, 1, ord, false, square from side),
t as (select user_id, digit, sum(weight) as vote, min(kind * 1000000000 + spot) as f from ev group by 1, 2), w as (select *, row_number() over x as n, lead(vote) over x as nxt, count(*) over (partition by user_id) as many from t window x as (partition by user_id order by vote desc, f)),
cnt as (select user_id, count(*) filter (dir) as direct_count, count(*) filter (square) as square_count from ev group by 1)
select b.user_id, coalesce(w.digit, '') as check_digit, round(coalesce(w.vote, -1), 9) as score, coalesce(w.many, 0) as vote_count, round(coalesce(w.vote - coalesce(w.nxt, 0), 0), 9) as margin, coalesce(direct_count, 0) as direct_count, coalesce(square_count, 0) as square_count
from base b left join (select * from w where n = 1) w on w.user_id = b.user_id left join cnt on cnt.user_id = b.user_id""")
def resolve_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    candidates = voting.numeric_candidates(_readings(events), ["user_id"])
    found = voting.resolve_check_digit(voting.pick_number(candidates, ["user_id"]), candidates, _side(events), ["user_id"])
    return found.select("user_id", "check_digit", F.round("score", 9).alias("score"), "vote_count", F.round("margin", 9).alias("margin"), "direct_count", "square_count")


@query(f"""with {_SIDE}, t as (select user_id, digit, sum(case when source like 'square%' then score + 0.08::double else greatest(0, score - 0.12::double) end) as vote, min(ord) as f from sv group by 1, 2),
w as (select *, row_number() over (partition by user_id order by vote desc, f) as n from t) select user_id, digit, round(vote, 9) as vote from w where n = 1""")
def right_check_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.right_check_vote(_side(_t(spark, sf_dir, "events")), ["user_id"]).select("user_id", "digit", F.round("vote", 9).alias("vote"))


_SQUARES = """q as (select distinct l_orderkey as k, l_linenumber as n from lineitem), sq as (select k, (n - 1) % 3 as zone_ord, (n - 1) // 3 + 1 as rank, case when n % 4 = 0 then '' else cast(n as varchar) end as digit, n / 8.0::double as score, cast(n % 2 as varchar) as inner_digit, n / 16.0::double as inner_score from q),
z as (select o_orderkey as k, 0 as zone_ord, cast(o_custkey % 10 as varchar) as digit, (o_custkey % 8) / 8.0::double as score from orders),
v as (select k, zone_ord, rank, 0 as part, digit, score, 'square' as source from sq where rank <= 2 union all select k, zone_ord, rank, 1, inner_digit, inner_score, 'square_inner' from sq where rank <= 2 union all select k, zone_ord, 9, 2, digit, score, 'zone' from z)"""


@query(f"with {_SQUARES} select k, cast(row_number() over (partition by k order by zone_ord, rank, part) - 1 as int) as ord, digit, score, source from v where digit <> ''")
def check_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    squares = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber").distinct().select(
        "k", ((n - 1) % 3).alias("zone_ord"), F.lit("z").alias("zone"), (F.floor((n - 1) / 3) + 1).cast("int").alias("rank"), F.when(n % 4 == 0, "").otherwise(n.cast("string")).alias("digit"), (n / 8.0).alias("score"), (n % 2).cast("string").alias("inner_digit"), (n / 16.0).alias("inner_score"),
    )
    c = F.col("o_custkey")
    zones = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("zone_ord"), F.lit("z").alias("zone"), (c % 10).cast("string").alias("digit"), (c % 8 / 8.0).alias("score"))
    return boxes.check_votes(squares, zones, ["k"]).select("k", "ord", "digit", "score", "source")


@query("""with x as (select o_orderkey, o_custkey % 7 <> 0 as b, o_custkey % 3 <> 0 as c, o_orderkey % 4 = 0 as d, o_orderkey % 3 as n, (o_orderkey % 128) / 64.0::double as m from orders)
select o_orderkey, not b or (not c and n > 0) or (c and not d and m < 1.02) as resize, not b or not c or (not d and n > 1 and m < 0.90) as hard, b and (not c or (not d and (n <= 0 or m < 1.00))) as square from x""")
def reading_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    state = (F.when(c % 7 == 0, "").otherwise("123456"), F.when(c % 3 == 0, "").otherwise("9"), o % 4 == 0, o % 3, o % 128 / 64.0)
    return _t(spark, sf_dir, "orders").select("o_orderkey", recognition.needs_resize(*state).alias("resize"), recognition.needs_hard(*state).alias("hard"), recognition.needs_square(*state).alias("square"))


# Whole strategies.


@query("""with x as (select o_orderkey, ['oneline', 'twolines', 'vertical', 'unknown'][o_orderkey % 4 + 1] as l, o_custkey % 3 = 0 as h, o_custkey % 5 = 0 as v, o_custkey % 2 = 0 as b, o_custkey % 7 < 3 as r from orders)
select o_orderkey, case when (l = 'oneline' or h) and b then 'oneline' when l = 'twolines' and (b or r) then 'twolines' when (l = 'vertical' or v) and (b or (r and not (l = 'oneline' or h))) then 'vertical' else 'generic' end as strategy from x""")
def strategy_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    layout = F.element_at(F.array(*map(F.lit, ("oneline", "twolines", "vertical", "unknown"))), (o % 4 + 1).cast("int"))
    result = lambda name: F.struct(F.when(c % 2 == 0, "TCKU123456").otherwise("").alias("base10"), F.when(c % 7 < 3, "text").otherwise("").alias("raw_text"), F.lit(name).alias("strategy"))
    found = routing.route(layout, c % 3 == 0, c % 5 == 0, *map(result, ("oneline", "twolines", "vertical", "generic")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", found["strategy"].alias("strategy"))


@query("select o_orderkey, o_custkey % 2 = 0 and o_custkey % 3 = 0 as retry from orders")
def retry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", routing.needs_retry(F.when(c % 2 != 0, "TCKU123456"), F.when(c % 3 == 0, F.concat(F.lit(" "), _digits(c, 6), F.lit("-"))).otherwise("12345 X")).alias("retry"))


_SHAPES = f"""x as (select o_orderkey, case when o_custkey % 3 = 0 then '' else ['TCKU', 'MSKU'][o_orderkey % 2 + 1] || lpad(cast(o_orderkey % 1000000 as varchar), 6, '0') end as b, case when o_custkey % 3 = 0 or o_custkey % 2 = 0 then '' else cast(o_custkey % 10 as varchar) end as d, case when o_custkey % 5 = 0 then '' else 'RAW' end as r from orders),
y as (select *, b || d as code from x), z as (select *, case when length(code) >= 10 then code else '' end as full_code, case length(code) when 11 then 'FULL_11' when 10 then 'PARTIAL_10' else case when r <> '' then 'RAW_ONLY' else 'NOT_FOUND' end end as status from y)"""


@query(f"""with {_SHAPES} select o_orderkey, full_code, status, case when full_code <> '' then 'ok' else lower(status) end as reason, coalesce(length(code) = 11 and {_VALID}, false) as is_valid_iso,
case when status in ('FULL_11', 'PARTIAL_10') then full_code when r <> '' then r else 'NOT_FOUND' end as result from z""")
def result_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    owner = F.when(o % 2 == 0, "TCKU").otherwise("MSKU")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(c % 3 == 0, "").otherwise(F.concat(owner, _digits(o, 6))).alias("base10"), F.when((c % 3 == 0) | (c % 2 == 0), "").otherwise((c % 10).cast("string")).alias("check_digit"), F.when(c % 5 == 0, "").otherwise("RAW").alias("raw_text"), F.lit(0.5).alias("score"))
    return routing.shape_crop(rows, accept_other=True).select("o_orderkey", "full_code", "status", "reason", "is_valid_iso", "result")


_ONE_LINE = """p as (select p_partkey as k, ['TCKU', 'MSKU', 'CSQU', 'TGHU'][p_partkey % 4 + 1] as t0, lpad(cast(p_partkey * 7919 % 10000000 as varchar), 7, '0') as t1, (p_partkey % 64) / 64.0::double as s0, (p_partkey * 7 % 64) / 64.0::double as s1, (p_partkey * 5 % 64) / 64.0::double as s2 from part)"""


@query(f"""with {_ONE_LINE}, x as (select *, k % 7 = 3 as short, case when k % 7 <> 3 then substr(t1, 7, 1) when k % 3 = 0 then '1' else '' end as d from p)
select k, t0 || substr(t1, 1, 6) || d as full_code, case when d = '' then 'PARTIAL_10' else 'FULL_11' end as status, cast({_CHECK.format(b="t0 || substr(t1, 1, 6)")} as varchar) = d as is_valid_iso,
round(s0 + case when k % 5 = 0 then 0.25::double else 0 end + 0.15::double + case when short then greatest(s1 + s2 + 0.09::double, case when k % 3 = 0 then 1.08::double else 0 end) when k % 2 = 0 then s1 + 0.24::double else s2 + 0.25::double end, 9) as score,
t0 || ' ' || case when short or (k % 2 = 1 and s1 + 0.04::double >= s2 + 0.15::double) then substr(t1, 1, 6) else t1 end as raw_text from x""")
def one_line_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _t(spark, sf_dir, "part").select(k.alias("k"), F.element_at(F.array(*map(F.lit, ("TCKU", "MSKU", "CSQU", "TGHU"))), (k % 4 + 1).cast("int")).alias("t0"), _digits(k * 7919, 7).alias("t1"), (k % 64 / 64.0).alias("s0"), (k * 7 % 64 / 64.0).alias("s1"), (k * 5 % 64 / 64.0).alias("s2"))
    owner = rows.select("k", F.lit(0).alias("phase"), F.lit(0.0).alias("bonus"), F.lit(0).alias("ord"), F.col("t0").alias("text"), F.col("s0").alias("score"))
    owner = owner.unionByName(rows.where("k % 5 = 0").select("k", F.lit(1).alias("phase"), F.lit(0.0).alias("bonus"), F.lit(0).alias("ord"), F.col("t0").alias("text"), (F.col("s0") + 0.25).alias("score")))
    zone, short = [F.lit(0).alias("zone"), F.lit(0.3).alias("zone_x"), F.lit(0).alias("ord")], F.col("k") % 7 == 3
    fast = rows.select("k", F.lit(0).alias("phase"), *zone, F.lit(0.0).alias("bonus"), F.when((F.col("k") % 2 == 0) & ~short, F.col("t1")).otherwise(F.substring("t1", 1, 6)).alias("text"), F.col("s1").alias("score"))
    hard = rows.select("k", F.lit(2).alias("phase"), *zone, F.lit(0.01).alias("bonus"), F.when(short, F.substring("t1", 1, 6)).otherwise(F.col("t1")).alias("text"), F.col("s2").alias("score"))
    votes = rows.where("k % 3 = 0").select("k", F.lit(0).alias("ord"), F.lit("1").alias("digit"), F.lit(0.9).alias("score"), F.lit("square").alias("source"))
    votes = votes.unionByName(rows.select("k", F.lit(1).alias("ord"), F.lit("8").alias("digit"), F.lit(1.0).alias("score"), F.lit("zone").alias("source")))  # not asked in one line
    found = recognition.code_of_regions(owner, fast.unionByName(hard), votes, ["k"])
    return found.select("k", "full_code", "status", "is_valid_iso", F.round("score", 9).alias("score"), "raw_text")


@query(f"""with {_ONE_LINE}, x as (select *, substr(t1, 1, cast(5 + k % 3 as int)) as d, (s0 + s1) / 2 as m, cast({_CHECK.format(b="t0 || substr(t1, 1, 6)")} as varchar) = substr(t1, 7, 1) as valid from p),
y as (select *, case length(d) when 7 then 0.8::double * m + 0.2::double * case when valid then 1.0::double else 0.95::double end when 6 then 0.8::double * m + 0.2::double - 0.02::double else 0.5::double * greatest(s0, s1) end as f0, 0.5::double * s2 as f1 from x),
z as (select *, length(d) >= 6 and f0 >= f1 as has, k % 4 = 0 as v, s1 + 0.08::double as vote from y)
select k, case when has then t0 || case when v then substr(d, 1, 6) || '7' else d end else '' end as full_code, round(case when has and v then greatest(f0, vote) else greatest(f0, f1) end, 9) as score, has and length(d) = 7 and valid as is_valid_iso, case when f0 >= f1 then t0 || ' ' || d else 'HELLO' end as raw_text from z""")
def generic_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    t0, t1 = F.element_at(F.array(*map(F.lit, ("TCKU", "MSKU", "CSQU", "TGHU"))), (k % 4 + 1).cast("int")), F.substr(_digits(k * 7919, 7), F.lit(1), (5 + k % 3).cast("int"))
    item = lambda v, o, text, score: F.struct(F.lit(v).alias("variant"), F.lit(o).alias("ord"), text.alias("text"), score.alias("score"))
    every = F.array(item(0, 0, t0, k % 64 / 64.0), item(0, 1, t1, k * 7 % 64 / 64.0), item(1, 0, F.lit("HELLO"), k * 5 % 64 / 64.0))
    rows = _t(spark, sf_dir, "part").select(k.alias("k"), F.explode(every).alias("t")).select("k", "t.*")
    votes = _t(spark, sf_dir, "part").where(k % 4 == 0).select(k.alias("k"), F.lit(0).alias("ord"), F.lit("7").alias("digit"), (k * 7 % 64 / 64.0).alias("score"), F.lit("square").alias("source"))
    found = recognition.code_of_any(rows, ["k"], votes)
    return found.select("k", "full_code", F.round("score", 9).alias("score"), "is_valid_iso", "raw_text")


@query("""
with a as (select user_id, event_id, cast(event_id % 3 as int) as stage, 'AB' || lpad(cast(event_id % 1000000 as varchar), 6, '0') as text, 0.8::double * ((event_id * 13 % 64) / 64.0::double) + 0.2::double * (0.45::double * 0.8::double + 0.35::double + 0.2::double) as score from events),
f as (select *, max(score) over (partition by user_id order by stage, event_id rows between unbounded preceding and 1 preceding) as so_far, max(score) over (partition by user_id order by stage range between unbounded preceding and 1 preceding) as stages from a),
l as (select * from f where coalesce(so_far, -1) < 0.93 and (stage = 0 or coalesce(stages, -1) < [0.83, 0.70][stage])), r as (select *, row_number() over (partition by user_id order by score desc, stage, event_id) as k from l)
select user_id, text, round(score, 9) as score from r where k = 1""")
def seal_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = _t(spark, sf_dir, "events").select("user_id", (i % 3).cast("int").alias("stage"), i.alias("angle"), F.lit(0).alias("ord"), F.concat(F.lit("AB"), _digits(i, 6)).alias("text"), (i * 13 % 64 / 64.0).alias("score"))
    return recognition.seal_of(rows, ["user_id"]).select("user_id", "text", F.round("score", 9).alias("score"))


@query("""with e as (select user_id, event_type, event_id from events), r as (select *, row_number() over (partition by user_id, event_type order by event_id) as n from e) select user_id, event_type, event_id from r where n = 1""")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.distinct_in_order(_t(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")
