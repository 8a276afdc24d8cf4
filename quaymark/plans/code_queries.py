"""Driver queries over codes, tokens and votes, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import codes, text
from quaymark.operators import ranking, tokens, voting

QUERIES, SQL = {}, {}
_LETTER, _DIGIT = "translate({}, '012345678', 'OIZBASGZB')", "translate({}, 'OQDUILZSBG', '0000112586')"
_CLEAN = "regexp_replace(upper({}), '[^A-Z0-9]+', '', 'g')"
#: The check digit of a ten-character code `b`.
_CHECK = "(list_sum(list_transform(range(10), lambda i: (strpos('0123456789A?BCDEFGHIJK?LMNOPQRSTU?VWXYZ', substr({b}, i + 1, 1)) - 1) * cast(pow(2, i) as int))) % 11 % 10)"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(*owners: str) -> Column:
    return F.element_at(F.array(*map(F.lit, owners)), (F.col("o_custkey") % len(owners) + 1).cast("int"))


@query(f"select o_orderkey, b as base10, cast({_CHECK.format(b='b')} as int) as check_digit from (select o_orderkey, ['CSQU', 'TCKU', 'MSKU', 'ABZJ'][o_custkey % 4 + 1] || lpad(cast(o_orderkey % 1000000 as varchar), 6, '0') as b from orders)")
def check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(_of("CSQU", "TCKU", "MSKU", "ABZJ"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", base.alias("base10")).withColumn("check_digit", codes.check_digit("base10"))


@query(f"select o_orderkey, b || d as code, cast({_CHECK.format(b='b')} as varchar) = d as valid from (select o_orderkey, ['TGHU', 'CSQU', 'WXYU', 'KLMU'][o_custkey % 4 + 1] || lpad(cast(o_orderkey % 1000000 as varchar), 6, '0') as b, cast(o_custkey % 10 as varchar) as d from orders)")
def valid_code_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(_of("TGHU", "CSQU", "WXYU", "KLMU"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), (F.col("o_custkey") % 10).cast("string"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"), codes.is_valid(code).alias("valid"))


_OWNER = f"case when length({_LETTER.format('{x}')}) >= 4 then substr({_LETTER.format('{x}')}, 1, 3) || 'U' else {_LETTER.format('{x}')} end"


@query(f"""
with t as (select c_name as name from customer union all select p_name from part), c as (select name, {_CLEAN.format('name')} as s from t)
select name, s as cleaned, {_OWNER.format(x='s')} as owner, {_DIGIT.format('s')} as digits from c""")
def owner_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).union(_t(spark, sf_dir, "part").select("p_name"))
    return names.select("name", text.clean("name").alias("cleaned"), codes.owner(F.col("name")).alias("owner"), codes.as_digits(text.clean("name")).alias("digits"))


_NOISY = "concat(chr(cast(65 + o_custkey % 26 as int)), 'TCK', case when o_orderkey % 2 = 0 then 'U' else '0' end, lpad(cast(o_orderkey % 1000000 as varchar), 6, '0'), 'O', cast(o_custkey % 7 as varchar))"


def _noisy(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", F.expr("concat(chr(65 + o_custkey % 26), 'TCK', case when o_orderkey % 2 = 0 then 'U' else '0' end, lpad(cast(o_orderkey % 1000000 as string), 6, '0'), 'O', cast(o_custkey % 7 as string))").alias("raw"))


def _window_sql(size: int, digits: int) -> str:
    """All windows of one size, as codes, distinct in order."""
    owner, digit = _OWNER.format(x="substr(w, 1, 4)"), _DIGIT.format("substr(w, 5)")
    return f"""
with n as (select o_orderkey, {_NOISY} as raw from orders), s as (select *, {_CLEAN.format('raw')} as s from n),
w as (select o_orderkey, i, substr(s, cast(i as int), {size}) as w from s, unnest(range(1, length(s) - {size - 2})) t(i)),
c as (select o_orderkey, i, ({owner}) || {digit} as code from w)
select o_orderkey, code, cast(row_number() over (partition by o_orderkey order by i) as int) as place from (
  select o_orderkey, code, min(i) as i from c where regexp_full_match(code, '[A-Z]{{4}}[0-9]{{{digits}}}') group by o_orderkey, code)"""


@query(_window_sql(11, 7))
def code_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _noisy(_t(spark, sf_dir, "orders")).select("o_orderkey", F.posexplode(codes.code_windows("raw")).alias("i", "code"))
    return rows.select("o_orderkey", "code", (F.col("i") + 1).alias("place"))


@query("""
with n as (select c_custkey, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || cast(cast(floor(c_acctbal) as bigint) % 97 as varchar) as raw from customer)
select c_custkey, cast(i - 1 as int) as i, r[cast(i as int)] as run from (select c_custkey, regexp_extract_all(translate(regexp_replace(raw, '[^A-Z0-9]+', '', 'g'), 'OQDUILZSBG', '0000112586'), '[0-9]+') as r from n) q, unnest(range(1, len(r) + 1)) t(i) where length(r[cast(i as int)]) >= 6""")
def digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.upper(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), (F.floor("c_acctbal") % 97).cast("string"))
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.posexplode(codes.digit_runs(raw)).alias("i", "run"))
    return rows.where(F.length("run") >= 6)


@query("""
with t as (select conv_id, row_number() over (partition by conv_id order by turn) as ord, upper(role) || length(text) as text, (turn % 10) / 16.0::double as score from conversations),
p as (select a.conv_id, a.ord as lo, b.ord as hi, count(*) as n, string_agg(c.text, '' order by c.ord) as raw, sum(c.score) / count(*) as score
  from t a join t b on a.conv_id = b.conv_id and b.ord between a.ord and a.ord + 5 join t c on c.conv_id = a.conv_id and c.ord between a.ord and b.ord group by 1, 2, 3),
w as (select conv_id, raw, score from p union all
  select conv_id, string_agg(text, '' order by ord), sum(score) / count(*) from t group by conv_id union all
  select conv_id, string_agg(text, ' ' order by ord), sum(score) / count(*) from t group by conv_id)
select conv_id, raw, round(min(score), 6) as score from w where raw <> '' group by conv_id, raw, round(score, 6)""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("ord"), F.concat(F.upper("role"), F.length("text").cast("string")).alias("text"), ((F.col("turn") % 10) / 16.0).alias("score"))
    groups = tokens.collected(rows, ["conv_id"]).select("conv_id", F.explode(tokens.candidate_groups("pairs")).alias("g"))
    return groups.select("conv_id", "g.raw", F.round("g.score", 6).alias("score"))


def _readings(events: DataFrame) -> DataFrame:
    """Digit readings of a request: six, seven, one and two digits by turns, with scores in 64ths."""
    digits = F.lpad((F.col("event_id") * 7919 % 1000003).cast("string"), 7, "0")
    size = F.element_at(F.array(*[F.lit(n) for n in (6, 7, 1, 2)]), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select("user_id", F.col("event_id").alias("ord"), F.substr(digits, F.lit(1), size).alias("text"), ((F.col("event_id") % 64) / 64.0).alias("score"))


_READINGS = """r as (select user_id, event_id as ord, substr(lpad(cast(event_id * 7919 % 1000003 as varchar), 7, '0'), 1, [6, 7, 1, 2][event_id % 4 + 1]) as text, (event_id % 64) / 64.0::double as score from events)"""
_CANDIDATES = f"""{_READINGS}, chk as (select user_id, ord, text as digit, score + 0.03::double as s from r where length(text) = 1 union all
  select user_id, ord, substr(text, 1, 1), score - 0.05::double from r where length(text) = 2 union all select user_id, ord, substr(text, 2, 1), score - 0.03::double from r where length(text) = 2),
cand as (select user_id, text as base6, '' as check_digit, score + 0.04::double as score, false as direct from r where length(text) = 6 union all
  select user_id, substr(text, 1, 6), substr(text, 7, 1), score + 0.14::double, true from r where length(text) = 7 union all
  select a.user_id, a.text, c.digit, 0.82::double * a.score + 0.18::double * greatest(c.s, 0) + 0.05::double + case when c.ord > a.ord then 0.02::double else 0 end, false from r a join chk c on a.user_id = c.user_id where length(a.text) = 6)"""


@query(f"with {_CANDIDATES} select user_id, base6, check_digit, direct, count(*) as n, round(sum(score), 9) as score from cand group by user_id, base6, check_digit, direct")
def chunk_cross_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = voting.numeric_candidates(_readings(_t(spark, sf_dir, "events")), ["user_id"])
    return found.groupBy("user_id", "base6", "check_digit", "direct").agg(F.count("*").alias("n"), F.round(F.sum("score"), 9).alias("score"))


@query("""
with v as (select user_id, event_type, event_id, cast(round(value * 100) as bigint) as w from events),
t as (select user_id, event_type, cast(sum(w) as bigint) as vote, min(event_id) as first_seen from v group by 1, 2),
r as (select *, row_number() over w as k, lead(vote) over w as nxt, count(*) over (partition by user_id) as vote_count from t window w as (partition by user_id order by vote desc, first_seen))
select user_id, event_type, vote, first_seen, vote_count, vote - coalesce(nxt, 0) as margin from r where k = 1""")
def weighted_vote_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    tally = ranking.votes(_t(spark, sf_dir, "events"), ["user_id"], "event_type", F.round(F.col("value") * 100).cast("long"), "event_id")
    return ranking.winner(tally, ["user_id"]).select("user_id", "event_type", "vote", "first_seen", "vote_count", "margin")


@query("""
with l as (select l_orderkey as k, l_linenumber as ord, lpad(cast(l_partkey % 10000 as varchar), 4, '0') as quad, max(l_quantity) / 64 as l from lineitem group by 1, 2, 3),
r as (select o_orderkey as k, lpad(cast(o_custkey % 1000 as varchar), case when o_custkey % 2 = 0 then 2 else 3 end, '0') as tail, (o_custkey % 64) / 64.0::double as r from orders),
j as (select k, ord, quad, tail, 0.58::double * l + 0.42::double * r + case when length(tail) >= 3 then 0.04::double else 0 end as score from l join r using (k)),
w as (select *, row_number() over (partition by k order by score desc, ord, quad) as n from j)
select k, quad || substr(tail, 1, 2) as base6, substr(tail, 3, 1) as check_digit, round(score, 9) as score from w where n = 1""")
def quad_tail_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber", F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "0").alias("chunk")).agg((F.max("l_quantity") / 64).alias("score"))
    left = line.select("k", F.struct("l_linenumber", "chunk").alias("ord"), "chunk", "score")
    right = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("ord"), F.lpad((F.col("o_custkey") % 1000).cast("string"), F.when(F.col("o_custkey") % 2 == 0, 2).otherwise(3), F.lit("0")).alias("chunk"), ((F.col("o_custkey") % 64) / 64.0).alias("score"))
    return voting.quads_and_tails(left, right, ["k"]).select("k", "base6", "check_digit", F.round("score", 9).alias("score"))


@query("""
with n as (select distinct l_orderkey as k, l_linenumber as digit, l_returnflag = 'R' as direct from lineitem), d as (select k, digit, bool_or(direct) as direct from n group by 1, 2),
v as (select o_orderkey as k, cast(o_custkey % 7 + 1 as int) as digit, (o_custkey % 32) / 32.0::double as score from orders)
select v.k, v.digit, round(v.score + case when d.direct then 0.08::double else 0 end, 6) as weight from v join d on v.k = d.k and v.digit = d.digit""")
def semi_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("digit")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("direct"))
    votes = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 7 + 1).cast("int").alias("digit"), ((F.col("o_custkey") % 32) / 32.0).alias("score"))
    return votes.join(read, ["k", "digit"]).select("k", "digit", F.round(F.col("score") + F.when(F.col("direct"), 0.08).otherwise(0.0), 6).alias("weight"))


@query("""
with t as (select c_name as name from customer union all select p_name from part),
c as (select name, length(name) as n, length(regexp_replace(name, '[^0-9]', '', 'g')) as d, length(regexp_replace(name, '[^\\p{L}]', '', 'g')) as l from t)
select name, round(case when n < 5 then 0 else 0.45::double * least(1.0::double, n / 10.0::double) + case when d > 0 then 0.35::double else 0 end + case when d > 0 and l > 0 then 0.2::double else 0.12::double end end, 6) as quality from c""")
def seal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).union(_t(spark, sf_dir, "part").select("p_name"))
    return names.select("name", F.round(text.seal_quality("name"), 6).alias("quality"))


@query("""
select doc_id, regexp_extract(upper(t), '\\b([A-Z]{4}[0-9]{7})\\b', 1) as code from (
  select doc_id, text || ' ' || case when doc_id % 3 = 0 then 'no code here ' else 'container ' || lower('MSKU') || lpad(cast(doc_id % 10000000 as varchar), 7, '0') || ' seen in ' || source end as t from documents)
where regexp_extract(upper(t), '\\b([A-Z]{4}[0-9]{7})\\b', 1) <> ''""")
def code_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("doc_id") % 3 == 0, F.lit("no code here ")).otherwise(F.concat(F.lit("container msku"), F.lpad((F.col("doc_id") % 10000000).cast("string"), 7, "0"), F.lit(" seen in "), "source"))
    return _t(spark, sf_dir, "documents").select("doc_id", codes.first_code(F.concat("text", F.lit(" "), made)).alias("code")).where("code is not null")


@query("""
with r as (select user_id, event_id, 1 + event_id % 3 as stage, value, lpad(cast(event_id * 31 % 100 as varchar), 2, '0') as text from events),
m as (select *, case when length(text) = 2 then 0 end as z from r),
d as (select user_id, event_id, i, substr(text, cast(i as int) + 1, 1) as digit, (event_id % 64) / 64.0::double - 0.03::double + case when i = 1 then 0.04::double else 0 end + 0.04::double as final from m, unnest(range(2)) t(i)),
w as (select *, row_number() over (partition by user_id order by final desc, event_id, i) as k from d)
select user_id, digit, round(final, 6) as final from w where k = 1""")
def best_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), F.lpad((F.col("event_id") * 31 % 100).cast("string"), 2, "0").alias("text"), ((F.col("event_id") % 64) / 64.0).alias("score"))
    return tokens.best_digit(rows, ["user_id"]).select("user_id", "digit", F.round("final", 6).alias("final"))
