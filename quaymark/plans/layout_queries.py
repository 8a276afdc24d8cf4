"""Driver queries over layouts, bands, boxes, uploads, replies and reports, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import text
from quaymark.operators import bands, boxes, evaluation, history, routing
from quaymark.plans.bench_queries import _BOXES, _ITEMS, _boxes, _items

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Bands and symbols.

#: Bands of users: one for each day with events, as high as it has events.
_BANDS = """b as (select user_id, d * 100 as start, d * 100 + 4 + cast(n as int) * 3 as "end" from (select user_id, date_diff('day', date '2024-01-01', cast(ts as date)) as d, count(*) as n from events group by 1, 2))"""


def _day_bands(events: DataFrame) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return events.groupBy("user_id", (day * 100).alias("start")).agg(F.count("*").alias("n")).select("user_id", "start", (F.col("start") + 4 + F.col("n").cast("int") * 3).alias("end"), F.lit(600).alias("height"))


@query(f"""with {_BANDS}, h as (select *, "end" - start as h from b), t as (select * from h where h >= 9), p as (select user_id, quantile_cont(h, 0.7) as p70 from t group by 1),
m as (select user_id, greatest(9, cast(trunc(median(h)) as int)) as typical_height from t join p using (user_id) where h <= p70 group by 1)
select user_id, start, "end", typical_height from b left join m using (user_id)""")
def typical_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.typical_height(_day_bands(_t(spark, sf_dir, "events")), ["user_id"], "height").drop("height")


@query("""with c as (select o_orderkey, o_custkey % 15 as a, o_orderkey % 14 as b, (o_custkey + o_orderkey) % 13 as c from orders)
select o_orderkey, case when a between 10 and 12 then 'refined' when b between 10 and 12 then 'raw' when c between 10 and 12 then 'merged' when a > b and a >= 8 then 'refined' when b > c and b >= 8 then 'raw' else 'merged' end as chosen from c""")
def segmentation_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", bands.choose_segmentation(c % 15, o % 14, (c + o) % 13).alias("chosen"))


@query("""with c as (select p_partkey as k, cast(p_partkey % 50 as int) as s, p_size * 20 as h from part), g as (select k, s, h, cast(i as int) as part, cast(round_even(h * i / 11.0::double, 0) as int) as a, cast(round_even(h * (i + 1) / 11.0::double, 0) as int) as b from c, unnest(range(11)) t(i))
select k, part, s + a as part_start, s + b as part_end from g where b - a >= greatest(8, cast(trunc(h * 0.04::double) as int))""")
def equal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 50).cast("int").alias("s"), (F.col("p_partkey") % 50 + F.col("p_size") * 20).cast("int").alias("e"))
    return bands.equal_grid(rows, "s", "e", 11).select("k", "part", "part_start", "part_end")


#: Events of each user by their number modulo 64: a profile of 64 places.
_PROFILE = "pr as (select user_id, i as pos, coalesce(n, 0) as strength from (select distinct user_id from events), unnest(range(64)) t(i) left join (select user_id as u, event_id * 37 % 64 as m, count(*) as n from events group by 1, 2) on u = user_id and m = i)"


def _profiles(events: DataFrame) -> DataFrame:
    """(user_id, profile) with the strengths of 64 places."""
    counts = events.groupBy("user_id", (F.col("event_id") * 37 % 64).cast("int").alias("m")).agg(F.count("*").cast("double").alias("n"))
    have = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("m", "n"))).alias("have"))
    return have.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("have", i), F.lit(0.0))).alias("profile"))


@query(f"""with {_PROFILE}, l as (select user_id, list(strength order by pos) as p from pr group by 1),
s as (select user_id, list_transform(range(64), lambda i: list_sum(list_transform(range(7), lambda k: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125][k + 1]::double * p[case when abs(i + k - 3) < 64 then abs(i + k - 3) else 126 - abs(i + k - 3) end + 1]))) as v from l),
a as (select s.user_id, arg_min(i, (v[i + 1], i)) as c1 from s, unnest(range(14, 28)) t(i) group by 1),
b as (select s.user_id, a.c1, arg_min(i, (v[i + 1], i)) as c2 from s join a using (user_id), unnest(range(34, 50)) t(i) where i >= greatest(a.c1 + 10, 36) group by 1, 2)
select user_id, 0 as start, cast(c1 as int) as "end" from b union all select user_id, cast(c1 as int), cast(c2 as int) from b union all select user_id, cast(c2 as int), 64 from b""")
def valley_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = bands.split_at_valleys(F.col("profile"), F.lit(0), F.lit(64), F.lit(3))
    return _profiles(_t(spark, sf_dir, "events")).select("user_id", F.explode(cuts).alias("b")).select("user_id", "b.*")


@query(f"""with {_PROFILE}, k as (select user_id, max(strength) as peak from pr group by 1), i as (select * from pr where pos >= 17 and pos < 46), m as (select user_id, min((strength, pos)) as low from i group by 1)
select user_id, low[2] as cut from m join k using (user_id) where peak > 0 and low[1] <= 0.62::double * peak and low[2] >= 20 and 64 - low[2] >= 20""")
def deepest_valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _profiles(_t(spark, sf_dir, "events")).select("user_id", F.posexplode("profile").alias("pos", "strength"))
    return bands.deepest_valley(rows, ["user_id"], 20)


@query("""with p as (select event_type, user_id as pos, count(*) filter (event_id % 3 = 0) as strength from events group by 1, 2), l as (select *, pos - row_number() over (partition by event_type order by pos) as g from p where strength >= 4),
r as (select event_type, min(pos) as start, max(pos) + 1 as "end" from l group by event_type, g), o as (select *, case when start - lag("end") over (partition by event_type order by start) <= 3 then 0 else 1 end as opens from r),
m as (select *, sum(opens) over (partition by event_type order by start rows unbounded preceding) as grp from o), b as (select event_type, min(start) as start, max("end") as "end" from m group by event_type, grp having max("end") - min(start) >= 12)
select b.event_type, b.start, b."end", cast(sum(p.strength) as bigint) as strength from b join p on p.event_type = b.event_type and p.pos >= b.start and p.pos < b."end" group by 1, 2, 3""")
def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _t(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("y"), F.when(F.col("event_id") % 3 == 0, 255).otherwise(0).alias("v"))
    rows = bands.profile(pixels, ["event_type"], "y")
    return bands.text_rows(rows.withColumn("w", F.lit(50)).withColumn("h", F.lit(200)), ["event_type"], "w", "h").select("event_type", "start", "end", "strength")


# Seams.

_SEAM = """c as (select c_nationkey as k, c_custkey % 400 as x, max(c_acctbal) / 100 as edge, max(c_custkey % 7) / 8.0::double as density from customer group by 1, 2),
bd as (select k, x, i, 20 + i * 60 as start, 40 + i * 60 + x % 9 * (i + 1) as "end", 1000 + (x * 37 + i * 101) % 500 as strength from c, unnest(range(3)) t(i)),
two as (select *, row_number() over (partition by k, x order by strength desc, "end" - start desc, start) as n from bd), bb as (select k, x, list(start order by start) as s, list("end" order by start) as e, sum(strength) as st from two where n <= 2 group by 1, 2), gap as (select k, x, s[2] - e[1] as gap, st from bb)"""


def _seam_rows(customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = customer.groupBy(F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 400).alias("x")).agg((F.max("c_acctbal") / 100).alias("edge"), (F.max(F.col("c_custkey") % 7) / 8.0).alias("density"))
    c = c.withColumn("width", F.lit(400)).withColumn("height", F.lit(450))
    x, i = F.col("x"), F.col("i")
    b = c.select("k", "x", "height", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    return c, b.select("k", "x", "height", (20 + i * 60).alias("start"), (40 + i * 60 + x % 9 * (i + 1)).alias("end"), (1000 + (x * 37 + i * 101) % 500).alias("strength"))


@query(f"""with {_SEAM}, pk as (select k, greatest(1.0::double, max(edge)) as peak from c group by 1), l as (select c.k, c.x, edge - density * peak * 0.35::double as local from c join pk using (k) where x >= 112 and x < 288),
r as (select *, row_number() over (partition by k order by local desc, x) as n, max(local) over (partition by k) as best from l), f as (select * from r where best > 0),
t as (select f.k, f.x, f.n, local + 0.0008::double * st - 20.0::double * abs(greatest(1, f.x - 14) / 400.0::double - 0.42::double) + 0.4::double * gap as score from f join gap using (k, x) where n <= 4 and gap >= 9 and greatest(1, f.x - 14) >= 88 and 400 - least(400, f.x + 14) >= 48),
w as (select *, row_number() over (partition by k order by score desc, n) as i from t where score > -1)
select f.k, coalesce(w.x, f.x) as x from f left join w on w.k = f.k and w.i = 1 where f.n = 1""")
def seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, left = _seam_rows(_t(spark, sf_dir, "customer"))
    return routing.seam(columns, left, ["k"]).select("k", "x")


_CANDIDATES = """p as (select p_partkey as k, p_size * 30 as w, cast(p_partkey % 300 as int) as est from part), x as (select k, est as x, 0 as i from p union all select k, s, 1 + row_number() over (partition by k order by s) from (select k, unnest(range(cast(trunc(w * 0.30::double) as int), cast(trunc(w * 0.70::double) as int), greatest(18, cast(trunc(w * 0.018::double) as int)))) as s from p)),
u as (select k, x, min(i) as i from x group by 1, 2)"""


@query(f"with {_CANDIDATES} select k, cast(row_number() over (partition by k order by i) - 1 as int) as cand_ord, cast(x as int) as x from u")
def seam_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 30).alias("width"), (F.col("p_partkey") % 300).cast("int").alias("est"))
    return routing.seam_candidates(images, "est").select("k", "cand_ord", "x")


@query(f"""with {_SEAM}, t as (select k, x, 0.001::double * st + gap - 25.0::double * abs(greatest(1, x - 14) / 400.0::double - 0.40::double) as s from gap where gap >= 6 and greatest(1, x - 14) >= 88 and 400 - least(400, x + 14) >= 48),
w as (select *, row_number() over (partition by k order by s desc, x) as n from t where s > -1) select k, x, round(s, 6) as seam_score from w where n = 1""")
def split_at_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, left = _seam_rows(_t(spark, sf_dir, "customer"))
    candidates = columns.select("k", "x", F.col("x").alias("cand_ord"), "width", F.lit(290).alias("height"))
    found = routing.split_at_seam(candidates, left, ["k"], min_height=200)
    return found.select("k", "x", F.round("seam_score", 6).alias("seam_score"))


@query("""select o_orderkey, h >= 420 and w / greatest(h, 1)::double between 1.35 and 3.0 and l >= cast(trunc(w * 0.22::double) as int) and w - r >= cast(trunc(w * 0.12::double) as int) as allowed
from (select *, greatest(1, x - p) as l, least(w, x + p) as r from (select *, greatest(14, cast(trunc(w * 0.014::double) as int)) as p from (select o_orderkey, 400 + o_custkey % 1500 as w, 300 + o_orderkey % 600 as h, o_orderkey * 7 % 1400 as x from orders)))""")
def seam_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", routing.seam_allowed(400 + c % 1500, 300 + o % 600, o * 7 % 1400).alias("allowed"))


# Boxes.


@query(f"""with {_BOXES}, c as (select k, ord, greatest(0, x1 - 10) as a, greatest(0, y1 - 10) as b, least(60, x2) as c, least(50, y2) as d, cast(trunc(least(x2 - x1, y2 - y1) * 0.06::double) as int) as m, x1, y1, x2, y2 from b)
select k, cast(ord as int) as ord, case when c > a and d > b then a end as clamp_x1, case when c > a and d > b then d end as clamp_y2, x1 + m as inner_x1, y2 - m as inner_y2, cast(trunc((x2 - x1) * 0.10::double) as int) as pad_left, cast(trunc((y2 - y1) * 0.07::double) as int) as pad_top,
  cast(trunc((x2 - x1) * 0.30::double) as int) as zone_x1, cast(trunc((y2 - y1) * 0.98::double) as int) as zone_y2 from c""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(_t(spark, sf_dir, "lineitem"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    held, less, pad, part = boxes.clamp(F.col("x1") - 10, F.col("y1") - 10, "x2", "y2", F.lit(60), F.lit(50)), boxes.inner("x1", "y1", "x2", "y2", boxes.INNER_MARGIN), boxes.padding(w, h), boxes.zone(w, h, 0.30, 0.02, 1.0, 0.98)
    return rows.select("k", "ord", held["x1"].alias("clamp_x1"), held["y2"].alias("clamp_y2"), less["x1"].alias("inner_x1"), less["y2"].alias("inner_y2"), pad["left"].alias("pad_left"), pad["top"].alias("pad_top"), part["x1"].alias("zone_x1"), part["y2"].alias("zone_y2"))


@query("""with p as (select l_orderkey as k, l_partkey % 40 as x, l_suppkey % 30 as y from lineitem where l_quantity > 10)
select k, greatest(0, min(x) - 2) as x1, greatest(0, min(y) - 2) as y1, least(40, max(x) + 3) as x2, least(30, max(y) + 3) as y2 from p group by k""")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 30).alias("y"), F.when(F.col("l_quantity") > 10, 255).otherwise(0).alias("v"), F.lit(40).cast("long").alias("w"), F.lit(30).cast("long").alias("h"))
    return boxes.bounding_box(pixels, ["k"], "w", "h")


@query("""with r as (select o_orderkey as k, o_orderkey % 90 as x, o_custkey % 50 as y, o_custkey % 40 as w, o_orderkey % 37 as h from orders),
s as (select *, cast(trunc(greatest(w, h) * 0.14::double) as int) as p from r where w > 2 and h > 2 and w * h between 60.0 and 2700.0 and w / h::double between 0.62 and 1.45 and x >= 8)
select k, cast(w * h as double) as area, greatest(0, x - p) as x1, greatest(0, y - p) as y1, least(100, x + w + p) as x2, least(60, y + h + p) as y2 from s where least(100, x + w + p) > greatest(0, x - p) and least(60, y + h + p) > greatest(0, y - p)""")
def square_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    rects = _t(spark, sf_dir, "orders").select(o.alias("k"), (o % 90).alias("x"), (c % 50).alias("y"), (c % 40).alias("w"), (o % 37).alias("h"), F.lit(100).cast("long").alias("zw"), F.lit(60).cast("long").alias("zh"))
    return boxes.square_candidates(rects, "zw", "zh").select("k", "area", "x1", "y1", "x2", "y2")


@query("""with i as (select p_partkey as k, cast(100 + p_partkey % 97 as int) as w, p_size * 3 as h from part), z as (select * from (values (0, 'primary', 0.72, 0.03, 1.0, 0.97), (1, 'mid', 0.76, 0.05, 1.0, 0.95), (2, 'tight', 0.84, 0.02, 1.0, 0.98)) t(zone_ord, zone, a, b, c, d))
select k, zone_ord, zone, cast(trunc(w * a::double) as int) as x1, cast(trunc(h * b::double) as int) as y1, least(w, cast(trunc(w * c::double) as int)) as x2, least(h, cast(trunc(h * d::double) as int)) as y2 from i, z where cast(trunc(h * d::double) as int) > cast(trunc(h * b::double) as int)""")
def check_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (100 + F.col("p_partkey") % 97).cast("int").alias("width"), (F.col("p_size") * 3).alias("height"))
    return boxes.check_zones(images).select("k", "zone_ord", "zone", "x1", "y1", "x2", "y2")


# Images, uploads, replies and reports.


@query("""select p_partkey, w / greatest(h, 1)::double >= 3.2 and h > 0 as horizontal, w / greatest(h, 1)::double <= 0.22 and h > 0 as vertical, case when p_partkey % 3 = 0 then 'unknown' when crop <> 'unknown' then crop else direct end as type
from (select p_partkey, p_partkey % 97 + 1 as w, p_size as h, ['oneline', 'unknown', 'vertical'][p_partkey % 3 + 1] as crop, ['twolines', 'unknown'][p_partkey % 2 + 1] as direct from part)""")
def image_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, w, h = F.col("p_partkey"), F.col("p_partkey") % 97 + 1, F.col("p_size")
    crop = F.when(k % 3 == 0, "oneline").when(k % 3 == 1, "unknown").otherwise("vertical")
    kind = routing.image_type(F.when(k % 3 == 0, "seal").otherwise("container"), crop, F.when(k % 2 == 0, "twolines").otherwise("unknown"))
    return _t(spark, sf_dir, "part").select("p_partkey", routing.is_horizontal(w, h).alias("horizontal"), routing.is_vertical(w, h).alias("vertical"), kind.alias("type"))


_PATHS = r"""p as (select doc_id, ['Set/Images/d' || doc_id || '.JPG', 'set\labels\d' || doc_id || '.txt', 'set//text/d' || doc_id || '.txt', 'set/other/d' || doc_id || '.png', 'd' || doc_id || '.png', '/set/images/deep/d' || doc_id || '.webp', 'set/labels/text/d' || doc_id || '.txt', 'set/images/d' || doc_id || '.txt'][doc_id % 8 + 1] as path from documents)"""


def _paths(docs: DataFrame) -> DataFrame:
    forms = ("Set/Images/d%s.JPG", "set\\labels\\d%s.txt", "set//text/d%s.txt", "set/other/d%s.png", "d%s.png", "/set/images/deep/d%s.webp", "set/labels/text/d%s.txt", "set/images/d%s.txt")
    return docs.select("doc_id", F.element_at(F.array(*[F.format_string(f, F.col("doc_id").cast("string")) for f in forms]), (F.col("doc_id") % 8 + 1).cast("int")).alias("path"))


@query(f"""with {_PATHS}, q as (select doc_id, list_filter(string_split(lower(replace(path, '\\', '/')), '/'), lambda x: x <> '') as s from p)
select doc_id, case when regexp_matches(s[-1], '[.](jpg|jpeg|png|webp|bmp)$') and (list_contains(s, 'images') or len(s) = 1) then 'images' when s[-1] like '%.txt' and list_contains(s, 'labels') then 'labels' when s[-1] like '%.txt' and list_contains(s, 'text') then 'text' end as role from q""")
def upload_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(_t(spark, sf_dir, "documents")).select("doc_id", evaluation.upload_role("path").alias("role"))


@query(f"""with {_PATHS}, q as (select list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x <> '')[1] as root from p)
select 'as they are' as paths, case when count(distinct root) = 1 then 'uploaded:' || min(root) else 'uploaded:folder' end as dataset from q union all select 'under one', 'uploaded:one' from q group by 1, 2 union all select 'none', 'uploaded:folder'""")
def dataset_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _paths(_t(spark, sf_dir, "documents"))
    named = lambda rows, name: evaluation.dataset_name(rows).select(F.lit(name).alias("paths"), "dataset")
    under = paths.select(F.concat(F.lit("one/"), F.col("path")).alias("path"))
    return named(paths, "as they are").unionByName(named(under, "under one")).unionByName(named(paths.where("path is null"), "none"))


@query("""with n as (select 's' || doc_id as stem, doc_id, i as ord, 'L' || (doc_id * 7 + i) as v from labels, unnest(range(1, 3)) t(i)), m as (select stem, arg_max(v, ord) as label, arg_max(case when doc_id % 2 = 0 then v end, ord) as txt from n group by 1)
select 's' || d.doc_id as stem, m.label as expected_label, m.txt as expected_text from documents d left join m on m.stem = 's' || d.doc_id""")
def join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("stem")
    notes = _t(spark, sf_dir, "labels").select(stem, "doc_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("ord")).withColumn("v", F.concat(F.lit("L"), (F.col("doc_id") * 7 + F.col("ord")).cast("string")))
    return evaluation.join_labels(_t(spark, sf_dir, "documents").select(stem), notes.select("stem", "ord", F.col("v").alias("label")), notes.where("doc_id % 2 = 0").select("stem", "ord", F.col("v").alias("expected_text"))).select("stem", "expected_label", "expected_text")


_REPLY = """b as (select event_id, case event_id % 8 when 0 then '{"result": " TCKU' || event_id || ' "}' when 1 then '{"result": ' || event_id || '}' when 2 then '{"message": "ok Result: ABC' || event_id || ' "}' when 3 then '{"raw_text": "r' || event_id || '", "result": ""}' when 4 then 'no json result: X' || event_id
  when 5 then '{"result": null, "failure_reason": "bad"}' when 6 then '{"ocr_debug": {"reason": 5}, "raw_text": [1]}' else '{"ocr_debug": {"reason": " dark "}}' end as body from events),
j as (select event_id, body, case when json_valid(body) then body end as js from b),
f as (select *, case when json_type(js, '$.result') = 'VARCHAR' then nullif(trim(js ->> '$.result'), '') end as r, case when json_type(js, '$.raw_text') = 'VARCHAR' then nullif(trim(js ->> '$.raw_text'), '') end as w, case when json_type(js, '$.failure_reason') = 'VARCHAR' then nullif(trim(js ->> '$.failure_reason'), '') end as x,
  case when json_type(js, '$.ocr_debug.reason') = 'VARCHAR' then nullif(trim(js ->> '$.ocr_debug.reason'), '') end as y, trim(regexp_extract(coalesce(js ->> '$.message', ''), '(?i)RESULT\\s*:\\s*(.+)$', 1)) as m, trim(regexp_extract(body, '(?i)RESULT\\s*:\\s*(.+)$', 1)) as q from j)"""


@query(f"with {_REPLY}, g as (select *, coalesce(r, nullif(m, ''), nullif(q, ''), '') as result from f) select event_id, result, coalesce(w, result) as raw, coalesce(x, nullif(y, 'ok'), '') as reason from g")
def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    forms = (('{"result": " TCKU', ' "}'), ('{"result": ', "}"), ('{"message": "ok Result: ABC', ' "}'), ('{"raw_text": "r', '", "result": ""}'), ("no json result: X", ""))
    made = [F.concat(F.lit(a), i, F.lit(b)) for a, b in forms] + [F.lit(x) for x in ('{"result": null, "failure_reason": "bad"}', '{"ocr_debug": {"reason": 5}, "raw_text": [1]}', '{"ocr_debug": {"reason": " dark "}}')]
    rows = _t(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*made), (F.col("event_id") % 8 + 1).cast("int")).alias("body"))
    return rows.select("event_id", text.result_text("body", "body").alias("result"), text.raw_text("body", "body").alias("raw"), text.failure_reason("body").alias("reason"))


@query("select event_id, case when event_id % 2 = 0 then format('Read timeout after {:.1f}s. Increase timeout and retry.', floor(value) + 0.5) else event_type end as error from events")
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "read_timeout").otherwise("other")
    return _t(spark, sf_dir, "events").select("event_id", text.request_error(kind, "event_type", F.floor("value") + 0.5).alias("error"))


@query(f"""with {_ITEMS}, x as (select *, regexp_extract(coalesce(nullif(case when event_id % 4 = 0 then '' else p end, ''), 'seen MSKU1234567'), '[A-Z]{{4}}[0-9]{{7}}') as code, coalesce(regexp_extract(et, '[A-Z]{{4}}[0-9]{{7}}'), regexp_extract(el, '[A-Z]{{4}}[0-9]{{7}}'), '') as e, case when event_id % 5 = 0 then 0 else elapsed_ms / 4 end as rec from i)
select user_id, event_id, row_number() over (partition by user_id order by event_id) as request_id, case when event_id % 3 = 0 then 'unknown' else 'oneline' end as type, e as expected, code as predicted, round(case when rec > 0 then rec else elapsed_ms end / 1000, 9) as recognition_sec, round(greatest(0, elapsed_ms - case when rec > 0 then rec else elapsed_ms end) / 1000, 9) as overhead_sec from x""")
def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    items = _items(_t(spark, sf_dir, "events")).withColumn("normalized_predicted", F.when(i % 4 == 0, "").otherwise(F.col("normalized_predicted"))).withColumn("predicted_text", F.lit("seen MSKU1234567"))
    items = items.withColumn("file_name", i.cast("string")).withColumn("number_type", F.when(i % 3 != 0, "oneline")).withColumn("stage_timings", F.when(i % 5 != 0, F.create_map(F.lit("ocr_ms"), F.col("elapsed_ms") / 4)))
    rows = evaluation.log_rows(items, ["user_id"], "event_id").withColumn("p", F.col("photos")[0])
    one = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    return rows.select("user_id", F.col("p.file").cast("long").alias("event_id"), "request_id", "p.type", one(F.col("p.expected")).alias("expected"), one(F.col("p.predicted")).alias("predicted"), F.round("recognition_sec", 9).alias("recognition_sec"), F.round("overhead_sec", 9).alias("overhead_sec"))


@query(f"with {_ITEMS} select event_id, error is not null or status_code not in (0, 200) or (coalesce(et, el, '') <> '' and p <> coalesce(et, el)) as alert from i")
def page_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(_t(spark, sf_dir, "events"))
    return items.select("event_id", evaluation.is_alert_on_page(F.col("error"), F.col("status_code"), F.col("expected_text"), F.col("expected_label"), F.col("normalized_predicted")).alias("alert"))


@query("with n as (select o_orderkey as id, o_custkey from orders order by o_orderkey desc limit 50) select id, o_custkey % 3 = 0 as has_report from n")
def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return history.runs_with_reports(runs, runs.where("o_custkey % 3 = 0").select(F.col("id").alias("run_id"))).select("id", "has_report")


@query("""with i as (select l_orderkey as run_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as id, l_quantity from lineitem where l_orderkey = 33)
select o_orderkey as id, count(i.id) as n, coalesce(string_agg(cast(cast(l_quantity as int) as varchar), ',' order by i.id), '') as quantities from orders left join i on run_id = o_orderkey where o_orderkey = 33 group by 1""")
def run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _boxes(_t(spark, sf_dir, "lineitem")).select(F.col("k").alias("run_id"), F.col("ord").alias("id"), (F.col("x2") - F.col("x1") - 20).alias("quantity"), F.lit(None).cast("map<string,double>").alias("stage_timings"))
    run = history.run_with_items(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), items, 33)
    some = F.coalesce("items", F.array().cast(run.schema["items"].dataType))
    return run.select("id", F.size(some).cast("long").alias("n"), F.array_join(F.transform(some, lambda x: x["quantity"].cast("string")), ",").alias("quantities"))


def _percent(c: Column) -> Column:
    return text.percent(F.when(c % 7 != 0, c % 1000 / 1000.0))


@query("select o_orderkey, case when o_custkey % 7 = 0 then 'N/A' else format('{:.2f}%', o_custkey % 1000 / 1000.0::double * 100.0::double) end as share, case when o_custkey % 7 = 0 then 'N/A' else format('{:.3f}', o_custkey % 1000 / 1000.0::double) end as number from orders")
def report_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", _percent(c).alias("share"), text.number(F.when(c % 7 != 0, c % 1000 / 1000.0)).alias("number"))


@query(f"""with {_PATHS}, q as (select doc_id, replace(path, '\\', '/') as path from p) select doc_id, string_split(path, '/')[-1] as name, case when len(string_split(path, '/')) > 1 then string_split(path, '/')[-2] else '' end as parent, regexp_replace(string_split(path, '/')[-1], '[.][^.]*$', '') as stem, lower(regexp_extract(path, '[.]([^.]+)$', 1)) as suffix,
case lower(regexp_extract(path, '[.]([^.]+)$', 1)) when 'jpg' then 'image/jpeg' when 'png' then 'image/png' when 'webp' then 'image/webp' when 'txt' then 'text/plain' end as mime from q""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(_t(spark, sf_dir, "documents"))
    return rows.select("doc_id", text.file_name("path").alias("name"), text.parent_name("path").alias("parent"), text.stem("path").alias("stem"), text.suffix("path").alias("suffix"), text.mime("path").alias("mime"))
