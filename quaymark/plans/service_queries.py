"""Driver queries over what a service stores and replies, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import text
from quaymark.operators import boxes, history, routing, tokens
from quaymark.plans.code_queries import _CHECK
from quaymark.sources import inference

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("select event_id, row_number() over (order by event_id) + 41 as id from events")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.with_ids(_t(spark, sf_dir, "events").select("event_id"), 42, "event_id")


#: Stored summaries: whole, with a field of a wrong kind, without a field, cut off, a list, nothing.
_BODY = """case o_orderkey % 6 when 0 then concat('{"mode": "container", "total_images": ', cast(o_custkey as string), ', "latency_mean_ms": ', cast(o_custkey % 16 as string), '.25, "labels_available": true, "label_accuracy": null}')
  when 1 then '{"mode": "seal", "total_images": "many", "latency_mean_ms": 1.5, "labels_available": false}' when 2 then concat('{"mode": "mix", "text_total": ', cast(o_custkey as string), ', "more": {"a": 1}}')
  when 3 then '{"mode": "container", "total_im' when 4 then '[1, 2]' end"""


@query(f"""with b as (select o_orderkey, {_BODY} as body from orders), j as (select o_orderkey, case when json_valid(body) and json_type(body) = 'OBJECT' then body end as body from b)
select o_orderkey, body is not null as summary_ok, json_extract_string(body, '$.mode') as mode, try_cast(json_extract_string(body, '$.total_images') as bigint) as total_images, try_cast(json_extract_string(body, '$.latency_mean_ms') as double) as latency_mean_ms,
  try_cast(json_extract_string(body, '$.labels_available') as boolean) as labels_available, try_cast(json_extract_string(body, '$.text_total') as bigint) as text_total from j""")
def parsed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _t(spark, sf_dir, "orders").select("o_orderkey", F.expr(_BODY).alias("summary_json"))
    return history.parsed_summaries(runs).select("o_orderkey", "summary_ok", *[F.col(f"summary.{c}").alias(c) for c in ("mode", "total_images", "latency_mean_ms", "labels_available", "text_total")])


#: Boxes of an order, as a detector gives them: some reach out of the image, some lie outside.
_BOXES = "select l_orderkey as image_id, cast(l_linenumber as int) as ord, cast(l_suppkey % 8 as double) / 8 as conf, cast(l_partkey % 120 - 20 as int) as x1, cast(l_suppkey % 90 - 10 as int) as y1, cast(l_partkey % 120 - 20 + l_quantity as int) as x2, cast(l_suppkey % 90 - 10 + l_linenumber * 3 as int) as y2 from {lineitem}"
_DIMS = "select o_orderkey as image_id, cast(60 + o_custkey % 40 as int) as width, cast(20 + o_custkey % 50 as int) as height from {orders}"
_DEDUPED = "(select distinct l_orderkey, l_linenumber, min(l_partkey) over w as l_partkey, min(l_suppkey) over w as l_suppkey, min(l_quantity) over w as l_quantity from lineitem window w as (partition by l_orderkey, l_linenumber))"
_CROPS = f"""d as ({_BOXES.format(lineitem=_DEDUPED)}), m as ({_DIMS.format(orders='orders')}),
b as (select image_id, ord, conf, width, height, greatest(0, x1) as x1, greatest(0, y1) as y1, least(width, x2) as x2, least(height, y2) as y2 from d join m using (image_id)),
c as (select image_id, cast(place as int) as crop, conf, x1, y1, x2, y2 from (select *, row_number() over (partition by image_id order by conf desc, ord) - 1 as place from b where x2 > x1 and y2 > y1) where place < 3)"""


def _detected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    cast = lambda df, sql: spark.sql(sql, lineitem=df, orders=df)
    return cast(line, _BOXES), cast(_t(spark, sf_dir, "orders"), _DIMS)


@query(f"with {_CROPS} select * from c")
def crops_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.crops(*_detected(spark, sf_dir), most=3)


_TYPE = "case when {h} <= 0 then 'unknown' when {w} / cast({h} as double) <= 0.22 then 'vertical' when {w} / cast({h} as double) <= 3.0 then 'twolines' when {b} then 'twolines' when {w} / cast({h} as double) >= 3.0 then 'oneline' else 'unknown' end"


@query(f"""with {_CROPS}, f as (select image_id, t from (select image_id, t, row_number() over (partition by image_id order by crop) as r from (select image_id, crop, {_TYPE.format(w='(x2 - x1)', h='(y2 - y1)', b='(image_id + crop) % 5 = 0')} as t from c) where t <> 'unknown') where r = 1)
select m.image_id, coalesce(f.t, {_TYPE.format(w='width', h='height', b='m.image_id % 7 = 0')}) as image_type from m left join f on f.image_id = m.image_id""")
def image_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, dims = _detected(spark, sf_dir)
    cut = inference.crops(found, dims, most=3)
    bands = cut.select("image_id", "crop", ((F.col("image_id") + F.col("crop")) % 5 == 0).alias("two_bands")).unionByName(dims.select("image_id", F.lit(-1).alias("crop"), (F.col("image_id") % 7 == 0).alias("two_bands")))
    return inference.crop_layouts(cut, dims, bands)


_CODE = "case when (l_partkey + l_linenumber) % 3 = 0 then '' else 'TCKU' || lpad(cast(l_partkey % 1000000 as varchar), 6, '0') end"


@query(f"""with x as (select l_orderkey as image_id, l_linenumber as crop, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by 1, 2), y as (select *, l_linenumber from (select *, crop as l_linenumber from x)),
r as (select image_id, crop, {_CODE} as base10, cast(l_suppkey % 10 as varchar) as d, (l_suppkey % 8) / 8.0::double as score, case when l_suppkey % 4 = 0 then '' else 'RAW' end as raw_text from y),
s as (select image_id, crop, base10, case when base10 = '' then '' else d end as check_digit, score, raw_text, base10 <> '' and cast({_CHECK.format(b='base10')} as varchar) = d as valid from r),
v as (select *, score + case when raw_text <> '' then 1 else 0 end + case when base10 <> '' then 14 when raw_text <> '' then 0 else 0 end as rank from s)
select image_id, cast(crop as int) as crop, base10 || check_digit as code, valid from (select *, row_number() over (partition by image_id order by valid desc, case when valid then 0 else rank end desc, crop) as k from v) where k = 1""")
def crop_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("int").alias("crop")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    base = F.when((F.col("p") + F.col("crop")) % 3 == 0, "").otherwise(F.concat(F.lit("TCKU"), F.lpad((F.col("p") % 1000000).cast("string"), 6, "0")))
    results = routing.shape_full(rows.select("image_id", "crop", base.alias("base10"), F.when(base == "", "").otherwise((F.col("s") % 10).cast("string")).alias("check_digit"), F.when(F.col("s") % 4 == 0, "").otherwise("RAW").alias("raw_text"), (F.col("s") % 8 / 8.0).alias("score")))
    best = routing.first_valid_crop(results, ["image_id"])
    return best.select("image_id", "crop", F.concat("base10", "check_digit").alias("code"), F.col("is_valid_iso").alias("valid"))


@query("""with x as (select o_orderkey, o_custkey % 50 as h, o_orderkey % 300 as w, o_custkey % 3 = 0 as has, case when o_custkey % 2 = 0 then 'TCKU123456' else '' end as code, case when o_orderkey % 3 = 0 then '' else 'RAW' end as raw from orders)
select o_orderkey, case when code <> '' then code else raw end as lenient, case when code <> '' then code else 'NOT_FOUND' end as strict, [h, w, 3] as shape,
  '[crop-ratio] label=test file=f src_h=' || h || ' src_w=' || w || ' src_ratio=' || case when h > 0 and w > 0 then cast(round(w / h::double, 3) as varchar) else 'None' end || ' crop_h=' || case when has then cast(h as varchar) else 'None' end || ' crop_w=' || case when has then '10' else 'None' end
    || ' crop_ratio=' || case when has and h > 0 then cast(round(10 / h::double, 3) as varchar) else 'None' end || ' container_h=' || case when has then cast(h as varchar) else 'None' end || ' container_w=' || case when has then '10' else 'None' end || ' bbox_h=' || case when has then cast(h as varchar) else 'None' end || ' bbox_w=' || case when has then '10' else 'None' end as line
from x""")
def image_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", (c % 50).alias("h"), (o % 300).alias("w"), (c % 3 == 0).alias("has"), F.when(c % 2 == 0, "TCKU123456").otherwise("").alias("base10"), F.lit("").alias("check_digit"), F.when(o % 3 == 0, "").otherwise("RAW").alias("raw_text"), F.lit(0.5).alias("score"))
    strict = routing.shape_image(rows).select("o_orderkey", F.col("result").alias("strict"))
    crop_h, crop_w = F.when(F.col("has"), F.col("h")), F.when(F.col("has"), F.lit(10))
    box = F.when(F.col("has"), F.struct(F.lit(5).alias("x1"), F.lit(0).alias("y1"), F.lit(15).alias("x2"), F.col("h").alias("y2")))
    line = routing.ratio_line(F.lit("test"), F.lit("f"), (F.col("h"), F.col("w")), (crop_h, crop_w), box)
    lenient = routing.shape_image(rows, accept_other=True)
    return lenient.select("o_orderkey", F.col("result").alias("lenient"), routing.shape_of(F.col("h"), F.col("w"), F.lit(3)).alias("shape"), line.alias("line")).join(strict, "o_orderkey").select("o_orderkey", "lenient", "strict", "shape", "line")


@query("""with x as (select o_orderkey, o_custkey % 3 as a, o_custkey % 4 as b, o_orderkey % 5 as c from orders)
select o_orderkey, case when b <> 0 then 'seg' || b when a <> 0 then 'own' || a end as layout, case when a <> 0 then cast(c as varchar) end as endpoint, case when b <> 0 then cast(b as varchar) end as top from x""")
def snapshot_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("o_custkey") % 3, F.col("o_custkey") % 4, F.col("o_orderkey") % 5
    own = F.when(a != 0, F.create_map(F.lit("layout"), F.concat(F.lit("own"), a.cast("string")), F.lit("endpoint"), c.cast("string")))
    found = F.when(b != 0, F.create_map(F.lit("layout"), F.concat(F.lit("seg"), b.cast("string")), F.lit("top"), b.cast("string")))
    meta = history.snapshot_meta(own, found)
    return _t(spark, sf_dir, "orders").select("o_orderkey", *[F.try_element_at(meta, F.lit(k)).alias(k) for k in ("layout", "endpoint", "top")])


@query("""with x as (select l_orderkey as k, l_linenumber, cast(l_suppkey % 50 as int) as x, cast(l_linenumber as int) as y from lineitem), d as (select distinct k, x, y from x)
select k, x, y, cast(row_number() over (partition by k order by x, y) - 1 as int) as i from d""")
def symbols_left_to_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 50).cast("int").alias("x"), F.col("l_linenumber").cast("int").alias("y")).distinct()
    return boxes.left_to_right(rows, ["k"])


#: Replies with white space of several kinds around what counts.
_REPLY = """case event_id % 6 when 0 then concat('{"result": " ABC', cast(event_id % 7 as string), '\\\\n"}') when 1 then '{"result": "\\\\t ", "message": "processed: 1, RESULT: \\\\u00a0XYZ\\\\u2003"}' when 2 then '{"result": 5, "message": "x"}'
  when 3 then '{"failure_reason": "\\\\n", "ocr_debug": {"reason": " ok "}}' when 4 then '{"failure_reason": "late\\\\r\\\\n"}' else '{"raw_text": "\\\\u3000Q\\\\t", "ocr_debug": {"reason": "dark "}}' end"""


@query("""select event_id, case event_id % 6 when 0 then 'ABC' || event_id % 7 when 1 then 'XYZ' else 'END' end as result, case event_id % 6 when 0 then 'ABC' || event_id % 7 when 1 then 'XYZ' when 5 then 'Q' else 'END' end as raw, case event_id % 6 when 4 then 'late' when 5 then 'dark' else '' end as reason from events""")
def padded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr(_REPLY)
    fallback = F.lit("first line RESULT: no\nresult : END \n")
    return _t(spark, sf_dir, "events").select("event_id", text.result_text(body, fallback).alias("result"), text.raw_text(body, fallback).alias("raw"), text.failure_reason(body).alias("reason"))


@query("""with x as (select event_id, i, case when (event_id + i) % 4 = 0 then '' else 'T' || event_id % 100 || i end as text, (event_id * (i + 3) % 64) / 64.0::double as score from events, unnest(range(4)) t(i))
select event_id, cast(i as int) as ord, text, round(least(1.0::double, score + [0.05::double, 0.06::double, 0.04::double][i + 1]), 9) as score from x where i < 3 and text <> ''""")
def zipped_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    reading = lambda i: F.struct(F.when((e + i) % 4 == 0, "").otherwise(F.concat(F.lit("T"), (e % 100).cast("string"), F.lit(str(i)))).alias("text"), (e * (i + 3) % 64 / 64.0).alias("score"))
    rows = _t(spark, sf_dir, "events").select("event_id", F.array(*map(reading, range(4))).alias("r"))
    return tokens.zipped_passes(rows, ["event_id"], "r", (0.05, 0.06, 0.04)).select("event_id", "ord", "text", F.round("score", 9).alias("score"))
