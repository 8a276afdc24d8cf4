"""Driver queries over runs, history, bands, boxes and reports, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.functions import text
from quaymark.operators import bands, boxes, evaluation, history, ranking, retention, routing

QUERIES, SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(owner: str, n: Column) -> Column:
    return F.concat(F.lit(owner), F.lpad((n % 10000000).cast("string"), 7, "0"))


def _items(events: DataFrame) -> DataFrame:
    """Events as test items: the number of the user is the code; errors fail, sign-ups find nothing."""
    found = F.when(F.col("event_type") == "signup", "NOT_FOUND").when(F.col("event_type") == "error", "").otherwise(_code("TCKU", F.col("user_id")))
    return events.select(
        "event_id", "user_id", F.col("event_type").alias("mode"), F.col("value").alias("elapsed_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.when(F.col("event_type") == "error", "HTTP 500").alias("error"), text.normalise(found).alias("normalized_predicted"),
        F.when(F.col("user_id") % 3 == 0, _code("TCKU", F.col("user_id"))).when(F.col("user_id") % 3 == 1, _code("TCKU", F.col("user_id") + 1)).alias("expected_label"), F.when(F.col("user_id") % 5 == 0, _code("TCKU", F.col("user_id"))).alias("expected_text"),
    )


_ITEMS = """i as (select event_id, user_id, event_type as mode, value as elapsed_ms, case when event_type = 'error' then 500 else 200 end as status_code, case when event_type = 'error' then 'HTTP 500' end as error,
  case when event_type = 'signup' then 'NOTFOUND' when event_type = 'error' then '' else 'TCKU' || lpad(cast(user_id % 10000000 as varchar), 7, '0') end as p,
  case user_id % 3 when 0 then 'TCKU' || lpad(cast(user_id % 10000000 as varchar), 7, '0') when 1 then 'TCKU' || lpad(cast((user_id + 1) % 10000000 as varchar), 7, '0') end as el,
  case when user_id % 5 = 0 then 'TCKU' || lpad(cast(user_id % 10000000 as varchar), 7, '0') end as et from events)"""


@query(f"""
with {_ITEMS} select mode, count(*) as total_images, count(*) filter (error is null) as ok_requests, count(*) filter (error is not null) as failed_requests, count(*) filter (error is null and p in ('', 'NOTFOUND')) as not_found_count,
  round(avg(elapsed_ms), 3) as latency_mean_ms, round(quantile_cont(elapsed_ms, 0.95), 3) as latency_p95_ms, count(el) as label_total, count(*) filter (p <> '' and p = el) as label_matches, count(et) as text_total, count(*) filter (p <> '' and p = et) as text_matches,
  round(count(*) filter (p <> '' and p = el)::double / nullif(count(el), 0), 4) as label_accuracy, round(count(*) filter (p <> '' and p = et)::double / nullif(count(et), 0), 4) as text_accuracy from i group by mode""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_summary(_items(_t(spark, sf_dir, "events")), ["mode"])


@query(f"""with {_ITEMS} select mode, round(quantile_cont(elapsed_ms, 0.95), 3) as latency_p95_ms, round(quantile_cont(elapsed_ms, 0.5), 3) as latency_median_ms, count(*) filter (error is null) as success, count(*) filter (error is not null) as failed, count(*) filter (error is null and p in ('', 'NOTFOUND')) as not_found,
  greatest(0, count(*) filter (error is null) - count(*) filter (error is null and p in ('', 'NOTFOUND'))) as done from i group by mode""")
def short_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.short_report(_items(_t(spark, sf_dir, "events")), ["mode"])


@query(f"with {_ITEMS} select event_id, error is not null or (coalesce(et, el, '') <> '' and p <> coalesce(et, el)) as alert from i")
def mismatch_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(_t(spark, sf_dir, "events"))
    return items.select("event_id", evaluation.is_alert(F.col("error"), F.col("status_code"), F.col("expected_text"), F.col("expected_label"), F.col("normalized_predicted")).alias("alert"))


@query("select event_id, user_id, event_type, value from events order by event_id desc limit 500")
def history_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest(_t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), 500, id_col="event_id")


@query("select event_type, count(*) as n, round(avg(value), 3) as mean_ms, round(quantile_cont(value, 0.95), 3) as p95_ms from events group by event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latencies(_t(spark, sf_dir, "events"), ["event_type"], "value")


@query("select d.lang, count(*) as n, count(l.doc_id) as labelled, round(avg(l.quality), 4) as quality, round(avg(l.toxic), 4) as toxic from documents d left join labels l using (doc_id) group by d.lang")
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _t(spark, sf_dir, "labels").withColumn("has", F.col("doc_id"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("has").alias("labelled"), F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic"), 4).alias("toxic"))


@query("""with f as (select *, min(case when event_type = 'purchase' then event_id end) over (partition by user_id) as first from events)
select event_id, user_id, event_type from f where first is null or event_id <= first""")
def first_valid_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ranking.first_valid_stop(rows, ["user_id"], "event_id", F.col("event_type") == "purchase")


@query("select user_id, count(*) as processed, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def last_value_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.last_values(_t(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type", "value"])


@query("""
with p as (select event_type, user_id as pos, count(*) as strength from events group by 1, 2), l as (select *, pos - row_number() over (partition by event_type order by pos) as g from p where strength >= 12)
select event_type, min(pos) as start, max(pos) + 1 as "end", cast(sum(strength) as bigint) as strength from l group by event_type, g""")
def threshold_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = _t(spark, sf_dir, "events").groupBy("event_type", F.col("user_id").alias("pos")).agg(F.count("*").alias("strength"))
    return bands.threshold_runs(profile, ["event_type"], 12)


@query("""
with s as (select user_id, cast(floor(epoch(ts)) as bigint) as start, cast(floor(epoch(ts)) as bigint) + 60 as "end" from events),
o as (select *, case when start - lag("end") over (partition by user_id order by start, "end") <= 3600 then 0 else 1 end as opens from s),
g as (select *, sum(opens) over (partition by user_id order by start, "end" rows unbounded preceding) as grp from o)
select user_id, min(start) as start, max("end") as "end" from g group by user_id, grp""")
def gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = _t(spark, sf_dir, "events").select("user_id", seconds.alias("start"), (seconds + 60).alias("end"))
    return bands.merge_gaps(rows, ["user_id"], 3600)


def _bands_of_users(events: DataFrame) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return events.groupBy("user_id", (day * 10).alias("start")).agg((F.max(day) * 10 + 6).alias("end"), F.count("*").alias("strength"))


@query("""
with b as (select user_id, date_diff('day', date '2024-01-01', cast(ts as date)) * 10 as start, date_diff('day', date '2024-01-01', cast(ts as date)) * 10 + 6 as "end", count(*) as strength from events group by 1, 2, 3),
r as (select *, row_number() over (partition by user_id order by strength desc, "end" - start desc, start) as k from b),
t as (select user_id, list(start order by start) as s, list("end" order by start) as e from r where k <= 2 group by user_id)
select user_id, cast(s[1] as int) as top_start, cast(e[1] as int) as top_end, cast(s[2] as int) as bottom_start, cast(e[2] as int) as bottom_end from t where len(s) = 2 and s[2] - e[1] >= 14""")
def two_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.two_strongest(_bands_of_users(_t(spark, sf_dir, "events")), ["user_id"], 14)


_BOXES = """b as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as ord, l_partkey % 40 as x1, l_suppkey % 40 as y1, l_partkey % 40 + 20 + cast(l_quantity as bigint) as x2, l_suppkey % 40 + 30 + l_linenumber as y2 from lineitem)"""


def _boxes(line: DataFrame) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x, y = F.col("l_partkey") % 40, F.col("l_suppkey") % 40
    rows = line.select(F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("ord"), x.alias("x1"), y.alias("y1"), (x + 20 + F.col("l_quantity").cast("long")).alias("x2"), (y + 30 + F.col("l_linenumber")).alias("y2"))
    return rows.withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))


@query(f"""
with {_BOXES}, r as (select *, (x2 - x1) * (y2 - y1) as area from b), q as (select *, row_number() over (partition by k order by area desc, ord) as rank from r),
j as (select q.*, greatest(0, least(q.x2, f.x2) - greatest(q.x1, f.x1)) * greatest(0, least(q.y2, f.y2) - greatest(q.y1, f.y1)) as inter, f.area as fa from q join q f on q.k = f.k and f.rank = 1),
s as (select *, min(case when rank > 1 and inter / (area + fa - inter)::double < 0.72 then rank end) over (partition by k) as second from j)
select k, cast(ord as int) as ord, cast(rank as int) as rank, area, x1, y1, x2, y2 from s where rank = 1 or rank = second""")
def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.suppress_two(_boxes(_t(spark, sf_dir, "lineitem")), ["k"]).select("k", "ord", "rank", "area", "x1", "y1", "x2", "y2")


@query("""
with f as (select 'run_' || cast(o_orderkey as varchar) || '.html' as name, o_orderkey as run_id, o_orderdate as mtime from orders where o_custkey % 11 <> 0 union all select 'run_' || cast(o_orderkey as varchar) || '.html', null, o_orderdate from orders where o_custkey % 11 = 0)
select name, run_id from f where (run_id is null or run_id not in (select o_orderkey from orders order by o_orderkey desc limit 100)) and mtime < timestamp '1998-01-31' - interval 30 day""")
def retention_delete_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    files = orders.select(F.concat(F.lit("run_"), F.col("o_orderkey").cast("string"), F.lit(".html")).alias("name"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderkey")).alias("run_id"), F.col("o_orderdate").alias("mtime"))
    runs = orders.select(F.col("o_orderkey").alias("id"))
    return retention.delete_set(files, runs, F.lit("1998-01-31").cast("timestamp_ntz"), retention.Retention(30, 100)).select("name", "run_id")


@query("""
with a as (select l_orderkey, sum(l_quantity) as q, sum(cast(l_linenumber as double)) as n, sum(cast(l_suppkey as double)) as s, count(*)::double as c from lineitem group by 1),
u as (select l_orderkey, 0 as stage_ord, 'read_ms' as stage, q as ms from a union all select l_orderkey, 1, 'decode_ms', n from a union all select l_orderkey, 2, 'bbox_ms', 0.0 from a union all select l_orderkey, 3, 'ocr_ms', s from a union all select l_orderkey, 4, 'validation_ms', c from a union all select l_orderkey, 5, 'postprocess_ms', 0.0 from a)
select l_orderkey, cast(stage_ord as int) as stage_ord, stage, cast(ms as double) as ms, cast(sum(ms) over w as double) as bar_end, cast(sum(ms) over w - ms as double) as bar_start from u window w as (partition by l_orderkey order by stage_ord rows unbounded preceding)""")
def stage_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.sum(F.col(c).cast("double"))
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.create_map(F.lit("read_ms"), total("l_quantity"), F.lit("decode_ms"), total("l_linenumber"), F.lit("ocr_ms"), total("l_suppkey"), F.lit("validation_ms"), F.count("*").cast("double")).alias("stage_timings"), F.lit(0.0).alias("elapsed_ms"))
    return evaluation.stage_stack(rows, ["l_orderkey"])


@query("""select p_partkey, case when r <= 0.22 then 'vertical' when r <= 3.0 then 'twolines' when b then 'twolines' when r >= 3.0 then 'oneline' else 'unknown' end as layout
from (select p_partkey, (p_partkey % 97 + 1) / (p_size * 1.0::double) as r, p_partkey % 5 = 0 as b from part)""")
def layout_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", routing.layout(F.col("p_partkey") % 97 + 1, F.col("p_size"), F.col("p_partkey") % 5 == 0).alias("layout"))


@query("""select o_orderkey, o_totalprice + case when o_custkey % 2 = 0 then 1 else 0 end + case when o_custkey % 3 = 0 then 10 else 0 end + case o_orderstatus when 'P' then 2 when 'F' then 4 else 0 end + case when o_custkey % 5 = 0 then 3 else 0 end as rank from orders""")
def result_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "P", "PARTIAL_10").when(F.col("o_orderstatus") == "F", "FULL_11").otherwise("RAW_ONLY")
    return _t(spark, sf_dir, "orders").select("o_orderkey", routing.result_rank(F.col("o_totalprice"), F.when(k % 2 == 0, "text"), F.when(k % 3 == 0, "base"), status, k % 5 == 0).alias("rank"))


@query("""select event_id, json_extract_string(props, '$.k') as k, case when cast(json_extract_string(props, '$.k') as int) % 4 = 0 then 'low contrast' else '' end as reason, round(cast(json_extract_string(props, '$.k') as int) / 8.0::double, 3) as ocr_ms from events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    reason = F.when(k.cast("int") % 4 == 0, "low contrast").otherwise("ok")
    body = F.format_string('{"ocr_debug": {"reason": "%s"}, "timings_ms": {"ocr_ms": "%s", "other": 1}}', reason, (k.cast("int") / 8.0).cast("string"))
    return _t(spark, sf_dir, "events").select("event_id", k.alias("k"), text.failure_reason(body).alias("reason"), F.try_element_at(text.stage_timings(body), F.lit("ocr_ms")).alias("ocr_ms"))


@query("select sha256(text) as content_hash, min(doc_id) as first_path, count(*) as copies from documents group by text")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.deduplicated(_t(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("path")))


@query("""
with i as (select doc_id, case when doc_id % 4 = 0 then 'd' || cast(doc_id as varchar) || '.png' else 'd' || cast(doc_id as varchar) || '.jpg' end as file_name from documents),
n as (select 'd' || cast(doc_id as varchar) || case when doc_id % 4 = 0 then '.png' else '.txt' end as name, quality from labels)
select i.doc_id, i.file_name, coalesce(a.quality, b.quality) as quality from i left join n a on a.name = regexp_replace(i.file_name, '\\.[^.]*$', '') || '.txt' left join n b on b.name = i.file_name""")
def sidecar_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda last: F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".png").otherwise(last))
    images = _t(spark, sf_dir, "documents").select("doc_id", name(".jpg").alias("file_name"))
    notes = _t(spark, sf_dir, "labels").select(name(".txt").alias("name"), "quality")
    return evaluation.match_sidecars(images, notes, "quality", "quality").select("doc_id", "file_name", "quality")


@query("""select event_type, count(*) as n, count(*) filter (s = 'HTTP 500') as http_errors, count(*) filter (s = 'low') as reasons, count(*) filter (s is null) as fine, round(avg(value), 3) as mean_ms
from (select event_type, value, case when user_id % 13 = 0 then 'HTTP 500' when event_type = 'signup' and user_id % 2 = 0 then 'low' end as s from events) group by event_type""")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").withColumn("s", evaluation.request_outcome(F.when(F.col("user_id") % 13 == 0, 500).otherwise(200), F.when(F.col("event_type") == "signup", "NOTFOUND").otherwise("CODE"), F.when(F.col("user_id") % 2 == 0, "low")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("s") == "HTTP 500").alias("http_errors"), F.count_if(F.col("s") == "low").alias("reasons"), F.count_if(F.col("s").isNull()).alias("fine"), F.round(F.avg("value"), 3).alias("mean_ms"))


@query("""with n as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, count(*) over (partition by o_custkey) as n from orders)
select o_custkey, o_orderkey, n <= 40 or i % greatest(1, n // 25) = 0 as labelled from n""")
def thinned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.thinned_labels(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("""
with a as (select user_id, event_id, cast(event_id % 3 as int) as stage, round(value / 500, 6) as score from events),
f as (select *, max(score) over (partition by user_id order by stage, event_id rows between unbounded preceding and 1 preceding) as so_far, max(score) over (partition by user_id order by stage range between unbounded preceding and 1 preceding) as stages from a),
l as (select * from f where coalesce(so_far, -1) < 0.93 and (stage = 0 or coalesce(stages, -1) < [0.83, 0.70][stage])), r as (select *, row_number() over (partition by user_id order by score desc, stage, event_id) as k from l)
select user_id, stage, event_id as ord, score from r where k = 1""")
def eager_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).cast("int").alias("stage"), F.col("event_id").alias("ord"), F.round(F.col("value") / 500, 6).alias("score"))
    return routing.eager_best(rows, ["user_id"])
