"""The append-only history of recognised numbers and the runs of a test bench."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators import evaluation
from quaymark.operators.ranking import numbered
from quaymark.sources import schemas


def newest(rows: DataFrame, n: int, lo: int = 1, hi: int = 5000, id_col: str = "id") -> DataFrame:
    """The n newest rows, with n held between lo and hi."""
    return rows.orderBy(F.col(id_col).desc()).limit(max(lo, min(hi, n)))


def history(rows: DataFrame, endpoint: str | None = None, n: int = 500) -> DataFrame:
    rows = rows.where(F.col("endpoint") == endpoint) if endpoint else rows
    return newest(rows, n)


def append_history(rows: DataFrame, path: str) -> None:
    rows.select(*schemas.HISTORY.fieldNames()).write.mode("append").parquet(path)


def runs_with_reports(runs: DataFrame, reports: DataFrame, n: int = 50) -> DataFrame:
    """The newest runs with whether a report exists."""
    have = reports.where("run_id is not null").select(F.col("run_id").alias("__id")).distinct()
    return newest(runs, n, hi=200).join(have, F.col("id") == F.col("__id"), "left").withColumn("has_report", F.col("__id").isNotNull()).drop("__id")


def run_with_items(runs: DataFrame, items: DataFrame, run_id: int) -> DataFrame:
    """One run with its items in order of id; missing timings are an empty map."""
    fields = [c for c in items.columns if c not in ("run_id", "stage_timings")]
    item = F.struct(*fields, F.coalesce("stage_timings", F.create_map().cast("map<string,double>")).alias("stage_timings"))
    nested = items.where(F.col("run_id") == run_id).groupBy("run_id").agg(F.array_agg(F.struct("id", item.alias("item"))).alias("raw"))
    nested = nested.select("run_id", F.transform(F.array_sort("raw", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)), lambda x: x["item"]).alias("items"))
    return runs.where(F.col("id") == run_id).join(nested, F.col("id") == F.col("run_id"), "left").drop("run_id")


def with_ids(rows: DataFrame, first: int, order: str) -> DataFrame:
    """Number the rows of an append from `first` on, in the order of `order`."""
    return numbered(rows, order, "id", first)


def write_run(header: DataFrame, items: DataFrame, path: str) -> None:
    """Items first, the header last: the header commits the run, and a run without one was not finished."""
    items.write.mode("append").parquet(f"{path}/test_items")
    header.write.mode("append").parquet(f"{path}/test_runs")


def runs_at(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, items) of the runs that were finished; items of a run without a header are not seen.

    Files of older schemas are read too (see `schemas.read_table`).
    """
    headers = schemas.read_table(spark, f"{path}/test_runs", schemas.STORED_RUNS)
    items = schemas.read_table(spark, f"{path}/test_items", schemas.ITEMS, schemas.ITEM_DEFAULTS)
    return headers, items.join(headers.select(F.col("id").alias("run_id")), "run_id", "left_semi").select(*schemas.ITEMS.fieldNames())


def next_ids(spark: SparkSession, path: str) -> tuple[int, int]:
    """The next id of a run and of an item: behind all that were ever written, finished or not, so that leftovers are never taken up."""
    headers, items = schemas.read_table(spark, f"{path}/test_runs", schemas.STORED_RUNS), schemas.read_table(spark, f"{path}/test_items", schemas.ITEMS)
    top = lambda df, c: df.agg(F.max(c)).first()[0] or 0
    return max(top(headers, "id"), top(items, "run_id")) + 1, top(items, "id") + 1


def store_run(items: DataFrame, header: dict, path: str, order: str = "file_name") -> int:
    """Append one run: items get ids in the order of `order`, the summary is counted from them.  Returns the run's id."""
    spark = items.sparkSession
    run_id, first = next_ids(spark, path)
    given = items.drop("id", "run_id").withColumn("run_id", F.lit(run_id).cast("long"))
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schemas.ITEMS if f.name not in (*given.columns, "id")}
    rows = with_ids(given.withColumns(missing) if missing else given, first, order)
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.ITEMS])
    facts = {"created_at": None, "dataset_dir": "", "mode": "container", "timeout_sec": 120.0, "labels_available": False, "text_available": False} | header
    counted = evaluation.run_summary(given, ["run_id"])
    summary = summary_json(counted, {k: F.lit(v) for k, v in facts.items() if k not in ("timeout_sec",)})
    columns = [F.lit(v).cast(schemas.STORED_RUNS[k].dataType).alias(k) for k, v in facts.items()]
    write_run(counted.select(F.col("run_id").alias("id"), *columns, summary.alias("summary_json")), rows, path)
    return run_id


def summary_json(counts: DataFrame, facts: dict) -> Column:
    """The nested summary of a run as JSON text, all fields in their order, null ones too; `facts` fill what is not counted."""
    value = lambda f: F.col(f.name) if f.name in counts.columns else facts.get(f.name, F.lit(None))
    return F.to_json(F.struct(*[value(f).cast(f.dataType).alias(f.name) for f in schemas.SUMMARY]), {"ignoreNullFields": "false"})


def parsed_summaries(runs: DataFrame, body: str = "summary_json") -> DataFrame:
    """Stored runs with `summary` as a struct and whether it could be read; text that is no JSON object gives a null summary.

    Fields of a wrong kind are null, further fields are passed over.
    """
    is_object = F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT")
    fields = F.struct(*[F.get_json_object(body, f"$.{f.name}").try_cast(f.dataType).alias(f.name) for f in schemas.SUMMARY])
    ok = F.coalesce(is_object, F.lit(False))
    return runs.withColumn("summary_ok", ok).withColumn("summary", F.when(ok, fields)).drop(body)


def last_snapshot(rows: DataFrame, order: str, path: str) -> None:
    """Overwrite the snapshot with the last row."""
    rows.groupBy().agg(F.max_by(F.struct(*rows.columns), order).alias("s")).select("s.*").write.mode("overwrite").parquet(path)


def snapshot_meta(extra: Column, segmentation: Column) -> Column:
    """Debug metadata of a snapshot: what the request gave, overlaid by what the segmentation found; both are maps and may be null."""
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(extra, none), lambda k, v: ~F.map_contains_key(F.coalesce(segmentation, none), k))
    return F.map_concat(kept, F.coalesce(segmentation, none))


def wants_snapshot(result: Column, save_on_not_found: bool = True) -> Column:
    """Is a debug snapshot to be kept: of all results, or of those that were found."""
    return F.lit(save_on_not_found) | (F.coalesce(result, F.lit("NOT_FOUND")) != "NOT_FOUND")


def deduplicated(images: DataFrame) -> DataFrame:
    """(content_hash, first_path, copies): each content once, so that it is recognised once."""
    return images.groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.min("path").alias("first_path"), F.count("*").alias("copies"))
