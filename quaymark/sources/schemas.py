"""Schemas of the stored tables and the files that are read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _s(ddl: str) -> T.StructType:
    out = T.StructType()
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1)
        out = out.add(name, _KINDS[kind.rstrip("!")], not kind.endswith("!"))
    return out


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "timings": T.MapType(T.StringType(), T.DoubleType())}

HISTORY = _s("id long!, created_at timestamp!, endpoint string!, filename string, raw_text string, normalized_text string, status string!, elapsed_ms double, debug_enabled boolean!")
SUMMARY = _s("created_at string, dataset_dir string, mode string, endpoint string, total_images long, ok_requests long, failed_requests long, not_found_count long, latency_mean_ms double, latency_p95_ms double, labels_available boolean, text_available boolean, label_total long, label_matches long, label_accuracy double, text_total long, text_matches long, text_accuracy double")
RUNS = _s("id long!, created_at timestamp!, dataset_dir string!, mode string!, timeout_sec double!, labels_available boolean!, text_available boolean!").add("summary", SUMMARY, False)
ITEMS = _s("id long!, run_id long!, file_name string!, number_type string, predicted_text string, raw_text string, normalized_predicted string, expected_label string, expected_text string, status_code int, elapsed_ms double, stage_timings timings, error string")
EXTRACT = _s("file string, result string, candidate string, base10 string, check_digit string, status string, raw_text string, ocr_ms double, total_ms double, http_status int")

#: Runs as they are stored: the summary is text.
STORED_RUNS = _s("id long!, created_at string, dataset_dir string, mode string, timeout_sec double, labels_available boolean, text_available boolean, summary_json string")
#: What columns that were added later hold in older files.
ITEM_DEFAULTS = {"number_type": "unknown", "raw_text": "", "stage_timings": None}


def read_table(spark: SparkSession, path: str, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """A stored table in the form of `schema`, whatever forms its files have.

    Columns that a file lacks are null, or what `defaults` says; columns that `schema` lacks are passed over.  A table
    that was never written is empty.  Nulls that were written stay nulls unless their column has a default.
    """
    wide = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    try:
        rows = spark.read.schema(wide).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], wide)
    given = {c: v for c, v in (defaults or {}).items() if v is not None}
    return rows.select(*[F.coalesce(f.name, F.lit(given[f.name]).cast(f.dataType)).alias(f.name) if f.name in given else F.col(f.name) for f in schema])
