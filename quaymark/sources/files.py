"""Readers of image folders, notes, extracts and logs; all by Spark's own sources, so that any store works."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.functions import text
from quaymark.sources import schemas

MAX_FILES, MAX_BYTES = 20, 10 * 1024 * 1024
IMAGE_MIMES = ("image/jpeg", "image/png", "image/webp", "image/bmp")


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, file_name, stem, modificationTime, length) of image files, any case of suffix, in order of path; no content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return rows.where(text.suffix("path").isin(*text.IMAGE_SUFFIXES)).select("path", text.file_name("path").alias("file_name"), text.stem("path").alias("stem"), "modificationTime", "length").orderBy("path")


def images(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, file_name, stem, modificationTime, length, content) of image files, in no order: contents are neither sorted nor moved."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return rows.where(text.suffix("path").isin(*text.IMAGE_SUFFIXES)).select("path", text.file_name("path").alias("file_name"), text.stem("path").alias("stem"), "modificationTime", "length", "content")


def _is_folder(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(path) and fs.getFileStatus(path).isDirectory()


class Dataset(NamedTuple):
    """Images of a dataset folder, and its labels and texts where it has them."""

    images: DataFrame
    labels: DataFrame | None
    texts: DataFrame | None


def dataset(spark: SparkSession, folder: str) -> Dataset:
    """A flat dataset: the images of `folder`/images if there is such a folder, else of `folder`; notes in its folders labels and text.

    Raises FileNotFoundError where the folder is missing or has no images.
    """
    if not _is_folder(spark, folder):
        raise FileNotFoundError(f"dataset folder not found: {folder}")
    found = listing(spark, f"{folder}/images" if _is_folder(spark, f"{folder}/images") else folder, recursive=False)
    if found.isEmpty():
        raise FileNotFoundError(f"no images in the dataset: {folder}")
    side = lambda name: notes(spark, f"{folder}/{name}") if _is_folder(spark, f"{folder}/{name}") else None
    return Dataset(found, side("labels"), side("text"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, content) of whole text files."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def extracts(spark: SparkSession, path: str) -> DataFrame:
    """Result extracts with a header; the mark at the start of a file is Spark's to strip, the schema is given."""
    return spark.read.csv(path, schema=schemas.EXTRACT, header=True, encoding="UTF-8", enforceSchema=True).withColumn("extract", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))


def guard(rows: DataFrame, position: str = "ord") -> DataFrame:
    """Append skip_reason: over the file limit, type not allowed (only where one is given), too large, not decodable."""
    given = F.coalesce("content_type", F.lit("")) != ""
    reason = F.when(F.col(position) >= MAX_FILES, "too_many_files").when(given & ~F.lower("content_type").isin(*IMAGE_MIMES), "unsupported_type").when(F.col("length") > MAX_BYTES, "too_large").when(F.coalesce(F.col("decoded"), F.lit(True)) == False, "not_decodable")  # noqa: E712
    return rows.withColumn("skip_reason", reason)


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """(name, run_id, mtime) of report files, in order of name."""
    from quaymark.operators.retention import run_id_of

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "run_*.html").load(folder)
    return rows.select(text.file_name("path").alias("name"), run_id_of(text.file_name("path")).alias("run_id"), F.col("modificationTime").alias("mtime")).orderBy("name")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a log, or of the files of a log folder in order of name; lines count from 1 through all of them.

    A split of a file knows where it starts and keeps its lines in order.  The lines of each split are counted, the counts are
    summed up over the splits in the order of their places (one row for each split), and a line's number is what lies before
    its split and its place inside.  No lines are sorted or moved.  A log that is not there has no lines.
    """
    try:
        rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "line_no long, value string")
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", "first", before.alias("before"))
    return rows.join(F.broadcast(splits), ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def log_tail(lines: DataFrame, n: int, section: str) -> DataFrame:
    """The last n lines (20 to 5000) of a log (line_no, value), in order, under a section name."""
    n = max(20, min(5000, n))
    return lines.orderBy(F.col("line_no").desc()).limit(n).select(F.lit(section).alias("section"), "line_no", "value").orderBy("line_no")


def log_tails(app: DataFrame, stdout: DataFrame, n: int, source: str = "all") -> DataFrame:
    parts = {"app": log_tail(app, n, "app"), "stdout": log_tail(stdout, n, "stdout")}
    return parts["app"].unionByName(parts["stdout"]) if source == "all" else parts[source]


def debug_meta(body: Column | str) -> Column:
    """Debug metadata as a map; missing or broken JSON gives {available: false}."""
    return F.coalesce(F.from_json(text.col(body), "map<string,string>"), F.create_map(F.lit("available"), F.lit("false")))


def count_line(rows: DataFrame) -> DataFrame:
    """One text line with the number of results, and of those with a code."""
    found = F.count_if(F.coalesce("full_code", F.lit("")) != "")
    return rows.agg(F.format_string("TOTAL\t%d\tfound=%d", F.count("*"), found).alias("value"))


def result_lines(rows: DataFrame) -> DataFrame:
    """One text line for each result: name, code or NOT_FOUND, score to 4 places, validity."""
    return rows.select(F.format_string("%s\t%s\tscore=%.4f\tiso6346=%s", "file_name", F.coalesce(F.nullif("full_code", F.lit("")), F.lit("NOT_FOUND")), "score", F.initcap(F.col("is_valid_iso").cast("string"))).alias("value"))
