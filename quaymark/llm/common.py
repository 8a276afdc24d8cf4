"""Small helpers shared by the operators: tables, shared scratch storage, ranks inside groups."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.sources.scratch import delete_at_end, keep, scratch_path, shared_dir  # noqa: F401
from quaymark.sources.scratch import file_of as _file

#: Java regex of one word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(*kept: DataFrame) -> None:
    """Delete what `keep` wrote, once no plan reads it any more."""
    for df in kept:
        p, fs = _file(df.sparkSession, df.kept_at)
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)


def discard_part(kept: DataFrame, part: str) -> None:
    """Delete one part, such as `level=1`, of what `keep` divided, once no plan reads it any more; readers of other parts must filter by the column."""
    p, fs = _file(kept.sparkSession, f"{kept.kept_at}/{part}")
    fs.delete(p, True)


def collect_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so when the driver collects its garbage."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back(cycles: bool = True) -> None:
    """Give freed memory back to the system; `cycles`: look for objects that only hold each other, which takes longer."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it keeps the memory
        ctypes.CDLL(None).malloc_trim(0)


def released(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for `mapInArrow` or an iterator UDF, which gives the memory it held back to the system when a task ends: workers live on."""

    @functools.wraps(batches)
    def run(rows):
        try:
            yield from batches(rows)
        finally:
            give_back()

    return run


def key_bitmap(keys: DataFrame, n: int, most: int = 1 << 27) -> np.ndarray:
    """Bitmap of the long column `key`, of 16 bits for each of `n` keys or `most` in all; it has no false misses."""
    size = min(most, max(1 << 15, 1 << (16 * n).bit_length()))
    at = F.pmod("key", F.lit(size))
    out = np.zeros((size >> 15, 1 << 12), np.uint8)
    found = keys.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("at") % (1 << 15)).alias("bits")).toArrow()
    for b, bits in zip(found["b"].to_pylist(), found["bits"].to_pylist(), strict=True):  # at most `most` bits in all
        out[b] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def utf8(texts: pa.Array) -> list[bytes]:
    """The rows of a string column as UTF-8 bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    to = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(to).to_pylist()]


def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, buckets: int = 64) -> DataFrame:
    """Append `out`: the sum of `value` over the rows of the same group that come before this one.

    The order inside a group is that of (hash bucket of `order`, `order`), so it is pseudorandom but
    fixed.  A group is dealt over `buckets` tasks, so that no task holds more than that share of a hot
    group; what one window sees of a whole group is one row for each bucket.  Rows that agree in all of
    `order` are interchangeable.
    """
    b, v, before = f"__{out}_bucket", f"__{out}_value", f"__{out}_before"
    null_safe = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in order]
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*null_safe), F.lit(buckets)).cast("int")).withColumn(v, value.cast("long"))
    totals = dealt.groupBy(*group, b).agg(F.sum(v).alias(before))
    w = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(before, F.coalesce(F.sum(before).over(w), F.lit(0)))
    totals = totals.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*group, b])], before)
    inside = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn(out, F.coalesce(F.sum(v).over(inside), F.lit(0)))
    same = F.lit(True)
    for i, c in enumerate([*group, b]):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    joined = dealt.join(totals, same, "left")
    return joined.withColumn(out, F.col(out) + F.col(before)).drop(b, v, before, *[f"__k{i}" for i in range(len(group) + 1)])


def held_out(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text is divisible by `parts`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep_out: int = 0) -> DataFrame:
    """(doc_id, y) of at most `rows` labelled documents of `docs`, in an order fixed by a hash of the id.

    Null labels are no labels; of several labels for one document the largest holds.  `keep_out`: leave
    out the ids that `held_out` names.  The bound makes the result safe to broadcast.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if keep_out:
        ids = ids.where(~held_out(F.col("doc_id"), keep_out))
    ids = ids.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return ids.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
