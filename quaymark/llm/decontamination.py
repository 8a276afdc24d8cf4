"""Benchmark decontamination by a prefix-filtered set join.

A window is `size` consecutive words of a benchmark item, or the whole item if it is shorter.  A window is the
set of its shingles, SHINGLE consecutive words each (the whole window if it is shorter), and a text can only hold the
window if it holds all of them.  The join goes in three steps over whole texts:

* the benchmark's shingles are counted in all documents, which orders them by rarity; a window with a shingle that no
  document has is out;
* to hold a set as a whole it is necessary to hold the rarest shingle of it: this prefix, one shingle long, is
  what a window is joined by.  Where a document has such a shingle it gives a candidate: the shingle, its position and
  the words around it as far as a window could reach;
* shingle and candidates are joined; a pair must pass the positional bound (the shingle stands `at` words behind
  the window's start, which must lie in the text) and the length bound (the rest of the window must fit behind it), and
  the words of the stretch must then equal the window's.

What is broadcast is a bitmap of shingles of at most 2^27 bits; beyond that it lets more candidates pass, which the join
drops.  Hashes only find candidates: words are compared.  The candidates of a common passage are dealt by Spark (the
windows are the small side, or the join is split where it is skewed), and windows shared by the same items are one.

Defined cases: a null or empty text has no words; an item without words has no window; an item without an id marks words, but
is not listed; of rows with one item_id each is an item text under one id; rows of one doc_id are documents of their own; a
null doc_id stays null; an empty benchmark leaves all clean; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.llm.common import in_bitmap, keep, key_bitmap, released, utf8

SIZE, SHINGLE = 10, 5
#: Bytes that are word characters once A-Z are lower-cased: digits, a-z and all of characters beyond ASCII; others separate words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ** 5) % (1 << 64) | 1) for k in range(SHINGLE)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def shingles_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes (int64) of each run of n word hashes."""
    many = max(0, len(words) - n + 1)
    h = np.full(many, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h += words[k : k + many] * _FACTORS[k]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[list[bytes], np.ndarray]]]]:
    """Slices of the batches with the words of each text and their hashes."""
    hashes = _WordHashes()
    for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
        texts = [words_of(t) for t in utf8(batch.column(column))]
        yield batch, [(w, np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))) for w in texts]


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(window, n, items, shingles): each distinct window once, with the ids of its items and the hashes of its shingles in order."""

    def cut(batches):
        for batch, texts in _hashed(batches, "text"):
            out = {"item": [], "window": [], "n": [], "shingles": []}
            for item, (words, hashes) in zip(batch.column("item").to_pylist(), texts, strict=True):
                n = min(size, len(words))
                sh = shingles_of(hashes, min(SHINGLE, n)) if n else []
                for at in range(len(words) - n + 1 if n else 0):
                    out["item"].append(item)
                    out["window"].append(b" ".join(words[at : at + n]))
                    out["n"].append(n)
                    out["shingles"].append(sh[at : at + max(1, n - SHINGLE + 1)])
            kinds = {"item": pa.string(), "window": pa.binary(), "n": pa.int32(), "shingles": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in out.items()})

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(released(cut), "item string, window binary, n int, shingles array<long>")
    return rows.groupBy("window", "n").agg(F.array_sort(F.collect_set("item")).alias("items"), F.first("shingles").alias("shingles"))


def _bits(spark, keys: DataFrame):
    return spark.sparkContext.broadcast(key_bitmap(keys, 16 * keys.count()))


def rarity(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, count): how often each of the shingles `key`, of the given sizes in words, occurs in all documents; none that does not."""

    def count(batches):
        for _, texts in _hashed(batches, "text"):
            found = [h[in_bitmap(bits.value, h)] for _, words in texts for h in (shingles_of(words, n) for n in sizes)]
            key, many = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "count": pa.array(many, pa.int64())})

    bits = _bits(docs.sparkSession, shingles)
    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(released(count), "key long, count long")
    return seen.groupBy("key").agg(F.sum("count").alias("count")).join(shingles, "key", "left_semi")


def prefixes(docs: DataFrame, found: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, at, window, n, items): the windows that documents may hold, each with its rarest shingle and where that stands in it."""
    shingles = keep(found.select(F.explode("shingles").alias("key")).distinct(), "shingles")
    counts = rarity(docs, shingles, sizes)
    each = found.select("window", "items", "n", F.size("shingles").alias("many"), F.posexplode("shingles").alias("at", "key")).join(counts, "key")
    rarest = each.groupBy("window", "n", "items", "many").agg(F.count("*").alias("present"), F.min(F.struct("count", "key", "at")).alias("first"))
    return rarest.where("present = many").select("first.key", "first.at", "window", "n", "items")


def candidates(docs: DataFrame, keys: DataFrame, sizes: list[int], size: int = SIZE) -> DataFrame:
    """(row, doc_id, n_words, found) of each document; found are (key, pos, before, near): a prefix shingle, the position of its first word, and the words around it with how many of them stand before it."""

    def scan(batches):
        kind = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("near", pa.binary())]))
        for batch, texts in _hashed(batches, "text"):
            found = []
            for words, hashes in texts:
                own = []
                for n in sizes:
                    h = shingles_of(hashes, n)
                    for pos in np.flatnonzero(in_bitmap(bits.value, h)).tolist():
                        reach = size if n == SHINGLE else n  # a shorter shingle is a whole window
                        begin = max(0, pos - reach + n)
                        own.append({"key": int(h[pos]), "pos": pos, "before": pos - begin, "near": b" ".join(words[begin : pos + reach])})
                found.append(own)
            many = pa.array([len(w) for w, _ in texts], pa.int64())
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_words": many, "found": pa.array(found, kind)})

    bits = _bits(docs.sparkSession, keys)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(scan), "row long, doc_id long, n_words long, found array<struct<key: long, pos: int, before: int, near: binary>>")


def occurrences(scanned: DataFrame, prefix: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, start, n, items) of each window that stands in a document; a document with candidates, but no window, has one row of nulls."""
    each = scanned.where(F.size("found") > 0).select("row", "doc_id", "n_words", F.explode("found").alias("c")).select("row", "doc_id", "n_words", "c.*")
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))  # positional and length bound
    stretch = F.array_join(F.slice(F.split(F.col("near").cast("string"), " "), F.greatest(F.lit(1), F.col("before") - F.col("at") + 1), F.col("n")), " ")
    same = (F.col("key") == F.col("k")) & fits & (stretch == F.col("window").cast("string"))
    joined = each.join(prefix.withColumnRenamed("key", "k"), same, "left")
    return joined.select("row", "doc_id", "n_words", start.alias("start"), "n", "items")


def find(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """All documents with their candidates (`candidates`), written, and the windows that they hold (`occurrences`)."""
    found = keep(windows(benchmark, size), "windows")
    sizes = sorted({min(SHINGLE, r["n"]) for r in found.select("n").distinct().collect()})  # at most SHINGLE numbers
    prefix = keep(prefixes(docs, found, sizes or [SHINGLE]), "prefixes")
    scanned = keep(candidates(docs, prefix.select("key").distinct(), sizes or [SHINGLE], size), "candidates")
    return scanned, occurrences(scanned, prefix)


def assess(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    scanned, hits = find(docs, benchmark, size)
    # words that a window adds to what the windows before it in the text have covered
    w = Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    added = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(w), F.lit(0))))
    per_row = hits.withColumn("added", F.coalesce(added, F.lit(0))).groupBy("row", "doc_id", "n_words").agg(F.sum("added").cast("long").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    clean = scanned.where(F.size("found") == 0).select("row", "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return clean.unionByName(per_row).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
