"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the distinct hashed words, word pairs and pairs that skip one or two words; each is
present or not, so that a long text is not diluted.  Every coordinate has its own learning rate, and the
L1 term keeps most weights at exactly zero: what is broadcast is the short list of the others, at most
2**`bits`.  The model is fitted on a bounded sample of labelled rows (`max_docs`): `shards` learners each
read a part of it, in a fixed order and several times, and their weights are averaged.

Only the text is an input of a score.  Defined cases: a null or empty text has no features and scores the
bias; of several labels for one document the largest holds, null labels are none; repeated rows score
alike; without labels of both kinds every score is the share of toxic labels (0 without any).  Columns of
the input keep their names, values and order in `filter_documents`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import give_back, held_out, labelled_sample, released, utf8

_STRIP = b".,;:!?()[]{}\"'*#$%&|<>-_"
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Hashes(dict):
    """Word -> 32-bit hash of its lower-case form without punctuation around it; forgets all when it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        w = word.lower().strip(_STRIP)
        h = self[word] = zlib.crc32(w) if w else 0
        return h


class Features:
    """Whole text -> sorted distinct feature numbers below 2**bits; number 0 is the bias."""

    def __init__(self, bits: int) -> None:
        self.hashes, self.shift = _Hashes(), np.uint64(64 - bits)

    def raw(self, text: bytes) -> np.ndarray:
        """Feature numbers with repeats, in no order."""
        words = text.split()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        parts = [(h * _MULTIPLIERS[0]) >> self.shift]
        with np.errstate(over="ignore"):
            for gap in (1, 2, 3):
                if len(h) > gap:
                    parts.append((h[:-gap] * _MULTIPLIERS[0] + h[gap:] * _MULTIPLIERS[gap] + np.uint64(gap)) * _MULTIPLIERS[1] >> self.shift)
        return np.concatenate([np.zeros(1, np.uint64), *parts]).astype(np.int64)

    def of(self, text: bytes) -> np.ndarray:
        return np.unique(self.raw(text))


def packed(x: np.ndarray, bits: int) -> bytes:
    """Sorted numbers below 2**bits in half the room: how many there are for each value of their upper bits, then the lower 16 bits of each."""
    return np.bincount(x >> 16, minlength=1 << max(0, bits - 16)).astype(np.uint32).tobytes() + x.astype(np.uint16).tobytes()


def unpacked(x, bits: int) -> np.ndarray:
    upper = 1 << max(0, bits - 16)
    return (np.repeat(np.arange(upper), np.frombuffer(x, np.uint32, upper)) << 16) + np.frombuffer(x, np.uint16, offset=4 * upper)


class Examples:
    """Examples that are unpacked each time they are read, so that they are held packed."""

    def __init__(self, rows: list[tuple[pa.Buffer, int]], bits: int) -> None:
        self.rows, self.bits = rows, bits

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        return ((unpacked(x, self.bits), y) for x, y in self.rows)


def ftrl(examples: list[tuple[np.ndarray, int]] | Examples, bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 20.0, l2: float = 1.0, passes: int = 3) -> np.ndarray:
    """Dense weights after `passes` over the examples in order; both labels weigh the same in all."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    ys = [y for _, y in examples]
    share = np.clip(np.mean(ys), 0.02, 0.98) if ys else 0.5
    cost = (0.5 / (1 - share), 0.5 / share)
    for _ in range(passes):
        for x, y in examples:
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            p = 1 / (1 + np.exp(-min(max(w.sum(), -35.0), 35.0)))
            g = (p - y) * cost[y]
            more = nx + g * g
            z[x] = zx + g - (np.sqrt(more) - np.sqrt(nx)) / alpha * w
            n[x] = more
    for lo in range(0, len(z), 1 << 16):  # in place and in pieces: no more dense arrays beside these two
        zx, nx = z[lo : lo + (1 << 16)], n[lo : lo + (1 << 16)]
        zx[:] = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
    return z


def train(docs: DataFrame, labels: DataFrame, bits: int = 22, max_docs: int = 16000, shards: int = 2, parts_out: int = 5) -> dict:
    """Fit on at most `max_docs` labelled rows whose id is not held out; the driver gets the non-zero weights."""
    sample = F.broadcast(labelled_sample(docs, labels, "toxic", max_docs, parts_out))

    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = Features(bits)
        for texts in batches:
            yield pa.array([packed(f.of(t), bits) for t in utf8(texts)], pa.binary())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("doc_id", "y", F.arrow_udf(released(features), "binary")("text").alias("x"))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x"))  # one row for each id, so that the bound holds

    def learn(t: pa.Table) -> pa.Table:
        ids, xs, ys = t["doc_id"].to_numpy(), [x.as_buffer() for x in t["x"]], t["y"].to_pylist()  # views: the features lie in memory once
        order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i]))
        examples = Examples([(xs[i], int(ys[i] > 0)) for i in order], bits)
        w = ftrl(examples, bits)
        at = np.flatnonzero(w)
        return pa.table({"at": at.astype(np.int64), "w": w[at], "n": np.full(len(at), len(examples)), "toxic": np.full(len(at), sum(y > 0 for y in ys))})

    def learned(t: pa.Table) -> pa.Table:
        try:
            return learn(t)
        finally:
            give_back()

    found = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).groupBy("shard").applyInArrow(learned, "at long, w double, n long, toxic long")
    got = found.groupBy("at").agg((F.sum("w") / shards).alias("w")).toArrow()  # at most 2**bits rows
    at, w = got["at"].to_numpy(), got["w"].to_numpy()
    order = np.argsort(at)
    return {"bits": bits, "at": at[order].astype(np.uint32), "w": w[order].astype(np.float32)}


def scorer(docs: DataFrame, model: dict):
    """A column function text -> probability that the text is toxic, by a broadcast of the sparse weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        f = Features(m["bits"])
        live = np.zeros(1 << m["bits"], np.float32)
        live[m["at"]] = m["w"]
        for texts in batches:
            out = []
            for t in utf8(texts):
                x = f.raw(t)
                x = x[live[x] != 0]  # a few: only these are made distinct
                s = float(live[np.unique(x)].sum(dtype=np.float64)) if len(m["at"]) else -35.0
                out.append(1 / (1 + np.exp(-min(max(s, -35.0), 35.0))))
            yield pa.array(out, pa.float64())

    return F.arrow_udf(released(score), "double").asNondeterministic()  # else the optimiser may run it once more for a filter


def assess(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    score = scorer(docs, train(docs, labels, **params))
    out = docs.select("doc_id", held_out(F.col("doc_id"), params.get("parts_out", 5)).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **params) -> DataFrame:
    """The rows that score below the threshold, with the columns they came with."""
    score = scorer(docs, train(docs, labels, **params))
    name = "__toxic"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, score("text")).where(F.col(name) < threshold).drop(name)
