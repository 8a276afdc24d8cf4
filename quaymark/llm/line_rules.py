"""Quality rules by line sequence labelling.

A linear-chain conditional random field reads the lines of a document in order and marks each as content
or boilerplate; Viterbi decoding finds the likeliest labels, and the share of words on content lines
decides whether the document stays.  The field is fitted on a bounded sample of documents with a quality
label (`max_docs`): every line of a document takes the label of its document, and the conditional
likelihood of whole label sequences is maximised, so that isolated lines of the other kind are noise
that the fit averages out.

Defined cases: a null or empty text has no words, so it fails the base rules; texts of any length are read
whole; repeated rows are judged one by one, alike; without labels of both kinds no line is boilerplate and
the base rules alone decide.  Columns of the input keep their names, values and order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import labelled_sample, released, utf8

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_CONT = bytes(range(0x80, 0xC0))
_UPPER, _DIGIT, _STOP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b",.;:?"
#: Upper bounds of the buckets of each real-valued line feature; a line has one bucket of each.
BUCKETS = {
    "words": (0, 2, 5, 10, 25, 60, 150),
    "upper": (0.0, 0.03, 0.1, 0.3, 0.6),
    "symbols": (0.0, 0.05, 0.2, 0.6),
    "exclaims": (0.0, 0.05, 0.3),
    "digits": (0.0, 0.02, 0.1, 0.3),
    "stops": (0.0, 0.05, 0.12, 0.25),
    "word_length": (2.5, 4.0, 6.0, 9.0, 14.0),
    "distinct": (0.3, 0.6, 0.85, 0.99),
    "repeated": (0.0, 0.2, 0.5),
    "copy": (0,),
    "end": (0, 1),
}
_SIZES = [len(v) + 1 for v in BUCKETS.values()]
_AT = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
N_FEATURES = int(sum(_SIZES))
_EDGES = [np.array(v, dtype=float) for v in BUCKETS.values()]


class Reader:
    """Counts and line features of whole texts; word numbers are kept between texts while there are few."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)

    def repeated(self, words: list[bytes]) -> np.ndarray | None:
        """Mask of the words inside a 3-word window that the text has twice or more; None: there is none."""
        if len(words) < 4:
            return None
        if len(self.ids) > 1_000_000:
            self.ids = defaultdict(count().__next__)
        w = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) < 1 << 21:
            tri = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
        else:
            tri = np.unique(np.stack([w[:-2], w[1:-1], w[2:]]), axis=1, return_inverse=True)[1].ravel()
        s = np.sort(tri)
        twice = s[1:][s[1:] == s[:-1]]
        if not len(twice):
            return None
        hit, out = np.isin(tri, twice), np.zeros(len(w), bool)
        for k in range(3):
            out[k : len(w) - 2 + k] |= hit
        return out

    def read(self, text: bytes) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
        """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); words of each line that has some; their feature rows."""
        words = text.split()
        mask = self.repeated(words)
        before = np.concatenate([[0], np.cumsum(mask)]) if mask is not None else None
        seen: set[bytes] = set()
        rows, at, dups = [], 0, 0
        for line in text.split(b"\n"):
            own = line.split()
            if not own:
                continue
            n, size = len(own), len(line)
            if line in seen:
                dups, copy = dups + 1, 1
            else:
                seen.add(line)
                copy = 0
            last = own[-1][-1:]
            rows.append((
                n, (size - len(line.translate(None, _UPPER))) / size, (size - len(line.translate(None, SYMBOLS))) / n, line.count(b"!") / n, (size - len(line.translate(None, _DIGIT))) / size,
                (size - len(line.translate(None, _STOP))) / n, len(line.translate(None, _SPACE + _CONT)) / n, len(set(own)) / n, (before[at + n] - before[at]) / n if before is not None else 0.0, copy, 2 if last in b".?" else 1 if last in b"!,;:|" else 0,
            ))
            at += n
        base = (len(words), len(text.translate(None, _SPACE + _CONT)), len(text) - len(text.translate(None, SYMBOLS)), dups, int(mask.sum()) if mask is not None else 0)
        x = np.array(rows, dtype=float).reshape(-1, len(_EDGES))
        at_words = x[:, 0].astype(np.int64)
        features = np.stack([np.searchsorted(e, x[:, k]) + _AT[k] for k, e in enumerate(_EDGES)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(_EDGES)), np.uint8)
        return base, at_words, features


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The likeliest labels (0 boilerplate, 1 content) of one sequence; ties go to content."""
    n = len(emit)
    if not n:
        return np.zeros(0, np.int8)
    e, (t00, t01), (t10, t11) = emit.tolist(), trans[0].tolist(), trans[1].tolist()
    back, (a, b) = [], e[0]
    for x, y in e[1:]:
        p, q = (0, 1) if a + t00 > b + t10 else (1, 1)
        q = 0 if a + t01 > b + t11 else 1
        back.append((p, q))
        a, b = (a + t00 if p == 0 else b + t10) + x, (a + t01 if q == 0 else b + t11) + y
    out = [0 if a > b else 1]
    for step in reversed(back):
        out.append(step[out[-1]])
    return np.array(out[::-1], np.int8)


def fit(sequences: list[tuple[np.ndarray, int]], rounds: int = 120, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Maximum conditional likelihood of label sequences, by forward-backward and Adam; (weights [2, features], transitions [2, 2]).

    `sequences`: feature rows of a document and its label.  Documents are walked side by side, longest first.
    """
    sequences = sorted((s for s in sequences if len(s[0])), key=lambda s: -len(s[0]))
    w, t = np.zeros((2, N_FEATURES)), np.zeros((2, 2))
    if len({y for _, y in sequences}) < 2:
        w[1] = 1.0
        return w, t
    sizes = np.array([len(x) for x, _ in sequences])
    y = np.array([y for _, y in sequences])
    # position-major layout: the rows of step k are those of the first alive[k] documents
    alive = np.array([(sizes > k).sum() for k in range(sizes[0])])
    start = np.concatenate([[0], np.cumsum(alive)])
    rows = np.concatenate([np.stack([sequences[d][0][k] for d in range(m)]) for k, m in enumerate(alive)]).astype(np.int64)
    gold = np.concatenate([y[:m] for m in alive])
    share = np.array([(y == k).mean() for k in (0, 1)])
    weight = (0.5 / share)[y]  # both labels weigh the same
    row_weight = np.concatenate([weight[:m] for m in alive])
    m1, m2 = np.zeros(w.size + 4), np.zeros(w.size + 4)
    for step in range(1, rounds + 1):
        emit = w[:, rows].sum(axis=2).T
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[: alive[0]] = emit[: alive[0]]
        for k in range(1, len(alive)):
            prev = alpha[start[k - 1] : start[k - 1] + alive[k]]
            alpha[start[k] : start[k + 1]] = np.logaddexp(prev[:, :1] + t[0], prev[:, 1:] + t[1]) + emit[start[k] : start[k + 1]]
        pair = np.zeros((2, 2))
        z = np.empty(len(sizes))
        for k in range(len(alive) - 1, -1, -1):
            here = slice(start[k], start[k + 1])
            m = alive[k + 1] if k + 1 < len(alive) else 0
            if m:
                nxt = emit[start[k + 1] : start[k + 2]] + beta[start[k + 1] : start[k + 2]]
                beta[start[k] : start[k] + m] = np.logaddexp(nxt[:, :1] + t[:, 0], nxt[:, 1:] + t[:, 1])
            if k == 0:
                z = np.logaddexp(*(alpha[here] + beta[here]).T)
        for k in range(len(alive) - 1):
            m = alive[k + 1]
            nxt = emit[start[k + 1] : start[k + 2]] + beta[start[k + 1] : start[k + 2]]
            p = np.exp(alpha[start[k] : start[k] + m, :, None] + t[None] + nxt[:, None, :] - z[:m, None, None])
            pair += (p * weight[:m, None, None]).sum(axis=0)
        doc = np.concatenate([np.arange(m) for m in alive])
        post = np.exp(alpha + beta - z[doc, None])
        grad_w, grad_t = np.zeros_like(w), -pair
        for label in (0, 1):
            left = row_weight * ((gold == label) - post[:, label])
            grad_w[label] = np.bincount(rows.ravel(), np.repeat(left, rows.shape[1]), N_FEATURES)
        for label in (0, 1):
            grad_t[label, label] += (weight * (sizes - 1))[y == label].sum()
        g = (np.concatenate([grad_w.ravel(), grad_t.ravel()]) - l2 * np.concatenate([w.ravel(), t.ravel()])) / len(sizes)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w += move[: w.size].reshape(w.shape)
        t += move[w.size :].reshape(2, 2)
    return w, t


def _line_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        reader = Reader()
        yield pa.array([reader.read(x)[2].tobytes() for x in utf8(texts)], pa.binary())


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Fit the field on at most `max_docs` labelled documents, in one task; only the weights come to the driver."""
    sample = F.broadcast(labelled_sample(docs, labels, "quality", max_docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("doc_id", "y", F.arrow_udf(released(_line_features), "binary")("text").alias("x"))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x"))  # one row for each id, so that the bound holds

    def fit_group(t: pa.Table) -> pa.Table:
        order = np.argsort(t["doc_id"].to_numpy())
        xs, ys = t["x"].to_pylist(), t["y"].to_pylist()
        w, tr = fit([(np.frombuffer(xs[i], np.uint8).reshape(-1, len(_EDGES)), int(ys[i] > 0)) for i in order])
        return pa.table({"w": [np.concatenate([w.ravel(), tr.ravel()]).tolist()]})

    found = rows.groupBy(F.lit(0).alias("one")).applyInArrow(fit_group, "w array<double>").collect()
    if not found:
        w = np.zeros((2, N_FEATURES))
        w[1] = 1.0
        return w, np.zeros((2, 2))
    flat = np.array(found[0]["w"])
    return flat[:-4].reshape(2, N_FEATURES), flat[-4:].reshape(2, 2)


def quality(model: tuple[np.ndarray, np.ndarray], min_share: float = 0.5, min_words: int = 50, max_repeat: int = 50):
    """A column function text -> struct of counts, line labels' summary and verdict."""
    w, t = model

    @F.arrow_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_content_lines long, content_words long, base_failed boolean, kept boolean")
    def judge(texts: pa.Array) -> pa.Array:
        reader, out = Reader(), []
        for text in utf8(texts):
            base, sizes, x = reader.read(text)
            labels = viterbi(w[:, x.astype(np.int64)].sum(axis=2).T, t)
            content = int(sizes[labels == 1].sum())
            failed = base[0] < min_words or 100 * base[4] > max_repeat * base[0]
            out.append((*base, len(labels), int(labels.sum()), content, failed, not failed and content >= min_share * base[0]))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines", "content_words", "base_failed", "kept"]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    return judge.asNondeterministic()  # else the optimiser may run it once more for a filter


def assess(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """One row for each document: doc_id, the counts, the base verdict and the verdict."""
    judge = quality(train(docs, labels), **params)
    return docs.select("doc_id", judge("text").alias("__q")).select("doc_id", "__q.*")


def filter_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows that stay, with the columns they came with."""
    judge = quality(train(docs, labels), **params)
    name = "__verdict"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, judge("text")).where(F.col(name)["kept"]).drop(name)
