"""Language-model scoring by a probabilistic suffix tree.

Symbols are words (ASCII lower case) and one end for each document.  Contexts are runs of up to `DEPTH` words; a
context is a candidate if it comes at least `MIN_CONTEXT` times, and it is retained if the distribution behind it
diverges from that of its longest retained suffix by more than the entries it needs would cost (a minimum
description length test).  The next-symbol distribution of a retained context keeps the symbols seen behind it at
least `MIN_ENTRY` times, discounted, and gives what is left to its suffix; the root is the smoothed distribution of
single words.  A token is scored from the longest retained context that it follows.

Texts are read and cut into words once: what is kept is, for some documents at a time, the 63-bit hashes of their words
and the texts as numbers into these.
Counts grow by levels.  A string of words is counted only if, without its last word, it comes often enough to be a
context and, without its first word, often enough to be an entry; both are looked up in bitmaps of the level before,
where a false hit costs a row and changes no result.  Tasks send strings, counts and contexts in one pass, packed by
parts of the hash space, and each part is summed by itself; a frequent string is one row from each task, and the entries
of a frequent context are dealt over all parts, so that no part is hot.  Counts, test and tree are tables, and their
thresholds are small absolute counts, so that they grow with the corpus.

Broadcast are bitmaps of at most `BITS` bits, at most 1 / P_WORD words and at most `HEAD` contexts and entries, the
most frequent ones; the last two are caches.  What is not in them is asked for: some documents at a time name the keys
that they lack, each once, and get the values by parts of the hash space.  Strings are named by 63-bit hashes.

Defined cases: a null or empty text is one end; a null doc_id is never held out; texts of any length are
read whole; repeated rows are documents of their own; without training documents every token has
probability 1 at the root, as the formula says; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import collect_shuffles, discard, discard_part, give_back, held_out, in_bitmap, keep, key_bitmap, released, utf8

P_WORD, MIN_CONTEXT, MIN_ENTRY, DISCOUNT = 1e-6, 8, 2, 0.5
#: Words of a context at most.
DEPTH = 5
#: Contexts and entries that are broadcast at most; bits of a bitmap at most; tokens of the corpus for each part.
HEAD, BITS, PART = 4_000_000, 1 << 26, 2_000_000
#: From this level on all levels are counted at once: few strings are left.
TOGETHER = 3
#: Symbols of a row of packed documents, but for longer texts; lots in which packed documents are scored, one after another.
PIECE, LOTS = 1 << 18, 4


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


#: No word is empty: this names the end.
END = word_hash(b"")


class _Numbers(dict):
    """Word -> its number in `hashes`; 0 is the end, 1 parts documents."""

    def __init__(self):
        super().__init__()
        self.hashes = [END, -1]

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.hashes)
        self.hashes.append(word_hash(word))
        return at


class _Piece:
    """Documents behind each other, as numbers of their words."""

    def __init__(self):
        self.symbols, self.ids, self.n, self.size = [], [], [], 0

    def add(self, doc_id, text: bytes, numbers: _Numbers) -> None:
        words = text.lower().split()
        at = np.zeros(len(words) + 2, np.int32)
        at[:-2] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        at[-1] = 1
        self.symbols.append(at)
        self.ids.append(doc_id)
        self.n.append(len(words) + 1)
        self.size += len(at)

    def packed(self, numbers: _Numbers) -> tuple[int, bytes]:
        """How many different symbols there are; their hashes and, as numbers into these, the symbols."""
        symbols = np.concatenate(self.symbols)
        seen = np.zeros(len(numbers.hashes), bool)
        seen[symbols] = True
        used = np.flatnonzero(seen)
        number = np.cumsum(seen, dtype=np.int32) - 1
        hashes = np.fromiter(map(numbers.hashes.__getitem__, used.tolist()), np.int64, len(used))
        number = number[symbols]
        # by frequency, so that numbers are small, and by hash among equally frequent ones, so that distances are
        order = np.lexsort((hashes, -np.bincount(number, minlength=len(used))))
        rank = np.empty(len(used), np.uint32)
        rank[order] = np.arange(len(used), dtype=np.uint32)
        return len(used), pa.compress(_planes(np.diff(hashes[order], prepend=0)) + _planes(rank[number]), codec="zstd", asbytes=True)


def tokenised(docs: DataFrame, out_of: int | None = None) -> DataFrame:
    """One row for some documents of equal `held`: piece, held, ids, n (symbols of each), symbols, distinct, size, tokens (packed), lot.  Kept as a table, divided by lot.

    `held`: whether the ids are held out, one in `out_of`; never without it.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def read(batches):
        numbers, first, done = _Numbers(), TaskContext.get().partitionId() << 32, 0
        own = {held: _Piece() for held in (False, True)}

        def row(held):
            nonlocal done
            p, own[held] = own[held], _Piece()
            done += 1
            distinct, tokens = p.packed(numbers)
            cols = {"piece": pa.array([first + done]), "held": pa.array([held]), "ids": pa.array([p.ids], pa.list_(ids.type)), "n": pa.array([p.n], pa.list_(pa.int64())), "symbols": pa.array([sum(p.n)]), "distinct": pa.array([distinct]), "size": pa.array([p.size]), "tokens": pa.array([tokens], pa.binary()), "lot": pa.array([(done + (first >> 32)) % LOTS], pa.int32())}
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, batch.num_rows, 64):
                for i, t, held in zip(ids.slice(lo, 64).to_pylist(), utf8(batch.column(1).slice(lo, 64)), batch.column(2).slice(lo, 64).to_pylist(), strict=True):
                    own[held].add(i, t, numbers)
                    if own[held].size >= PIECE:
                        yield row(held)
                if len(numbers) > 300_000:  # forget all words; what is held has their numbers
                    yield from [row(held) for held in own if own[held].n]
                    numbers = _Numbers()
        yield from [row(held) for held in own if own[held].n]

    held = held_out(F.col("doc_id"), out_of) if out_of else F.lit(False)
    rows = docs.select("doc_id", "text", held.alias("held")).mapInArrow(released(read), f"piece long, held boolean, ids array<{id_type}>, n array<long>, symbols long, distinct long, size long, tokens binary, lot int")
    return keep(rows, "lm-tokens", "none", by="lot")


def _unpacked(tokens: bytes, distinct: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, numbers of the symbols) of a piece; hash -1 is behind each document."""
    raw = pa.decompress(tokens, 8 * distinct + 4 * size, codec="zstd", asbytes=True)
    return np.cumsum(_from_planes(raw[: 8 * distinct])), _from_planes(raw[8 * distinct :], np.int32)


def _pieces(batch: pa.RecordBatch):
    for distinct, size, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        yield _unpacked(tokens.as_py(), distinct, size)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """63-bit hashes of pairs."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(32)) >> np.uint64(1)).astype(np.int64)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in the sorted array and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _walk(hashes: np.ndarray, symbols: np.ndarray, filters: list, beyond: int = 0):
    """For each level k the contexts of k words that are followed by a symbol, and the strings of k + 1 words that may be their entries.

    `hashes`: what the numbers `symbols` stand for, -1 between documents.  `filters[k - 1]`: bitmaps of the strings of k words
    that come often enough for entries and for contexts; `beyond`: levels after these, where all is let through whose shorter
    strings were.  Yields (places of the symbols behind contexts, contexts; places of the entries' last symbols, entries, their
    contexts, the suffixes of these, 0 for single words).  A string is named by the hash of the string without its last word and
    of that word.
    """
    if not filters:
        return
    h = np.append(hashes[symbols], -1)
    at = np.flatnonzero((in_bitmap(filters[0][0], hashes) & (hashes >= 0))[symbols])
    v, below = h[at], np.zeros(len(at), np.int64)
    for k in range(1, len(filters) + beyond + 1):
        if k > len(filters):
            is_context = np.ones(len(at), bool)
        elif filters[k - 1][1] is None:
            return
        else:
            is_context = in_bitmap(filters[0][1], hashes)[symbols[at]] if k == 1 else in_bitmap(filters[k - 1][1], v)
        is_context &= h[at + 1] >= 0
        i = np.flatnonzero(is_context[:-1] & (at[1:] == at[:-1] + 1)) if len(at) else at
        pos, of, suffix, last = at[i + 1], v[i], below[i], v[i + 1]
        key = _mix(of, h[pos])
        if k < len(filters):
            hit = in_bitmap(filters[k][0], key)
            pos, key, of, suffix, last = pos[hit], key[hit], of[hit], suffix[hit], last[hit]
        yield at[is_context] + 1, v[is_context], pos, key, of, suffix
        if not len(key):
            return
        at, v, below = pos, key, last


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _different(keys: np.ndarray) -> np.ndarray:
    """The different keys, ascending (`np.unique` goes by a hash table, which takes longer)."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hash space that each key lies in."""
    return (keys >> 32) * parts >> 31


def _cuts(sorted_parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of the parts that occur."""
    starts = np.flatnonzero(np.diff(sorted_parts, prepend=-1))
    return list(zip(sorted_parts[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_parts)], strict=True)) if len(starts) else []


def _by_part(batches, keys: int, columns: int):
    """(the keys, the columns as lists of bytes) of the rows of equal keys; `batches` are sorted by these."""
    at, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in range(keys + columns)], strict=True):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], [[] for _ in range(columns)]
            for h, x in zip(held, row[keys:], strict=True):
                h.append(x)
    if held:
        yield at, held


def _joined(chunks: list[bytes], kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(chunks), kind)


def _planes(a: np.ndarray) -> bytes:
    """Numbers by bytes of equal rank, which compresses better."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _from_planes(x: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, by their distances."""
    return _planes(np.diff(keys, prepend=0))


def _unpacked_keys(x: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(x))


def _packed_answers(values: np.ndarray, there: np.ndarray) -> bytes:
    """A bit for each, and those values that are there."""
    return np.packbits(there).tobytes() + _planes(values[there])


def _unpacked_answers(x: bytes, n: int) -> np.ndarray:
    """The `n` values, NaN for those that are not there."""
    bits = -(-n // 8)
    out = np.full(n, np.nan)
    out[np.unpackbits(np.frombuffer(x, np.uint8, bits), count=n).astype(bool)] = _from_planes(x[bits:], np.float64)
    return out


def word_counts(train: DataFrame, parts: int) -> DataFrame:
    """(key, c) of all words."""

    def count(batches):
        keys, counts, size = [], [], 0

        def packed():
            k, n = _summed(np.concatenate(keys), np.concatenate(counts))
            cuts = _cuts(_part(k, parts))
            return pa.RecordBatch.from_pydict({"part": pa.array([p for p, _, _ in cuts], pa.int64()), "keys": pa.array([k[lo:hi].tobytes() for _, lo, hi in cuts], pa.binary()), "counts": pa.array([n[lo:hi].astype(np.int32).tobytes() for _, lo, hi in cuts], pa.binary())})

        for batch in batches:
            for hashes, at in _pieces(batch):
                n = np.bincount(at, minlength=len(hashes))
                n[hashes < 0] = 0
                keys.append(hashes[n > 0])
                counts.append(n[n > 0])
                size += len(keys[-1])
                if size > 2_500_000:
                    yield packed()
                    keys, counts, size = [], [], 0
        if size:
            yield packed()

    def add(batches):
        for _, (keys, counts) in _by_part(batches, 1, 2):
            k, n = _summed(_joined(keys), _joined(counts, np.int32).astype(np.int64))
            yield pa.RecordBatch.from_pydict({"key": k, "c": n})

    dealt = train.coalesce(max(12, parts // 2)).select("distinct", "size", "tokens").mapInArrow(released(count), "part long, keys binary, counts binary").repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(released(add), "key long, c long")


def _words(numbers: np.ndarray, frequent: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The hashes of words: of number n from 1 `frequent[n - 1]`, of -1, -2, ... those of `others`."""
    out = np.empty(numbers.shape, np.int64)
    known = numbers > 0
    out[known], out[~known] = frequent[numbers[known] - 1], others[-1 - numbers[~known]]
    return out


def _names(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the strings in the rows, and of these without their first words (of single words: 0)."""
    whole, suffix = words[:, 0], np.zeros(len(words), np.int64)
    for j in range(1, words.shape[1]):
        suffix = words[:, j] if j == 1 else _mix(suffix, words[:, j])
        whole = _mix(whole, words[:, j])
    return whole, suffix


class _Sent:
    """Rows of a count and the numbers of some words, as bytes of equal rank behind each other, and the hashes of the words without a number."""

    def __init__(self, counts: np.ndarray, numbers: np.ndarray, others: np.ndarray):
        known = numbers > 0
        every = np.concatenate([counts, np.where(known, numbers, 0).astype(np.uint32)], axis=1)
        self.planes = np.ascontiguousarray(every.view(np.uint8).T)
        self.hashes = others[-1 - numbers[~known]]
        self.starts = np.concatenate([[0], np.cumsum((~known).sum(1))])

    def part(self, lo: int, hi: int) -> bytes:
        return self.planes[:, lo:hi].tobytes() + self.hashes[self.starts[lo] : self.starts[hi]].tobytes()

    @staticmethod
    def read(raw: memoryview, rows: int, words: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, memoryview]:
        """(counts, hashes of the words, what follows)"""
        end = 4 * (words + 1) * rows
        every = np.ascontiguousarray(np.frombuffer(raw[:end], np.uint8).reshape(-1, rows).T).view(np.uint32)
        numbers = every[:, 1:].astype(np.int32)
        rare = numbers == 0
        last = end + 8 * int(rare.sum())
        numbers[rare] = -1 - np.arange((last - end) // 8)
        return every[:, 0], _words(numbers, frequent, np.frombuffer(raw[end:last], np.int64)), raw[last:]


def entry_counts(train: DataFrame, shared, parts: int, first: int, upto: int) -> DataFrame:
    """(level, key, ctx, sfx, c) of levels `first` to `upto`: the strings that come `MIN_ENTRY` times, the contexts before them and the entries of the contexts' suffixes.

    `shared`: a broadcast of the filters, `first` of them, of the sorted contexts that come so often that their entries are
    dealt over all parts, and of the most frequent words.  Contexts of later levels may come less than `MIN_CONTEXT` times.  Tasks
    send a string once in a while: by runs of equal contexts the words of these and the number of strings, and the strings' last
    words and counts.  Words go as numbers, 0 before the hash of one that has none; hashes of strings are made again from them.
    """

    def count(batches):
        (levels, hot, frequent), size = shared.value, 0
        by_hash = np.argsort(frequent).astype(np.int32)
        ordered = frequent[by_hash]
        held: dict[int, list] = {k: [] for k in range(first, upto + 1)}
        rare, n_rare = [], 0

        def packed(k, others):
            key, ctx, words = (np.concatenate(x) for x in zip(*held[k], strict=True))
            held[k].clear()
            o = np.argsort(key)  # equal keys have equal words: any order among them will do
            key = key[o]
            start = np.flatnonzero(np.diff(key, prepend=-1))
            key, at, n = key[start], o[start], np.diff(start, append=len(o)).astype(np.uint32)
            ctx = ctx[at]
            part = _part(np.where(_find(hot, ctx)[1], key, ctx) if k == first else key, parts).astype(np.uint16 if parts < 1 << 16 else np.int64)
            o = np.argsort(ctx)
            o = o[np.argsort(part[o], kind="stable")]
            part, ctx, n, words = part[o], ctx[o], n[o], words[at[o]]
            runs = np.flatnonzero((np.diff(ctx, prepend=-1) != 0) | np.concatenate([[True], part[1:] != part[:-1]]))
            cuts = _cuts(part.astype(np.int64))
            ends = np.searchsorted(runs, [hi for _, _, hi in cuts]).tolist()
            rows = []
            sent = [_Sent(np.diff(runs, append=len(ctx)).astype(np.uint32)[:, None], words[runs, :k], others), _Sent(n[:, None], words[:, k:], others)]
            for (p, lo, hi), run_lo, run_hi in zip(cuts, [0, *ends[:-1]], ends, strict=True):
                raw = sent[0].part(run_lo, run_hi) + sent[1].part(lo, hi)
                rows.append((p, k, run_hi - run_lo, hi - lo, len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
            kinds = (pa.int64(),) * 5 + (pa.binary(),)
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "level", "runs", "strings", "size", "packed"])

        def all_packed():
            others = np.concatenate(rare) if rare else np.zeros(0, np.int64)
            rare.clear()
            yield from (packed(k, others) for k in held if held[k])

        for batch in batches:
            for hashes, at in _pieces(batch):
                place, there = _find(ordered, hashes)
                number = np.empty(len(hashes), np.int32)  # from 1; -1, -2, ... for those among `rare`
                number[there] = by_hash[place[there]] + 1
                others = hashes[~there]
                number[~there] = -1 - n_rare - np.arange(len(others), dtype=np.int32)
                rare.append(others)
                n_rare += len(others)
                number = number[at]
                for k, (_, _, pos, key, ctx, _) in enumerate(_walk(hashes, at, levels, upto - first), 1):
                    if k >= first and len(key):
                        held[k].append((key, ctx, np.stack([number[pos - j] for j in range(k, -1, -1)], axis=1)))
                        size += len(key)
                if size > 1_000_000:
                    yield from all_packed()
                    size = n_rare = 0
                    give_back()
        yield from all_packed()

    def add(batches):
        frequent = shared.value[2]
        for (_, level), columns in _by_part(batches, 2, 4):
            got = []
            for runs, strings, size, packed in zip(*columns, strict=True):
                raw = memoryview(pa.decompress(packed, size, codec="zstd", asbytes=True))
                of, ctx_words, raw = _Sent.read(raw, runs, level, frequent)
                n, last, _ = _Sent.read(raw, strings, 1, frequent)
                got.append((of, n, last[:, 0], *_names(ctx_words)))
            of, n, last, ctx, sub = (np.concatenate(x) for x in zip(*got, strict=True))
            ctx, n = np.repeat(ctx, of), n.astype(np.int64)
            key = _mix(ctx, last)
            o = np.argsort(key)
            start = np.flatnonzero(np.diff(key[o], prepend=-1))
            n = np.add.reduceat(n[o], start)
            at, n = o[start[n >= MIN_ENTRY]], n[n >= MIN_ENTRY]
            o = np.argsort(ctx[at])  # equal contexts together, which is smaller
            at, n = at[o], n[o]
            sfx = last[at] if level == 1 else _mix(np.repeat(sub, of)[at], last[at])
            yield pa.RecordBatch.from_pydict({"level": np.full(len(at), level), "key": key[at], "ctx": ctx[at], "sfx": sfx, "c": n})

    dealt = train.coalesce(max(12, parts // 2)).select("distinct", "size", "tokens").mapInArrow(released(count), "part long, level long, runs long, strings long, size long, packed binary").repartition(parts, "part").sortWithinPartitions("part", "level")
    return dealt.mapInArrow(released(add), "level long, key long, ctx long, sfx long, c long")


def _test(rows: DataFrame, contexts: DataFrame, total: int) -> DataFrame:
    """Divergence test: (ctx, t, keep, rest) for each of the contexts (ctx, t); `rows`: entries (ctx, c) and the probabilities q of their suffixes."""
    cost = math.log(max(total, 2))
    c, q = F.col("c"), F.col("q")
    of = rows.groupBy("ctx").agg(F.count("*").alias("n"), F.sum("c").alias("e"), F.sum("q").alias("sq"), F.sum(c * F.log(c / q)).alias("gain"))
    of = of.join(contexts.hint("shuffle_hash"), "ctx")
    t, n = F.col("t"), F.col("n")
    left = F.greatest(t - F.col("e"), F.lit(0))
    small = lambda x: F.greatest(x, F.lit(1e-12))
    of = of.withColumn("rest_q", small(1 - F.col("sq"))).withColumn("rest", (left + DISCOUNT * n) / t)
    diverges = F.col("gain") - F.col("e") * F.log(t) + t * small(left / t) * F.log(small(left / t) / F.col("rest_q")) > (n + 1) * 0.5 * cost
    return of.select("ctx", "t", diverges.alias("keep"), "rest")


def _most_frequent(rows: DataFrame, rank: str, most: int) -> int:
    """The least rank that at most `most` rows reach: a count up to 1023, beyond that a power of two."""
    r = F.col(rank)
    bucket = F.when(r < 1024, r).otherwise(1014 + F.floor(F.log2(r.cast("double"))))
    reach, least = 0, 1 << 62
    for row in rows.groupBy(bucket.alias("b")).count().orderBy(F.desc("b")).collect():  # at most 1,077 rows
        reach += row["count"]
        if reach > most:
            break
        least = row["b"] if row["b"] < 1024 else 1 << (row["b"] - 1014)
    return least


def _collected(rows: DataFrame, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns key and v by ascending keys, fetched a slice of the hash space at a time, so that the driver holds little beside them."""
    keys, values, width = [], [], (1 << 63) // slices
    for i in range(slices):
        own = rows.where((F.col("key") >= i * width) & (F.col("key") < (i + 1) * width if i < slices - 1 else F.lit(True)))
        got = own.select("key", "v").toArrow()
        k, v = got["key"].to_numpy(), got["v"].to_numpy()
        o = np.argsort(k)
        keys.append(k[o])
        values.append(v[o])
        del got, k, v, o
        give_back()
    k = np.concatenate(keys)
    keys.clear()
    return k, np.concatenate(values)


def train_tree(train: DataFrame, head: int = HEAD, depth: int | None = None) -> tuple[dict, DataFrame]:
    """The tree, of which at most `head` contexts and `head` entries are in arrays and the rest in tables, and the table (h, c) of all symbol counts.

    `train`: documents, or what `tokenised` makes of them.
    """
    spark, depth = train.sparkSession, DEPTH if depth is None else depth
    own = None if "tokens" in train.columns else tokenised(train)
    tokens = train if own is None else own
    parts = max(12, (tokens.agg(F.sum("symbols")).first()[0] or 0) // PART + 1)
    words = keep(word_counts(tokens, parts), "lm-words").withColumnRenamed("key", "h")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = words.where(F.col("c") >= total * P_WORD).toArrow()  # at most 1 / P_WORD rows
    h, c = frequent["h"].to_numpy(), frequent["c"].to_numpy()
    numbered = h[np.argsort(-c, kind="stable")]
    order = np.argsort(h)
    h, c = h[order], c[order]
    norm = total + 0.1 * (distinct + 1)
    filters: list = []
    late = None
    strings, contexts = [words.withColumnRenamed("h", "key")], []  # those of as many words as their place says, and what of them comes often
    while True:
        level = strings[-1]
        often, very = (level.where(F.col("c") >= least).select("key") for least in (MIN_ENTRY, MIN_CONTEXT))
        n_often, n_very = level.agg(F.count_if(F.col("c") >= MIN_ENTRY), F.count_if(F.col("c") >= MIN_CONTEXT)).first()
        if not n_often:
            break
        last = len(strings) == depth + 1 or not n_very
        filters.append((key_bitmap(often, n_often, BITS), None if last else key_bitmap(very, n_very, BITS)))
        if last:
            break
        contexts.append(keep(level.where(F.col("c") >= MIN_CONTEXT).select(F.col("key").alias("ctx"), F.col("c").alias("t")), f"lm-often{len(strings)}"))
        k = len(strings)
        if k <= TOGETHER:
            hot = contexts[-1].where(F.col("t") >= total / (4 * parts)).select("ctx").toArrow()["ctx"].to_numpy()  # at most 4 for each part
            shared = spark.sparkContext.broadcast((filters, np.sort(hot), numbered))
            counts = entry_counts(tokens, shared, parts, k, depth if k == TOGETHER else k)
            if k < TOGETHER:
                strings.append(keep(counts.drop("level"), f"lm-count{k}", "zstd"))
            else:
                late = keep(counts, "lm-counts", "zstd", by="level")
            shared.destroy()
            collect_shuffles(spark)
        if k >= TOGETHER:
            strings.append(keep(late.where(F.col("level") == k).drop("level").join(contexts[-1].select("ctx"), "ctx", "left_semi").select("key", "ctx", "sfx", "c"), f"lm-count{k}", "zstd"))
            discard_part(late, f"level={k}")
    if late is not None:
        discard(late)
    while filters and filters[-1][1] is not None:  # the longest contexts have no entries that come often
        filters[-1] = (filters[-1][0], None)
    below = words.select(F.col("h").alias("key"), ((F.col("c") + 0.1) / F.lit(float(norm))).alias("p"))
    tree, tables = [], []
    for k in range(1, len(filters)):
        rows = strings[k].join(below.select(F.col("key").alias("sfx"), F.col("p").alias("q")).hint("shuffle_hash"), "sfx").select("key", "ctx", "c", "q")
        rows = keep(rows, f"lm-level{k}")
        discard(strings[k])
        collect_shuffles(spark)
        tested = keep(_test(rows, contexts[k - 1], total), f"lm-contexts{k}")
        p = F.when(F.col("keep"), (F.col("c") - DISCOUNT) / F.col("t") + F.col("rest") * F.col("q")).otherwise(F.col("q"))
        entries = keep(rows.join(tested.hint("shuffle_hash"), "ctx").select("key", "c", "keep", p.alias("p")), f"lm-probabilities{k}")
        tree.append((tested.where("keep").select("ctx", "t", F.log10("rest").alias("v")), entries.where("keep").select("key", "c", F.log10("p").alias("v"))))
        tables += [tested, entries]
        discard(rows)
        collect_shuffles(spark)
        below = entries.select("key", "p")
    discard(*strings[max(1, len(filters)) :], *contexts, *([own] if own is not None else []))
    model = {"total": total, "distinct": distinct, "norm": norm, "numbers": range(len(h)), "h": h, "log_root": np.log10((c + 0.1) / norm), "filters": filters, "least": total * P_WORD, "tails": [], "tables": []}
    for name, value, rank, which in (("c1", "rest1", "t", 0), ("k1", "e1", "c", 1)):
        level_rows = [level[which].toDF("key", rank, "v") for level in tree]
        every = reduce(DataFrame.unionByName, level_rows) if level_rows else None
        n = every.count() if level_rows else 0
        tail = None
        if n > head:
            least = _most_frequent(every, rank, head)
            tail = keep(every.where(F.col(rank) < least).select("key", "v"), f"lm-tail{which}")
            every = every.where(F.col(rank) >= least)
        k, v = _collected(every, 1 + min(n, head) // 2_000_000) if n else (np.zeros(0, np.int64), np.zeros(0))
        model |= {name: k, value: 10**v if which == 0 else v, f"{name}_tail": None if tail is None else key_bitmap(tail.select("key"), max(1, n - len(k)), BITS)}
        model["tails"].append(tail)
        del k, v
        give_back()
    discard(*tables)  # all that scores need of them is in the head and the tails
    model["tables"] = [t for t in model["tails"] if t is not None]
    return model, words


def _starts(sorted_keys: np.ndarray) -> tuple[int, np.ndarray]:
    """Where the keys of each leading bits start, and how many bits follow."""
    bits = max(1, len(sorted_keys).bit_length() - 1)
    return 63 - bits, np.searchsorted(sorted_keys, np.arange(1 << bits) << 63 - bits).astype(np.int32)


def _find_near(sorted_keys: np.ndarray, starts: tuple[int, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `_find`, for hashes among many: from the start of their leading bits."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at, end = starts[1][keys >> starts[0]], len(sorted_keys) - 1
    at = np.minimum(at, end)
    todo = np.flatnonzero((sorted_keys[at] < keys) & (at < end))
    while len(todo):
        at[todo] += 1
        now = at[todo]
        todo = todo[(sorted_keys[now] < keys[todo]) & (now < end)]
    return at, sorted_keys[at] == keys


def _look(keys: np.ndarray, m: dict, name: str, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in the head, 0 for others, and whether they are known."""
    at, there = _find_near(m[name], m[f"{name}_starts"], keys)
    return np.where(there, values[at], 0.0) if len(values) else np.zeros(len(keys)), there


def _shared(model: dict) -> dict:
    """What tasks need of the model."""
    return {k: v for k, v in model.items() if k not in ("tails", "tables", "numbers", "rest1", "e1")} | {"log_rest": np.log10(model["rest1"]), "log_e": model["e1"], "c1_starts": _starts(model["c1"]), "k1_starts": _starts(model["k1"])}


class _Small:
    """What tasks need of the model, packed: a broadcast is a file at the driver and at each executor.  `get` unpacks it, once for a worker."""

    def __init__(self, model: dict):
        self.rest, self.packed = {}, {}
        for name, x in _shared(model).items():
            if name in ("c1", "k1", "log_rest", "log_e"):
                raw = _packed_keys(x) if name in ("c1", "k1") else _planes(x)
                self.packed[name] = (len(raw), pa.compress(raw, codec="zstd", asbytes=True))
            elif name not in ("c1_starts", "k1_starts"):  # are made again
                self.rest[name] = x
        bits = [b for pair in self.rest.pop("filters") for b in pair] + [self.rest.pop("c1_tail"), self.rest.pop("k1_tail")]
        self.bits = [None if b is None else (len(b), pa.compress(b.tobytes(), codec="zstd", asbytes=True)) for b in bits]
        self.whole: dict | None = None

    def get(self) -> dict:
        if self.whole is None:
            raw = {name: pa.decompress(x, n, codec="zstd", asbytes=True) for name, (n, x) in self.packed.items()}
            bits = [None if b is None else np.frombuffer(pa.decompress(b[1], b[0], codec="zstd", asbytes=True), np.uint8) for b in self.bits]
            self.whole = self.rest | {name: _unpacked_keys(x) if name in ("c1", "k1") else _from_planes(x, np.float64) for name, x in raw.items()}
            self.whole |= {"filters": list(zip(bits[:-2:2], bits[1:-2:2], strict=True)), "c1_tail": bits[-2], "k1_tail": bits[-1]}
            self.whole |= {f"{name}_starts": _starts(self.whole[name]) for name in ("c1", "k1")}
            self.packed, self.bits = {}, []
            del raw
            give_back()
        return self.whole


def _read(hashes: np.ndarray, at: np.ndarray, m: dict, whole: bool = True) -> dict:
    """What the head knows of the symbols `hashes[at]`, by levels (if `whole`), and the sorted keys that the tables are to be asked for."""
    n_at, numbered = _find(m["h"], hashes)
    root = np.where(numbered, m["log_root"][n_at], 0.0) if len(m["h"]) else np.zeros(len(hashes))
    levels, asked = [], [hashes[~numbered & (hashes >= 0)]]
    contexts = _look(hashes, m, "c1", m["log_rest"]) if whole else None  # of one word
    for behind, ctx, pos, key, _, _ in _walk(hashes, at, m["filters"]):
        own = []
        for keys, tail, name, kind, log in ((ctx, m["c1_tail"], _CONTEXT, "c1", "log_rest"), (key, m["k1_tail"], 0, "k1", "log_e")):
            v = known = None
            if whole:
                number = at[behind - 1] if kind == "c1" and not levels else None
                v, known = _look(keys, m, kind, m[log]) if number is None else (x[number] for x in contexts)
            # a few may be in the tables: only these are looked for elsewhere
            far = np.flatnonzero(in_bitmap(tail, keys) if known is None else in_bitmap(tail, keys) & ~known) if tail is not None else np.zeros(0, np.int64)
            if known is None and len(far):
                far = far[~_look(keys[far], m, kind, m[log])[1]]
            asked.append(keys[far] ^ name)
            own += [v, known, far]
        if whole:
            levels.append((behind, ctx, *own[:3], pos, key, *own[3:]))
    return {"numbered": numbered, "root": root, "levels": levels, "asked": _different(np.concatenate(asked))}


def _fill(values: np.ndarray, known: np.ndarray, keys: np.ndarray, lack: np.ndarray, asked: np.ndarray, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, completed at the places `lack` by what the tables answered (NaN: nothing), and whether they are known."""
    at, there = _find(asked, keys[lack])
    if there.any():
        found = np.where(there, answers[at], np.nan)
        hit = lack[~np.isnan(found)]
        values, known = values.copy(), known.copy()
        values[hit], known[hit] = found[~np.isnan(found)], True
    return values, known


def _score(read: dict, hashes: np.ndarray, at: np.ndarray, m: dict, answers: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether the word is known, log probabilities of the root, of the tree) of the symbols; without answers the root of words without a number is 0."""
    known, root, asked = read["numbered"], read["root"], read["asked"]
    if answers is not None:
        c, found = _fill(np.zeros(len(hashes)), known, hashes, np.flatnonzero(~known), asked, answers)
        root = np.where(known, root, np.log10((c + 0.1) / m["norm"]))
        known = found
    known, root = known[at], root[at]
    p, e_at, has = root.copy(), np.zeros(len(root)), np.zeros(len(root), bool)
    for behind, ctx, rest, has_rest, far_ctx, pos, key, e, has_e, far_key in read["levels"]:
        if answers is not None and len(far_ctx):
            rest, _ = _fill(rest, has_rest, ctx ^ _CONTEXT, far_ctx, asked, answers)
        if answers is not None and len(far_key):
            e, has_e = _fill(e, has_e, key, far_key, asked, answers)
        has[behind] = False
        has[pos], e_at[pos] = has_e, e
        p[behind] = np.where(has[behind], e_at[behind], p[behind] + rest)
    return known, root, p


def score_tokens(x: np.ndarray, m: dict) -> tuple[float, float, int]:
    """(base, score, known) of one document's symbols by the head of the tree, without the root probabilities of those that have no number.

    `x`: numbers of frequent words, -1 - hash for others.
    """
    h = np.where(x >= 0, m["h"][np.where(x >= 0, x, 0)], -1 - x) if len(m["h"]) else -1 - x
    m, at = m if "log_rest" in m else _shared(m), np.arange(len(h))
    known, root, p = _score(_read(h, at, m), h, at, m, None)
    return float(root[known].sum()), float(p.sum()), int(known.sum())


#: Tells the name of a context from that of the same string as an entry.
_CONTEXT = 0x2545F4914F6CDD1D


def _answers(pieces: DataFrame, model: dict, words: DataFrame, shared, parts: int) -> DataFrame:
    """(piece, part, answers, lot of the piece): by parts of the hash space what the tables know of the keys that a piece asks for, in the order of the keys (see `_packed_answers`).

    Keys go to the parts packed, and so do the tables' rows: counts of the words without a number, entries and contexts.
    """

    def ask(batches):
        m = shared.value.get()
        for batch in batches:
            for (piece, lot), own in zip(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True), _pieces(batch), strict=True):
                keys = _read(*own, m, whole=False)["asked"]
                give_back(False)
                cuts = _cuts(_part(keys, parts))
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _, _ in cuts], pa.int64()), "piece": pa.array([piece] * len(cuts), pa.int64()), "keys": pa.array([_packed_keys(keys[lo:hi]) for _, lo, hi in cuts], pa.binary()), "v": pa.array([b""] * len(cuts), pa.binary()), "lot": pa.array([lot] * len(cuts), pa.int32())})

    def tell(batches):
        held, size = [], 0

        def packed():
            k, v = (np.concatenate([x[i] for x in held]) for i in range(2))
            o = np.argsort(k)
            k, v = k[o], v[o]
            cuts = _cuts(_part(k, parts))
            return pa.RecordBatch.from_pydict({"part": pa.array([p for p, _, _ in cuts], pa.int64()), "piece": pa.array([-1] * len(cuts), pa.int64()), "keys": pa.array([_packed_keys(k[lo:hi]) for _, lo, hi in cuts], pa.binary()), "v": pa.array([_planes(v[lo:hi]) for _, lo, hi in cuts], pa.binary()), "lot": pa.array([-1] * len(cuts), pa.int32())})

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > 500_000:
                yield packed()
                held, size = [], 0
                give_back()
        if size:
            yield packed()

    def answer(batches):
        at, told, keys, values = None, [], None, None
        for batch in batches:
            answers = []
            for part, piece, k, v, lot in zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True):
                if part != at:
                    at, told, keys = part, [], None
                if piece < 0:
                    told.append((k, v))
                    continue
                if keys is None:  # all that is told comes before what is asked
                    keys = np.concatenate([np.zeros(0, np.int64), *(_unpacked_keys(x) for x, _ in told)])
                    values = np.concatenate([np.zeros(0), *(_from_planes(x, np.float64) for _, x in told)])
                    o = np.argsort(keys)
                    keys, values, told = keys[o], values[o], []
                place, there = _find(keys, _unpacked_keys(k))
                answers.append((piece, part, lot, _packed_answers(values[place] if len(keys) else np.zeros(len(there)), there)))
            cols = list(zip(*answers, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_pydict({"piece": pa.array(cols[0], pa.int64()), "part": pa.array(cols[1], pa.int64()), "answers": pa.array(cols[3], pa.binary()), "lot": pa.array(cols[2], pa.int32())})

    contexts, entries = model["tails"]
    far = words.where(F.col("c") < model["least"]).select(F.col("h").alias("key"), F.col("c").cast("double").alias("v"))
    far = far if entries is None else far.unionByName(entries)
    far = far if contexts is None else far.unionByName(contexts.select(F.col("key").bitwiseXOR(F.lit(_CONTEXT)).alias("key"), "v"))
    kind = "part long, piece long, keys binary, v binary, lot int"
    both = far.mapInArrow(released(tell), kind).unionByName(pieces.select("distinct", "size", "tokens", "piece", "lot").mapInArrow(released(ask), kind))
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", "piece")
    return keep(dealt.mapInArrow(released(answer), "piece long, part long, answers binary, lot int"), "lm-answers", "zstd")


def score(docs: DataFrame, model: dict, words: DataFrame, out_of: int = 10, spent: bool = False) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `docs`: documents, or what `tokenised` makes of them; `spent`: this is not read again and goes lot by lot.
    """
    spark = docs.sparkSession
    own_pieces = spent or "tokens" not in docs.columns
    pieces = docs if "tokens" in docs.columns else tokenised(docs, out_of)
    parts = max(12, (pieces.agg(F.sum("symbols")).first()[0] or 0) // PART + 1)
    shared = spark.sparkContext.broadcast(_Small(model))
    answers = _answers(pieces, model, words, shared, parts)
    collect_shuffles(spark)
    id_type = pieces.schema["ids"].dataType.elementType.simpleString()

    def finish(batches):
        m, own, told = shared.value.get(), None, []

        def row():
            ids, n, held, distinct, size, tokens = own
            hashes, at = _unpacked(tokens.as_py(), distinct, size)
            n = np.array(n)
            starts = np.concatenate([[0], np.cumsum(n[:-1] + 1)])
            read = _read(hashes, at, m)
            answers = [_unpacked_answers(x, hi - lo) for x, (_, lo, hi) in zip(told, _cuts(_part(read["asked"], parts)), strict=True)]
            known, root, p = _score(read, hashes, at, m, np.concatenate([np.zeros(0), *answers]))
            gap = starts + n
            known, root[gap], p[gap] = known & (hashes[at] >= 0), 0.0, 0.0
            sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), root, p)]
            return pa.RecordBatch.from_pydict({"doc_id": ids.values, "held_out": pa.array([held] * len(n)), "n_tokens": n, "n_known": sums[0], "base_score": sums[1], "score": sums[2]})

        for batch in batches:
            for i, (part, held, distinct, size, found) in enumerate(zip(*[batch.column(c).to_pylist() for c in (1, 2, 3, 4, 5)], strict=True)):
                if part < 0:
                    if own:
                        yield row()
                        give_back(False)
                    own, told = (batch.column(6)[i], batch.column(7)[i].as_py(), held, distinct, size, batch.column(8)[i]), []
                else:
                    told.append(found)
        if own:
            yield row()

    # a piece, then its answers by parts; a lot at a time, so that little of the packed documents is in shuffles at once
    both = pieces.withColumns({"part": F.lit(-1).cast("long"), "answers": F.lit(None).cast("binary")}).unionByName(answers, allowMissingColumns=True)
    scores = []
    for lot in range(LOTS):
        dealt = both.where(F.col("lot") == lot).select("piece", "part", "held", "distinct", "size", "answers", "ids", "n", "tokens").repartition(-(-parts // LOTS), "piece").sortWithinPartitions("piece", "part")
        scores.append(keep(dealt.mapInArrow(released(finish), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "lm-scores"))
        if own_pieces:
            discard_part(pieces, f"lot={lot}")
        del dealt
        collect_shuffles(spark)
    discard(answers, *([pieces] if own_pieces else []))
    shared.destroy()
    out = reduce(DataFrame.unionByName, scores)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model["total"])).cast("long").alias("train_tokens"), "base_score", "score")


def assess(docs: DataFrame, out_of: int = 10) -> DataFrame:
    """Learn from the documents whose id is not held out, score all."""
    tokens = tokenised(docs, out_of)
    model, words = train_tree(tokens.where("not held"))
    out = score(tokens, model, words, out_of, spent=True)
    discard(*model["tables"])
    return out
