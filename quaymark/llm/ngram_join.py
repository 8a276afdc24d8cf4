"""N-gram Jaccard join by a prefix tree.

A document is the set of its distinct word n-grams (whole text, ASCII lower case).  Equal sets are one
class.  All sets are sorted in one global order: n-grams that very many documents share come first, the
rest by hash.  Two sets can only be similar if they share an n-gram among the last few of that order (the
probing end), so that postings of those n-grams name all candidates:

* round 1 streams the postings; the first class of a posting list leads it, and every class is checked
  against the leaders of its lists; links give components;
* further rounds go through the lists again.  In a list every class looks at the classes of larger components
  whose size is near its own and that, from where their first shared n-gram stands and by their signatures, could
  overlap enough.  It proposes a few of them, which are checked, and links contract components; lists in which
  a class had more to propose are open and come again in the next round, with more proposals each.  The rounds
  end when no list is open: then each pair of classes has been checked, or lies in one component, or cannot link.
  Rows are in proportion to the lists' members; large groups of near copies contract in the first rounds.

Before sets are moved, a pair must pass a test that cannot lose a link: each set has a bitmap of about one
bit for each n-gram, flipped by each of them, and where two bitmaps differ the sets differ at least as often.
A signature is such a bitmap of 256 bits, whatever the size, that goes with the postings.
Candidates of one class are then checked together: their sets, in the global order, form a prefix tree, which the
probing set walks from the root.  The overlap with a node's n-grams is counted once for all sets below it, and a
node whose longest set cannot reach the overlap needed any more is left out with all that is below.

Hashes of n-grams have 63 bits.  What is broadcast is bounded: the shared n-grams (at most `MOST_SHARED`),
ids behind a check of their number, a bitmap of the open lists, and the n-grams of more than `HOT` classes.  In
round 1 lists are streamed.  Later a list of more than `HOT` members is dealt over several tasks: each holds some
of its members, and classes of small components are sent to all of them to look there.  Groups of candidates are
dealt out in lots of `LOT`.

Defined cases: a null or empty text has no n-grams and links with nothing; fewer than n words are one n-gram;
a null doc_id links with nothing and has a null component; equal rows are linked; rows of one doc_id with
different texts are separate documents; an empty table has no components; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import discard, free_name, in_bitmap, keep, key_bitmap, released, utf8

MOST_SHARED = 1_000_000
BROADCAST_IDS = 2_000_000  # at most so many ids are broadcast; beyond that Spark shuffles
LOT = 400
#: Postings that are put in order together.
MERGED = 300_000
#: Members of a list that one task holds at most; proposals of a class in a list in round 2, and how they grow by rounds.
HOT, PROPOSALS, GROWTH = 100_000, 8, 32
_TOP = np.uint64(1 << 63)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Whole text -> sorted distinct 63-bit hashes of its word n-grams."""

    def __init__(self, n: int = 5) -> None:
        self.n, self.hashes = n, _WordHashes()
        self.factors = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ** 7) % (1 << 64) | 1) for k in range(n)]

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        many = max(1, len(w) - self.n + 1)
        with np.errstate(over="ignore"):
            h = np.zeros(many, np.uint64)
            for k in range(min(self.n, len(w))):
                h += w[k : k + many] * self.factors[k]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(len(w) if len(w) < self.n else 0)
            h = ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(1)
        return np.unique(h)


def _ids_and_texts(batch):
    texts = batch.column(1)
    for lo in range(0, batch.num_rows, 512):
        yield batch.column(0).slice(lo, 512), utf8(texts.slice(lo, 512))


def shared_ngrams(docs: DataFrame, n: int = 5) -> np.ndarray:
    """The n-grams that most documents share, as far as parts of the input show it: at most MOST_SHARED; sorted.

    They only fix the global order, so that being near the mark either way changes no result.
    """

    def count(batches):
        shingler = Shingler(n)
        sets, size = [], 0

        def flush():
            h, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = c >= 2
            return pa.RecordBatch.from_pydict({"h": h[often].astype(np.int64), "n": c[often]})

        for batch in batches:
            for _, texts in _ids_and_texts(batch):
                for t in texts:
                    s = shingler.of(t)
                    sets.append(s)
                    size += len(s)
                if size > 3_000_000:
                    yield flush()
                    sets, size = [], 0
        yield flush()

    found = keep(docs.select("doc_id", "text").mapInArrow(released(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "ngram-counts")
    # the smallest mark that no more than MOST_SHARED reach, by powers of two
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    reach, least = 0, 1 << 62
    for r in found.where("n >= 8").groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():  # one row for each power of two
        reach += r["count"]
        if reach > MOST_SHARED:
            break
        least = 1 << r["level"]
    return np.sort(found.where(F.col("n") >= least).select("h").toArrow()["h"].to_numpy().astype(np.uint64))


def keys_of(s: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Hashes as keys of the global order, ascending: shared n-grams first."""
    if not len(shared) or not len(s):
        return s | _TOP
    at = np.minimum(np.searchsorted(shared, s), len(shared) - 1)
    is_shared = shared[at] == s
    return np.concatenate([s[is_shared], s[~is_shared] | _TOP])


def probing(n: int, percent: int) -> int:
    """How many n-grams at the end of the order a set must be probed with."""
    return n - -(-n * percent // 100) + 1


def needed(a, b, percent: int):
    """The overlap that sets of sizes a and b need: 100 * overlap >= percent * (a + b - overlap)."""
    return -(-(a + b) * percent // (100 + percent))


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the hashes in each of about as many bits as there are; a power of two of them."""
    bits = 1 << max(6, int(len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def signature(s: np.ndarray) -> bytes:
    """Like a bitmap, of 256 bits whatever the size: short enough to go with each posting."""
    return np.packbits(np.bincount(((s >> np.uint64(24)) & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1).tobytes()


def may_be_similar(a: bytes, n_a: int, b: bytes, n_b: int, percent: int) -> bool:
    """False only if the bitmaps show that the sets differ too much."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):  # a bit's number is the low bits of the hash: halves lie on each other
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= n_a + n_b - 2 * needed(n_a, n_b, percent)


def documents_as_sets(docs: DataFrame, shared, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, node, node2, probe, bits, sig): size, 128-bit digest, probing end, bitmap and signature of each document's set."""

    def read(batches):
        shingler, order = Shingler(n), shared.value
        for batch in batches:
            for ids, texts in _ids_and_texts(batch):
                size, node, node2, probe, bits, sig = [], [], [], [], [], []
                for t in texts:
                    k = keys_of(shingler.of(t), order)
                    size.append(len(k))
                    d = xxhash.xxh3_128_intdigest(k.tobytes())
                    node.append((d & ((1 << 64) - 1)) - (1 << 63))
                    node2.append((d >> 64) - (1 << 63))
                    bits.append(bitmap(k & ~_TOP) if len(k) else b"")
                    sig.append(signature(k & ~_TOP))
                    probe.append(k[len(k) - probing(len(k), percent) :].tobytes() if len(k) else b"")
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_shingles": pa.array(size, pa.int64()), "node": pa.array(node, pa.int64()), "node2": pa.array(node2, pa.int64()), "probe": pa.array(probe, pa.binary()), "bits": pa.array(bits, pa.binary()), "sig": pa.array(sig, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(read), "doc_id long, n_shingles long, node long, node2 long, probe binary, bits binary, sig binary")


def _slices(batches, most: int = 2048):
    """Batches of at most `most` rows: postings are many times larger than rows."""
    return (b.slice(lo, most) for b in batches for lo in range(0, b.num_rows, most))


def _parts_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key & ~_TOP) >> np.uint64(23)).astype(np.int64) % parts


def _packed(part: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> dict:
    """One row for each part with the columns of its postings as packed numbers."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(ends))
    out = {"part": pa.array(some, pa.int64())}
    for name, values in columns.items():
        values = values[order]
        out[name] = pa.array([values[ends[p] : ends[p + 1]].tobytes() for p in some], pa.binary())
    return out


def _postings(rows: DataFrame, parts: int) -> DataFrame:
    """(part, first, key, node): postings by part of the hash space, many to a row, as packed numbers."""

    def deal(batches):
        for batch in _slices(batches):
            batch = batch.take(pa.array(np.unique(batch.column("node").to_numpy(), return_index=True)[1]))  # equal sets count once
            probes = [np.frombuffer(p, np.uint64) for p in batch.column("probe").to_pylist()]
            key, node = np.concatenate(probes), np.repeat(batch.column("node").to_numpy(), [len(p) for p in probes])
            out = _packed(_parts_of(key, parts), parts, {"key": key, "node": node})
            out["first"] = pa.array([int.from_bytes(x.as_py()[:8], "little", signed=True) for x in out["node"]], pa.int64())
            yield pa.RecordBatch.from_pydict({k: out[k] for k in ("part", "first", "key", "node")})

    return rows.select("node", "probe").mapInArrow(released(deal), "part long, first long, key binary, node binary")


def leaders(rows: DataFrame, parts: int, hot: int, at_once: int = MERGED) -> DataFrame:
    """(node, leader, n): classes that share n probing n-grams with the leader of their lists.

    Rows with a null node name, as leader, the n-grams of lists with more than `hot` members.  A part's rows come in the
    order of their first class, which leads.  They are gathered up to `at_once` postings, put in order together and merged with
    the lists known so far; what is kept is the leader and the length of each list of a part, however long.  A part has
    about half a million postings, so that it is merged a few times at most, and only lists of many members make more.
    """

    def stream(batches):
        at, keys, lead, many = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list = []
        pairs: list = []
        size = 0

        def flush():
            a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            pairs.clear()
            u, c = np.unique(np.stack([a, b]), axis=1, return_counts=True)
            return pa.RecordBatch.from_pydict({"node": u[0], "leader": u[1], "n": c})

        def hot_lists():
            of = many > hot
            return pa.RecordBatch.from_pydict({"node": pa.nulls(int(of.sum()), pa.int64()), "leader": keys[of].view(np.int64), "n": many[of]})

        def merge():
            nonlocal keys, lead, many, size
            if not held:
                return
            k, v = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in held]), np.concatenate([np.frombuffer(x, np.int64) for _, x in held])
            held.clear()
            size = 0
            order = np.lexsort((v, k))
            k, v = k[order], v[order]
            first = np.concatenate([[True], k[1:] != k[:-1]])
            group = np.cumsum(first) - 1
            own, own_lead, own_many = k[first], v[first], np.bincount(group)
            new = np.ones(len(own), bool)
            if len(keys):
                p = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                known = keys[p] == own
                own_lead, new = np.where(known, lead[p], own_lead), ~known
                many[p[known]] += own_many[known]
            by = own_lead[group]
            other = by != v
            if other.any():
                pairs.append((v[other], by[other]))
            keys, lead, many = np.concatenate([keys, own[new]]), np.concatenate([lead, own_lead[new]]), np.concatenate([many, own_many[new]])
            order = np.argsort(keys, kind="stable")
            keys, lead, many = keys[order], lead[order], many[order]

        for batch in batches:
            for part, key, node in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), batch.column("node").to_pylist(), strict=True):
                if part != at:
                    merge()
                    yield hot_lists()
                    at, keys, lead, many = part, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                held.append((key, node))
                size += len(key) // 8
                if size >= max(at_once, len(keys)):
                    merge()
                if sum(len(x[0]) for x in pairs) > 1_000_000:
                    yield flush()
        merge()
        yield hot_lists()
        if pairs:
            yield flush()

    dealt = _postings(rows, parts).repartition(parts, "part").sortWithinPartitions("part", "first")
    return dealt.mapInArrow(released(stream), "node long, leader long, n long").groupBy("node", "leader").agg(F.sum("n").alias("n"))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pseudorandom order of pairs, the same whichever way round."""
    x = (a ^ b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (a + b).astype(np.uint64)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def proposals(rows: DataFrame, parts: int, percent: int, most: int, hot) -> DataFrame:
    """(a, b, key): pairs of classes in different components that share a probing n-gram and may be similar.

    `rows`: (node, comp, weight, size, sig, probe, pos).  In each list a class proposes at most `most` classes of
    components of more weight, or of the same weight and a larger number; those that had more to propose give a row
    with the list's key alone.  `hot`: broadcast of the n-grams of long lists, ascending, and over how many tasks each is dealt.
    """

    kinds = {"key": np.uint64, "node": np.int64, "comp": np.int64, "weight": np.int8, "size": np.int32, "pos": np.int32, "lot": np.int32, "sig": np.dtype("V32")}

    def deal(batches):
        keys, lots = hot.value
        for batch in _slices(batches):
            probes = [np.frombuffer(p, np.uint64) for p in batch.column("probe").to_pylist()]
            of = np.repeat(np.arange(len(probes)), [len(p) for p in probes])
            key, pos = np.concatenate(probes), np.frombuffer(b"".join(_places(batch)), np.int32)
            node, lot = batch.column("node").to_numpy()[of], np.zeros(len(key), np.int32)
            part = _parts_of(key, parts)
            if len(keys):
                p = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                n = np.where(keys[p] == key, lots[p], 1)
                if (n > 1).any():  # each member is held in one lot and looks into all
                    i = np.repeat(np.arange(len(key)), n)
                    lot = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                    own = (_mix(node, key.view(np.int64)) % n.astype(np.uint64)).astype(np.int64)[i]
                    part = (part[i] + lot) % parts
                    lot = np.where(lot == own, lot, -1 - lot).astype(np.int32)  # below 0: only looks
                    key, pos, of, node = key[i], pos[i], of[i], node[i]
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "V32")
            cols = {"key": key, "node": node, "lot": lot, "pos": pos, "sig": sig[of]} | {c: batch.column(c).to_numpy()[of].astype(kinds[c]) for c in ("comp", "weight", "size")}
            yield pa.RecordBatch.from_pydict(_packed(part, parts, {c: cols[c] for c in kinds}))

    def propose(tables: list[pa.RecordBatch]):
        cols = {c: np.concatenate([np.frombuffer(x, kind) for t in tables for x in t.column(c).to_pylist()]) for c, kind in kinds.items()}
        tables.clear()
        held = cols["lot"] >= 0
        place = np.where(held, cols["lot"], -1 - cols["lot"])
        order = np.lexsort((cols["node"], cols["size"], place, cols["key"]))
        key, node, comp, weight, size, pos, held, place = (x[order] for x in (cols["key"], cols["node"], cols["comp"], cols["weight"], cols["size"], cols["pos"], held, place))
        sig = cols["sig"][order].view(np.uint64).reshape(-1, 4)
        cols.clear()
        new_list = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
        once = new_list | np.concatenate([[True], node[1:] != node[:-1]])  # repeated rows of one class
        key, node, comp, weight, size, pos, held, sig, new_list = (x[once] for x in (key, node, comp, weight, size, pos, held, sig, new_list))
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        of = np.cumsum(new_list) - 1
        at = (of << 32) + size  # ascending, since rows are sorted by list and size
        # who lies in the heaviest component of its list has nobody to look at
        begin = np.flatnonzero(new_list)
        heaviest = np.maximum.reduceat(weight, begin)[of]
        top = np.maximum.reduceat(np.where(weight == heaviest, comp, np.iinfo(np.int64).min), begin)[of]
        lookers = np.flatnonzero((weight < heaviest) | (comp < top))
        lo = np.searchsorted(at, (of[lookers] << 32) + -(-size[lookers] * percent // 100), "left")
        width = np.searchsorted(at, (of[lookers] << 32) + size[lookers] * 100 // percent, "right") - lo
        found, kept, ends = [], 0, np.cumsum(width)

        def flush():
            u = np.unique(np.concatenate(found, axis=1), axis=1)
            found.clear()
            return pa.RecordBatch.from_pydict({"a": u[0], "b": u[1], "key": pa.nulls(u.shape[1], pa.int64())})

        for some in np.split(np.arange(len(lookers)), np.searchsorted(ends, np.arange(250_000, int(ends[-1]) if len(ends) else 0, 250_000))):
            n = width[some]
            i = np.repeat(lookers[some], n)
            k = np.repeat(lo[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            ok = held[k] & ((weight[i] < weight[k]) | (weight[i] == weight[k]) & (comp[i] < comp[k]))
            i, k = i[ok], k[ok]
            need = needed(size[i], size[k], percent)
            ok = 1 + np.minimum(size[i] - pos[i] - 1, size[k] - pos[k] - 1) >= need
            i, k, need = i[ok], k[ok], need[ok]
            ok = np.bitwise_count(sig[i] ^ sig[k]).sum(axis=1) <= size[i] + size[k] - 2 * need
            i, k = i[ok], k[ok]
            if not len(i):
                continue
            order = np.lexsort((_mix(node[i], node[k]), i))
            i, k = i[order], k[order]
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            if (more := rank >= most).any():
                left = np.unique(key[i[more]]).view(np.int64)
                yield pa.RecordBatch.from_pydict({"a": pa.nulls(len(left), pa.int64()), "b": pa.nulls(len(left), pa.int64()), "key": left})
            a, b = node[i[~more]], node[k[~more]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            kept += len(a)
            if kept > 250_000:
                yield flush()
                kept = 0
        if found:
            yield flush()

    def by_part(batches):
        """The postings of one part after another."""
        at, own = None, []
        for batch in batches:
            for p in np.unique(batch.column("part").to_numpy()):
                if p != at and own:
                    yield from propose(own)
                at = p
                own.append(batch.filter(pa.compute.equal(batch.column("part"), int(p))))
        if own:
            yield from propose(own)

    packed = "part long, " + ", ".join(f"{c} binary" for c in kinds)
    dealt = rows.select("node", "comp", "weight", "size", "sig", "probe", "pos").mapInArrow(released(deal), packed).repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(released(by_part), "a long, b long, key long").distinct()


def _places(batch: pa.RecordBatch) -> list[bytes]:
    """The places of the probing ends' n-grams; null: all of them, from the far end of the order.  Made where they are read: one more Python step would be one more worker for each task."""
    return [np.arange(len(p) // 8 - 1, -1, -1, dtype=np.int32).tobytes() if at is None else at for p, at in zip(batch.column("probe").to_pylist(), batch.column("pos").to_pylist(), strict=True)]


def _open_postings(rows: DataFrame, bits) -> DataFrame:
    """The rows with the n-grams of their probing end, and their places, that `bits` (a broadcast bitmap) may hold."""

    def narrow(batches):
        for batch in _slices(batches):
            probes, places = [], []
            for p, at in zip(batch.column("probe").to_pylist(), _places(batch), strict=True):
                k, at = np.frombuffer(p, np.uint64), np.frombuffer(at, np.int32)
                hit = in_bitmap(bits.value, k.view(np.int64))
                probes.append(k[hit].tobytes())
                places.append(at[hit].tobytes())
            out = pa.RecordBatch.from_pydict({"node": batch.column("node"), "size": batch.column("size"), "sig": batch.column("sig"), "probe": pa.array(probes, pa.binary()), "pos": pa.array(places, pa.binary())})
            yield out.filter(pa.compute.greater(pa.compute.binary_length(out.column("probe")), 0))

    return rows.select("node", "size", "sig", "probe", "pos").mapInArrow(released(narrow), "node long, size int, sig binary, probe binary, pos binary")


class PrefixTree:
    """Sets in the global order as a tree.  A node is a run of n-grams that all sets below it share.

    node: [depth at which it begins, depth at which it ends, a set that has its n-grams, the longest set below, children, names]
    """

    def __init__(self, sets: list[tuple[int, np.ndarray]]) -> None:
        ordered = sorted(sets, key=lambda s: s[1].astype(">u8").tobytes())
        self.root: list = [0, 0, np.zeros(0, np.uint64), 0, [], []]
        path, before = [self.root], self.root[2]
        for name, s in ordered:
            m = min(len(before), len(s))
            off = np.flatnonzero(before[:m] != s[:m])
            common, last = int(off[0]) if len(off) else m, None
            while path[-1][1] > common:
                last = path.pop()
            if path[-1][1] < common:  # the node that went on is cut in two
                inner = [last[0], common, before, last[3], [last], []]
                path[-1][4][-1], last[0] = inner, common
                path.append(inner)
            if path[-1][1] < len(s):
                leaf = [common, len(s), s, 0, [], []]
                path[-1][4].append(leaf)
                path.append(leaf)
            path[-1][5].append(name)
            for node in path:
                node[3] = max(node[3], len(s))
            before = s

    def similar(self, probe: np.ndarray, percent: int, chunk: int = 256) -> list[tuple[int, int]]:
        """(name, overlap) of the sets that are similar enough."""
        out, todo, n = [], [(self.root, 0)], len(probe)
        while todo:
            (depth, end, s, longest, below, names), overlap = todo.pop()
            need = needed(longest, n, percent)  # what a shorter set has left falls short of its need by no less
            while depth < end and overlap + longest - depth >= need:
                part = s[depth : min(depth + chunk, end)]
                overlap += int((probe[np.minimum(np.searchsorted(probe, part), n - 1)] == part).sum())
                depth += len(part)
            if depth < end or overlap + longest - depth < need:
                continue
            if overlap >= needed(end, n, percent):
                out += [(name, overlap) for name in names]
            todo += [(node, overlap) for node in below]
        return out


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, overlap) of the pairs (a, b) that are similar; each a walks prefix trees of lots of its b."""
    lots = pairs.groupBy("a").agg(F.count("*").alias("m")).select(F.col("a").alias("k"), F.ceil(F.col("m") / LOT).cast("int").alias("lots"))
    dealt = pairs.join(lots, pairs["a"] == lots["k"]).select("a", "b", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"))
    members = dealt.join(sets.select(F.col("node").alias("b"), F.col("keys").alias("b_keys")), "b").select("a", "lot", "b", "b_keys")
    probes = lots.select(F.col("k").alias("a"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot")).join(sets.select(F.col("node").alias("a"), "keys"), "a")

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            probe = np.frombuffer(left["keys"][0].as_py(), np.uint64)
            tree = PrefixTree([(b, np.frombuffer(k, np.uint64)) for b, k in zip(right["b"].to_pylist(), right["b_keys"].to_pylist(), strict=True)])
            rows = [(left["a"][0].as_py(), b, o) for b, o in tree.similar(probe, percent)]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "b", "overlap"), cols, strict=True)})

    return probes.select("a", "lot", "keys").groupBy("a", "lot").cogroup(members.groupBy("a", "lot")).applyInArrow(walk, "a long, b long, overlap long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): for each linked node the smallest node of its component, by alternating large and small stars."""

    def content(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before, settled = content(edges), False
    for _ in range(rounds if before[0] else 0):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(low, F.col("u") == F.col("k"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        small = keep(small, "small-star")
        after = content(small)
        discard(edges, large)
        edges, settled = small, after == before
        before = after
        if settled:
            break
    if before[0] and not settled:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def _few(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if there are at most BROADCAST_IDS."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _screened(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps leave room for a link."""

    def test(batches):
        for batch in batches:
            cols = batch.to_pydict()
            ok = [100 * min(m, n) >= percent * max(m, n) and may_be_similar(x, m, y, n, percent) for x, m, y, n in zip(cols["x"], cols["m"], cols["y"], cols["n"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k, bits_name, size_name: bits.select(F.col("node").alias(k), F.col("bits").alias(bits_name), F.col("size").alias(size_name))
    return pairs.join(side("a", "x", "m"), "a").join(side("b", "y", "n"), "b").select("a", "b", "x", "m", "y", "n").mapInArrow(test, "a long, b long")


def join_ngrams(docs: DataFrame, n: int = 5, percent: int = 75, hot: int = HOT, proposed: int = PROPOSALS) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id that links reach), class_size."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(shared_ngrams(docs, n))
    rows = keep(documents_as_sets(docs, shared, n, percent), "ngram-sets")
    linkable = rows.where("n_shingles > 0 and doc_id is not null")
    classes = keep(linkable.groupBy("node", "node2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("n_shingles").alias("size")), "ngram-classes")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(64, int(total * (100 - percent) / 100 / 500_000))
    lead = keep(leaders(linkable, parts, hot), "ngram-met")
    met = lead.where("node is not null").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    long_lists = lead.where("node is null").select("leader", "n").toArrow().sort_by("leader")  # at most one for each `hot` postings
    hot_keys = long_lists["leader"].to_numpy().view(np.uint64)
    order = np.argsort(hot_keys)
    long_of = spark.sparkContext.broadcast((hot_keys[order], -(-long_lists["n"].to_numpy()[order] // hot)))
    touched = keep(met.select(F.col("a").alias("node")).union(met.select(F.col("b").alias("node"))).distinct().join(classes.select("node", "rep"), "node"), "ngram-touched")
    # one row for each class that met another, unless a document is there twice
    few = _few(touched).withColumnRenamed("node", "k")
    members = keep(linkable.join(few, (F.col("node") == F.col("k")) & (F.col("doc_id") == F.col("rep"))).select("node", F.col("n_shingles").cast("int").alias("size"), "bits", "sig", "probe"), "ngram-members")
    bits = keep(members.select("node", F.col("size").cast("long").alias("size"), "bits").dropDuplicates(["node"]), "ngram-bits")

    def sets_of(batches):
        shingler, order = Shingler(n), shared.value
        for batch in batches:
            nodes, keys = [], []
            for want, t in zip(batch.column("want").to_pylist(), utf8(batch.column("text")), strict=True):
                k = keys_of(shingler.of(t), order)
                if (xxhash.xxh3_128_intdigest(k.tobytes()) & ((1 << 64) - 1)) - (1 << 63) == want:
                    nodes.append(want)
                    keys.append(k.tobytes())
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "keys": pa.array(keys, pa.binary())})

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        """The links among candidate pairs.  Sets are made from the texts again, for the few classes that need it."""
        pairs = keep(_screened(pairs, bits, percent), f"{name}-candidates")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = keep(classes.join(nodes, "node").select(F.col("rep").alias("doc_id"), F.col("node").alias("want")), f"{name}-wanted")
        chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_few(wanted), "doc_id").select("want", "text")
        sets = keep(chosen.mapInArrow(released(sets_of), "node long, keys binary"), f"{name}-keys")
        found = keep(verify(pairs, sets.dropDuplicates(["node"]), percent).select("a", "b"), f"{name}-links")
        discard(pairs, wanted, sets)
        return found

    links = links_of(met, "ngram-first")
    comps = keep(components(links), "ngram-components")
    source = members.select("node", "size", "sig", "probe", F.lit(None).cast("binary").alias("pos"))
    spent: list[DataFrame] = []
    while True:
        weight = comps.groupBy("comp").agg(F.floor(F.log2(F.count("*").cast("double"))).cast("tinyint").alias("weight"))
        label = touched.select(F.col("node").alias("k")).join(comps, F.col("k") == F.col("node"), "left").select("k", F.coalesce("comp", "k").alias("comp"))
        label = keep(label.join(weight, "comp", "left").select("k", "comp", F.coalesce("weight", F.lit(0)).cast("tinyint").alias("weight")), "ngram-labels")
        labelled = source.join(_few(label), F.col("node") == F.col("k"))
        found = keep(proposals(labelled, parts, percent, proposed, long_of), "ngram-proposals")
        more = links_of(found.where("key is null").select("a", "b"), "ngram-more")
        still_open = found.where("key is not null").select("key").distinct()
        n_open = still_open.count()
        if n_open:
            open_lists = spark.sparkContext.broadcast(key_bitmap(still_open, n_open))
            narrowed = keep(_open_postings(source, open_lists), "ngram-open")
            open_lists.destroy()
        discard(label, found, *spent)
        if not more.isEmpty():
            links = links.union(more)
            comps = keep(components(links), "ngram-components")
        if not n_open:
            break
        source, spent, proposed = narrowed, [narrowed], proposed * GROWTH
    shared.destroy()
    long_of.destroy()
    # only classes with several members or links need more than their own id
    named = classes.join(comps, "node", "left").where("members > 1 or comp is not null").select("node", "node2", "rep", "members", "comp")
    low = named.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("low")).select(F.col("comp").alias("c"), "low")
    ids = keep(named.join(low, F.col("comp") == F.col("c"), "left").select(F.col("node").alias("k"), F.col("node2").alias("k2"), F.coalesce("low", "rep").alias("component"), "members"), "ngram-ids")
    discard(lead, touched, members, bits)
    out = rows.select("doc_id", "n_shingles", "node", "node2").join(ids, (F.col("node") == F.col("k")) & (F.col("node2") == F.col("k2")), "left")
    own = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(own, F.coalesce("component", "doc_id")).alias("component_id"), F.when(own, F.coalesce("members", F.lit(1))).alias("class_size"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The documents that stay when each component keeps only its smallest doc_id, with the columns they came with.

    Equal rows of that id are one document: one of them stays.  Rows without an id stay.
    """
    found = keep(join_ngrams(docs, n, percent), "ngram-found").where("doc_id is not null")
    own = free_name(docs, "kept_id")
    gone = keep(found.where("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct(), "ngram-gone")
    left = docs.join(_few(gone), F.col("doc_id") == F.col(own), "left_anti")
    twice = keep(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(own)), "ngram-twice")
    if twice.isEmpty():
        return left
    # only rows whose id is there more than once are compared with each other
    twice, same = _few(twice), F.col("doc_id") == F.col(own)
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
