"""Best-fit packing by exact complements.

Documents are cut into pieces of at most `capacity` tokens.  Only the histogram of piece lengths, which has
at most `capacity` entries, goes to the driver: there a plan says which lengths share a sequence and how
often.  For each length, longest first, an index of single, pair and triple sums finds lengths that fill the
gap exactly, as long as there are such pieces; what is left goes to the best fit.  Plans with fewer kinds of
complements are made, too, and the shortest is taken.  Pieces then get their number among the pieces of their length by a two-level running count, and the plan turns that number into
a sequence and a place.

Defined cases: a null or empty text is one piece that holds the end token; texts of any length are read
whole; equal rows are separate documents; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import bisect
import codecs
import gc
import json
import re
import zlib
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import keep, released, running_sum, utf8


def _byte_level() -> str:
    """The character that stands for each byte in a byte-level vocabulary; the end of a line stays."""
    out, more = [], 256
    for b in range(256):
        own = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b if own or b == 10 else more))
        more += not own
    return "".join(out)


_BYTE_LEVEL = _byte_level()


class _Words(dict):
    """Word -> its token ids as little-endian 32-bit numbers; in two generations, the older of which goes when the younger is full.

    The tokenizer drops white space and never joins across it, so that words can be encoded one by one.  It
    lowers letters, too, so that texts without marks of special tokens can be lowered first.  Words of plain
    lower-case letters are what its normalizer and splitter leave alone: these skip both and are encoded many
    at a time, since the last token of a word, and no other, carries the word-end suffix.  ASCII punctuation behind
    such a word is split off as a whole.  Other words of visible ASCII without capitals skip the normalizer.
    The words of a lot of texts become a dictionary column, so that Python sees each distinct one once.
    """

    #: Words on lines: a to z and the lower-case letters from U+00DF to U+00FF, then perhaps ASCII punctuation.
    PLAIN = re.compile(rb"^((?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++)([!-/:-@\[-`{-~]*)$", re.MULTILINE)
    VISIBLE = re.compile(rb"[!-@\[-~]+")
    #: White space to one kind of it, for whole texts; letters, too, unless there may be marks of special tokens.
    BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
    LOWER = bytes.maketrans(b"\t\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"     abcdefghijklmnopqrstuvwxyz")
    #: Words encoded at a time.
    LOT = 512

    def __init__(self, path: str, held: int = 250_000) -> None:
        self.held = held  # words in a generation, about 180 bytes each
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(path)
        self.plain, self.unchanged = Tokenizer(self.full.model), Tokenizer(self.full.model)  # one vocabulary in memory
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.unchanged.pre_tokenizer = self.full.pre_tokenizer
        vocabulary = spec["model"]["vocab"]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for token, k in vocabulary.items() if token.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.runs: dict[bytes, bytes] = {}  # punctuation behind words
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def _encode(tokenizer, words: list[bytes]) -> list[bytes]:
        ids = [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = np.cumsum([4 * len(x) for x in ids]).tolist()
        return [flat[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]

    def _encode_plain(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(words), self.LOT):
            lines = codecs.charmap_decode(b"\n".join(words[lo : lo + self.LOT]), "strict", _BYTE_LEVEL)[0]
            ids = np.array(self.plain.encode_batch_fast([lines], add_special_tokens=False)[0].ids, "<u4")
            flat, ends = ids.tobytes(), (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            out += [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not in the younger generation; they are there from now on."""
        out = {w: self.old[w] for w in words if w in self.old}
        words = words.difference(out)
        split = self.PLAIN.findall(b"\n".join(words))
        cores = {core for core, _ in split}
        for held in (self, self.old):
            out.update({core: held[core] for core in cores if core in held})
        new = list(cores.difference(out))
        out.update(zip(new, self._encode_plain(new), strict=True))
        if len(self.runs) > 20_000:
            self.runs.clear()
        runs = list({run for _, run in split}.difference(self.runs))
        self.runs.update(zip(runs, self._encode(self.full, runs), strict=True))
        run_ids = self.runs
        out.update({core + run: out[core] + run_ids[run] for core, run in split if run})
        rest = words.difference(out)
        visible = [w for w in rest if b"<|" not in w and self.VISIBLE.fullmatch(w)]
        other = list(rest.difference(visible))
        out.update(zip(visible, self._encode(self.unchanged, visible), strict=True))
        out.update(zip(other, self._encode(self.full, other), strict=True))
        if len(self) + len(out) > self.held:
            self.old = dict(self)
            self.clear()
        self.update(out)
        return out

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts."""
        gc.disable()  # many small objects: nothing to collect, much to walk through
        try:
            return self._encoded(texts)
        finally:
            gc.enable()

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        lot = b"".join([t.translate(self.BLANK if b"<|" in t else self.LOWER) + b" " for t in texts])
        spaces = np.flatnonzero(np.frombuffer(lot, np.uint8) == 32)
        starts = np.zeros(len(spaces) + 1, np.int64)
        starts[1:] = spaces + 1
        # each word has the one space behind it; between two spaces there is an empty word
        found = pa.Array.from_buffers(pa.large_binary(), len(spaces), [None, pa.py_buffer(starts), pa.py_buffer(lot)]).dictionary_encode()
        distinct = found.dictionary
        words = distinct.buffers()[2].to_pybytes()[: np.frombuffer(distinct.buffers()[1], np.int64)[len(distinct)] - 1].split(b" ")
        got = list(map(self.get, words))
        lacking = [k for k, ids in enumerate(got) if ids is None]
        if lacking:
            new = self.learn({words[k] for k in lacking})
            for k in lacking:
                got[k] = new[words[k]]
        flat = pa.array(got, pa.large_binary()).take(found.indices)
        ends = np.searchsorted(spaces, np.cumsum([len(t) + 1 for t in texts]))
        cuts = np.frombuffer(flat.buffers()[1], np.int64)[np.concatenate([[0], ends])].tolist()
        data = memoryview(flat.buffers()[2] or b"")
        return [bytes(data[lo:hi]) for lo, hi in pairwise(cuts)]


#: Text that is encoded at a time, about.
LOT_BYTES = 2_500_000
_WORDS: dict[str, _Words] = {}  # one for each tokenizer in a Python worker, kept from task to task


def _words(path: str, held: int) -> _Words:
    words = _WORDS.get(path)
    if words is None:
        words = _WORDS[path] = _Words(path)
    words.held = held
    return words


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 2048, with_ids: bool = False, held: int = 250_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's tokens and the end token, cut at `capacity`.

    A Python worker holds the ids of at most 2 * `held` words, with the words of one lot of texts beside them.
    """

    def cut(batches):
        if tokenizer:
            path = tokenizer
        else:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        words, end, step = _words(path, held), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            lot = min(max(1, LOT_BYTES * batch.num_rows // (batch.nbytes + 1)), 4096)
            for lo in range(0, len(ids), lot):
                rows = []
                for doc_id, own in zip(ids[lo : lo + lot], words.encoded(utf8(texts.slice(lo, lot))), strict=True):
                    data = own + end
                    for k, at in enumerate(range(0, len(data), step)):
                        part = data[at : at + step]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                cols = list(zip(*rows, strict=True))
                out = {"doc_id": pa.array(cols[0], pa.int64()), **{n: pa.array(c, pa.int64()) for n, c in zip(("piece", "start", "length", "ids_crc32"), cols[1:5], strict=True)}}
                if with_ids:
                    out["ids"] = pa.array(cols[5], pa.binary())
                out["piece"] = out["piece"].cast(pa.int32())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(cut), schema)


Plan = list[tuple[tuple[int, ...], int]]


def exact_first(counts: dict[int, int], capacity: int, most: int) -> Plan:
    """Exact complements of up to `most` lengths, longest pieces first; what is left goes to the longest that fits.

    Lengths that have pieces are the bits of one number, so that all pairs with a given sum are one AND.
    """
    c = [0] * (capacity + 1)
    for length, n in counts.items():
        c[length] = n
    here = sum(1 << a for a in range(1, capacity + 1) if c[a])
    mirror = sum(1 << (capacity - a) for a in range(1, capacity + 1) if c[a])
    out: Plan = []

    def times(lengths: tuple[int, ...]) -> int:
        return min(c[a] // lengths.count(a) for a in set(lengths))

    def use(lengths: tuple[int, ...], n: int) -> None:
        nonlocal here, mirror
        out.append((lengths, n))
        for a in lengths:
            c[a] -= n
            if not c[a]:
                here &= ~(1 << a)
                mirror &= ~(1 << (capacity - a))

    def down(bits: int):
        while bits:
            a = bits.bit_length() - 1
            yield a
            bits &= ~(1 << a)

    def pairs(total: int) -> int:
        """Bits of the larger lengths of pairs with this sum."""
        return (here & (mirror >> (capacity - total))) >> (total + 1) // 2 << (total + 1) // 2 if total > 1 else 0

    def exact(length: int) -> tuple[int, ...] | None:
        gap = capacity - length
        if gap and c[gap] and times((length, gap)):
            return (length, gap)
        if most > 1:
            for a in down(pairs(gap)):
                if times(found := (length, a, gap - a)):
                    return found
        if most > 2:
            for a in down(here & ((1 << max(gap - 1, 1)) - 1)):
                if 3 * a < gap:
                    break
                for b in down(pairs(gap - a)):
                    if b <= a and times(found := (length, a, b, gap - a - b)):
                        return found
        return None

    for length in range(capacity, 0, -1):
        if length == capacity:
            if c[length]:
                use((length,), c[length])
            continue
        while most and c[length] and (found := exact(length)):
            use(found, times(found))
    while here:
        lengths = [here.bit_length() - 1]
        gap = capacity - lengths[0]
        while gap:
            fit = next((a for a in down(here & ((1 << (gap + 1)) - 1)) if c[a] > lengths.count(a)), 0)
            if not fit:
                break
            lengths.append(fit)
            gap -= fit
        use(tuple(lengths), times(tuple(lengths)))
    return out


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest pieces first: each goes to the tightest gap it fits.  Sequences with equal contents are one entry."""
    by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []  # ascending
    full: Plan = []

    def add(gap: int, lengths: tuple[int, ...], n: int) -> None:
        if not gap:
            full.append((lengths, n))
            return
        if gap not in by_gap:
            bisect.insort(gaps, gap)
        by_gap.setdefault(gap, []).append((lengths, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (k := bisect.bisect_left(gaps, length)) < len(gaps):
            gap = gaps[k]
            lengths, n = by_gap[gap].pop()
            m = min(n, left)
            if n > m:
                by_gap[gap].append((lengths, n - m))
            if not by_gap[gap]:
                del by_gap[gap], gaps[k]
            add(gap - length, (*lengths, length), m)
            left -= m
        each = capacity // length
        if left >= each:
            add(capacity - each * length, (length,) * each, left // each)
        if left % each:
            add(capacity - left % each * length, (length,) * (left % each), 1)
    return full + [x for own in by_gap.values() for x in own]


def _counted(found: Plan) -> dict[int, int]:
    out: dict[int, int] = {}
    for lengths, n in found:
        for a in lengths:
            out[a] = out.get(a, 0) + n
    return out


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Which lengths share a sequence, and how many sequences are like that; every piece is used once.

    Exact complements of one, two and three further lengths come first, best fit takes what is left.  That may leave the
    last sequences short of pieces which exact ones have used up.  As long as fewer sequences are thinkable, the last of the plan
    are taken apart, twice as many each time, and their pieces are laid out once more: by complements of fewer lengths, which
    spare the short pieces, or by best fit.  The rest of the plan stays as it is.
    """
    found = exact_first(counts, capacity, 3)
    size = lambda p: sum(n for _, n in p)
    fewest = -(-sum(a * n for a, n in counts.items()) // capacity)
    full = [x for x in found if sum(x[0]) == capacity]
    open_ = [x for x in found if sum(x[0]) < capacity]
    again = 1
    while open_ and size(found) > fewest:
        at = max(0, len(full) - again)
        pool = _counted(full[at:] + open_)
        redone = min((exact_first(pool, capacity, most) for most in (2, 1, 0)), key=size)
        redone = min(redone, best_fit(pool, capacity), key=size)
        if size(full[:at]) + size(redone) < size(found):
            found = full[:at] + redone
        if not at:
            break
        again *= 2
    return found


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Append sequence_id and offset to rows that have length, doc_id, piece and ids_crc32."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if any(not 0 < a <= capacity for a in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    start, base, place, used, sequence = [], [], [], dict.fromkeys(counts, 0), 0
    for lengths, n in plan(counts, capacity):
        at = 0
        for a in lengths:
            start.append((a << 44) + used[a])
            base.append(sequence)
            place.append(at)
            used[a] += n
            at += a
        sequence += n
    order = np.argsort(np.array(start, np.int64), kind="stable")
    shared = spark.sparkContext.broadcast([np.array(x, np.int64)[order] for x in (start, base, place)])  # bounded by the plan, which the capacity bounds

    def assign(batches):
        keys, bases, places = shared.value
        for batch in batches:
            number = batch.column("__number").to_numpy()
            key = (batch.column("length").to_numpy() << 44) + number
            k = np.searchsorted(keys, key, "right") - 1
            rest = [n for n in batch.schema.names if n != "__number"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(bases[k] + key - keys[k]), pa.array(places[k])], [*rest, "sequence_id", "offset"])

    buckets = max(64, max(counts.values(), default=0) // 50_000)
    numbered = running_sum(cut, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), "__number", buckets)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return numbered.select(*cut.columns, "__number").mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 2048, held: int = 250_000) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  `held`: see `pieces`."""
    return pack(keep(pieces(docs, tokenizer, end_id, capacity, held=held), "pack-pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves, ids as little-endian 32-bit numbers."""
    placed = pack(keep(pieces(docs, tokenizer, end_id, capacity, with_ids=True), "pack-ids"), capacity)
    own = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    return own.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
