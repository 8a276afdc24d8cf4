"""Media columns: baseline JPEG.

Reading parses the markers, Huffman-decodes the scans and rebuilds the DC-only luminance thumbnail (one
sample for each 8x8 block) in numpy; a row gets its dimensions, its thumbnail and a hash of it.  Any
baseline file is read (several components, subsampling, AC coefficients, restart intervals).  Scans of one
component whose blocks are DC-only are decoded many at a time: all restart segments of a batch advance
block by block, each by one look in a table over the next 16 bits.

Writing stores a payload losslessly in that form: one byte is the DC level of one block (quantiser 8, so
that the thumbnail sample is the byte), 64 blocks to a row, a restart marker after each row.  A payload
longer than one frame can hold goes on in further frames behind the first.

Defined cases: a null or empty text is a payload of 64 zero bytes; texts are padded with zero bytes to a
multiple of 64; texts of any length are stored whole; equal texts give equal media; null media has null
features; bytes that are no baseline JPEG have null features and say why in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import utf8

ROW = 64
FRAME_ROWS = 8191  # 65,528 lines
#: The Huffman tables of stored media.  Code lengths of the DC categories 0 to 8, and of end-of-block.
DC_LENGTHS = (4, 4, 3, 3, 3, 3, 3, 3, 4)
AC_LENGTHS = {0: 1}


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The body of a DHT table, and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    bits = bytes(sum(lengths[s] == n for s in order) for n in range(1, 17))
    return bits + bytes(order), _codes(bits, order)


def _codes(bits: bytes, symbols) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for n, many in enumerate(bits, 1):
        for _ in range(many):
            out[symbols[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return out


_DC_BODY, _DC = _canonical(dict(enumerate(DC_LENGTHS)))
_AC_BODY, _AC = _canonical(AC_LENGTHS)


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 (place 0) to 255: code with its bits and end-of-block, and the length."""
    code, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        c, n = _DC[cat]
        v = (c << cat) | (d if d >= 0 else d + (1 << cat) - 1)
        e, m = _AC[0]
        code[d + 255], length[d + 255] = (v << m) | e, n + cat + m
    return code, length


_CODE, _LENGTH = _diff_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    """All markers in front of the scan data of a frame with so many block rows."""
    return b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x08" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + b"\x01\x11\x00") + _segment(0xC4, b"\x00" + _DC_BODY) + _segment(0xC4, b"\x10" + _AC_BODY) + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def encode(payloads: list[bytes]) -> list[bytes]:
    """Payloads, each a positive multiple of 64 bytes, as JPEG frames."""
    sizes = [len(p) // ROW for p in payloads]
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int64) - 128
    n = len(rows)
    if not n:
        return []
    diffs = np.diff(rows, axis=1, prepend=0) + 255
    length = np.empty((n, ROW + 1), np.int64)
    length[:, :ROW] = _LENGTH[diffs]
    length[:, ROW] = -length[:, :ROW].sum(axis=1) % 8
    code = np.empty((n, ROW + 1), np.uint64)
    code[:, :ROW] = _CODE[diffs]
    code[:, ROW] = (np.uint64(1) << length[:, ROW].astype(np.uint64)) - np.uint64(1)
    flat = length.ravel()
    at = np.cumsum(flat) - flat
    word = at >> 5
    v = code.ravel() << (64 - flat - (at & 31)).astype(np.uint64)
    total = int(at[-1] + flat[-1])
    # codes do not overlap, so that sums are the bits of all; a word of 32 bits is exact in a double
    words = np.bincount(word, (v >> np.uint64(32)).astype(np.float64), total // 32 + 2) + np.bincount(word + 1, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), total // 32 + 2)
    raw = words.astype(np.uint64).astype(">u4").view(np.uint8)[: total // 8]
    row_end = np.cumsum(length.sum(axis=1)) // 8
    full = raw == 255
    # each byte moves behind the zeros stuffed after 0xFF and the two marker bytes after each row before it
    row_of = np.repeat(np.arange(n), np.diff(row_end, prepend=0))
    to = np.arange(len(raw)) + (np.cumsum(full) - full) + 2 * row_of
    out = np.zeros(len(raw) + int(full.sum()) + 2 * n, np.uint8)
    out[to] = raw
    stuffed = np.concatenate([[0], np.cumsum(full)])[row_end]
    end = row_end + stuffed + 2 * np.arange(1, n + 1)  # behind the marker of each row
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    number = np.arange(n) - np.repeat(first, sizes)
    out[end - 2] = 0xFF
    out[end - 1] = 0xD0 + (number % FRAME_ROWS) % 8
    data, made, begin = out.tobytes(), [], 0
    for lo, size in zip(first.tolist(), sizes, strict=True):
        parts = []
        for k in range(0, size, FRAME_ROWS):
            m = min(FRAME_ROWS, size - k)
            stop = int(end[lo + k + m - 1])
            parts += [_head(m), data[begin : stop - 2], b"\xff\xd9"]
            begin = stop
        made.append(b"".join(parts))
    return made


class Frame:
    """What the markers of one frame say: size, components, tables and where the scans are."""

    def __init__(self) -> None:
        self.quant: dict[int, int] = {}
        self.huff: dict[int, bytes] = {}
        self.interval = self.width = self.height = 0
        self.components: list[tuple[int, int, int, int]] = []  # id, h, v, quantiser
        self.scans: list[tuple[list[tuple[int, bytes, bytes]], int, int, int]] = []  # (component, DC table, AC table), begin, end, interval


def parse(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """Read the markers of the frame that starts at `at`; the frame and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, f = at + 2, Frame()
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 2 or data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            if not f.components:
                raise ValueError("no frame header")
            return f, at
        size = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("a segment is cut off")
        at += size
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                f.quant[k] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                many = sum(body[1:17])
                f.huff[body[0]] = body[1 : 17 + many]
                body = body[17 + many :]
        elif marker in (0xC0, 0xC1):
            depth, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not f.width or not f.height:
                raise ValueError("not 8 bits a sample, or an empty frame")
            f.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            f.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            ids = {c[0]: k for k, c in enumerate(f.components)}
            scan = [(ids[body[1 + 2 * k]], f.huff[body[2 + 2 * k] >> 4], f.huff[0x10 | body[2 + 2 * k] & 15]) for k in range(body[0])]
            end = at
            while True:  # the scan goes on until a marker that is neither a stuffed zero nor a restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("the scan has no end")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            f.scans.append((scan, at, end, f.interval))
            at = end


@lru_cache(32)
def _lookup(body: bytes) -> list[tuple[int, int]]:
    """For each 16 bits: (symbol, code length); length 0 where no code fits."""
    out = [(0, 0)] * 65536
    for s, (code, n) in _codes(body[:16], body[16:]).items():
        lo = code << (16 - n)
        out[lo : lo + (1 << (16 - n))] = [(s, n)] * (1 << (16 - n))
    return out


@lru_cache(32)
def _block_lookup(dc: bytes, ac: bytes) -> np.ndarray:
    """For each 16 bits: difference * 32 + length of a whole DC-only block; length 0 where it is not one or too long."""
    out = np.zeros(65536, np.int32)
    end = _codes(ac[:16], ac[16:]).get(0)
    if end:
        for cat, (code, n) in _codes(dc[:16], dc[16:]).items():
            if n + cat + end[1] <= 16:
                for bits in range(1 << cat):
                    d = bits if not cat or bits >> (cat - 1) else bits - (1 << cat) + 1
                    m = n + cat + end[1]
                    lo = ((((code << cat) | bits) << end[1]) | end[0]) << (16 - m)
                    out[lo : lo + (1 << (16 - m))] = d * 32 + m
    return out


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big") << 16, 8 * len(data) + 16  # zeros behind the end

    def peek(self) -> int:
        return (self.value >> (self.left - 16)) & 0xFFFF if self.left >= 16 else 0

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the scan ends too early")
        return (self.value >> self.left) & ((1 << n) - 1) if n else 0

    def symbol(self, table: list[tuple[int, int]]) -> int:
        s, n = table[self.peek()]
        if not n:
            raise ValueError("no such code")
        self.take(n)
        return s

    def difference(self, table: list[tuple[int, int]]) -> int:
        cat = self.symbol(table)
        v = self.take(cat)
        return v if not cat or v >> (cat - 1) else v - (1 << cat) + 1


def _grid(f: Frame, c: int) -> tuple[int, int]:
    """Blocks of a component down and across, as a scan of that component alone has them."""
    hs, vs = max(x[1] for x in f.components), max(x[2] for x in f.components)
    return -(-(-(-f.height * f.components[c][2] // vs)) // 8), -(-(-(-f.width * f.components[c][1] // hs)) // 8)


def _decode_scan(f: Frame, data: bytes, scan, begin: int, end: int, interval: int, levels: dict[int, np.ndarray]) -> None:
    """Any baseline scan, one symbol at a time: DC levels of component 0, the rest is skipped."""
    parts, lo, at = [], begin, begin
    while (at := data.find(b"\xff", at, end)) >= 0:
        if data[at + 1]:
            parts.append(data[lo:at])
            lo = at + 2
        at += 2
    parts.append(data[lo:end])
    hs, vs = max(x[1] for x in f.components), max(x[2] for x in f.components)
    if len(scan) == 1:
        down, across = _grid(f, scan[0][0])
        blocks = [(scan[0][0], 0, 0)]
    else:
        down, across = -(-f.height // (8 * vs)), -(-f.width // (8 * hs))
        blocks = [(c, y, x) for c, _, _ in scan for y in range(f.components[c][2]) for x in range(f.components[c][1])]
    tables = {c: (_lookup(dc), _lookup(ac)) for c, dc, ac in scan}
    size = {c: (1, 1) if len(scan) == 1 else (f.components[c][2], f.components[c][1]) for c, _, _ in scan}
    total, done = down * across, 0
    for part in parts:
        bits, pred = _Bits(part.replace(b"\xff\x00", b"\xff")), dict.fromkeys(tables, 0)
        for _ in range(min(interval or total, total - done)):
            my, mx = divmod(done, across)
            for c, y, x in blocks:
                pred[c] += bits.difference(tables[c][0])
                if c == 0:
                    ty, tx = my * size[c][0] + y, mx * size[c][1] + x
                    if ty < levels[0].shape[0] and tx < levels[0].shape[1]:
                        levels[0][ty, tx] = pred[c]
                k = 1
                while k < 64:
                    s = bits.symbol(tables[c][1])
                    run, cat = s >> 4, s & 15
                    if not cat and run != 15:
                        break
                    k += run + 1
                    bits.take(cat)
            done += 1
    if done < total:
        raise ValueError("the scan has too few blocks")


def _sample(levels: np.ndarray, quant: int) -> np.ndarray:
    """DC levels as samples: the mean of a block is an eighth of its DC coefficient, and 128 is zero."""
    return np.clip(np.floor(levels * (quant / 8) + 128.5), 0, 255).astype(np.uint8)


def thumbnails(files: list[bytes | None]) -> list[tuple[int, int, np.ndarray, str] | None]:
    """For each file (width, height, samples, error); the samples of further frames follow below those of the first."""
    frames: list[list[Frame]] = []
    out: list = []
    fast: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
    for i, data in enumerate(files):
        frames.append([])
        out.append(None)
        if data is None:
            continue
        try:
            at = 0
            while at < len(data):
                f, at = parse(data, at)
                frames[i].append(f)
                f.levels = {0: np.zeros(_grid(f, 0), np.int64)}
                if len(f.components) == 1 and len(f.scans) == 1:
                    (_, dc, ac), *_ = f.scans[0][0]
                    fast.setdefault((dc, ac), []).append((i, len(frames[i]) - 1))
            if not frames[i]:
                raise ValueError("no start of image")
        except (ValueError, KeyError, IndexError, struct.error) as e:
            out[i] = (0, 0, np.zeros((0, 0), np.uint8), str(e) or "broken markers")
    done: set[tuple[int, int]] = set()
    for (dc, ac), group in fast.items():
        done |= _decode_together([(files[i], frames[i][k], (i, k)) for i, k in group if out[i] is None], _block_lookup(dc, ac))
    for i, data in enumerate(files):
        if data is None or out[i] is not None:
            continue
        try:
            for k, f in enumerate(frames[i]):
                if (i, k) not in done:
                    if not f.scans:
                        raise ValueError("no scan")
                    for scan, begin, end, interval in f.scans:
                        if any(c == 0 for c, _, _ in scan):
                            _decode_scan(f, data, scan, begin, end, interval, f.levels)
            parts = [_sample(f.levels[0], f.quant.get(f.components[0][3], 8)) for f in frames[i]]
            same = len({p.shape[1] for p in parts}) == 1
            out[i] = (frames[i][0].width, sum(f.height for f in frames[i]), np.concatenate(parts) if same else parts[0], "")
        except (ValueError, KeyError, IndexError) as e:
            out[i] = (0, 0, np.zeros((0, 0), np.uint8), str(e) or "broken scan")
    return out


def _decode_together(items: list, lookup: np.ndarray) -> set:
    """Decode DC-only scans of one component side by side; returns those that came out whole."""
    if not items:
        return set()
    data = np.frombuffer(b"".join(d[f.scans[0][1] : f.scans[0][2]] + b"\xff\xd0" for d, f, _ in items), np.uint8)
    ff = np.flatnonzero(data[:-1] == 255)
    after = data[ff + 1]
    keep = np.ones(len(data), bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[after != 0]  # restart markers; one of our own ends each scan
    keep[marks] = False
    keep[marks + 1] = False
    kept_before = np.cumsum(keep)
    starts = np.concatenate([[0], kept_before[marks[:-1] + 1]])
    clean = np.concatenate([data[keep], np.zeros(4, np.uint8)]).astype(np.uint32)
    three = (clean[:-2] << 16) | (clean[1:-1] << 8) | clean[2:]
    scan_end = np.cumsum([f.scans[0][2] - f.scans[0][1] + 2 for _, f, _ in items]) - 2
    last = np.searchsorted(marks, scan_end)  # the number of the last segment of each scan
    first = np.concatenate([[0], last[:-1] + 1])
    need = np.zeros(len(starts), np.int64)
    bad_items = set()
    for j, (_, f, _) in enumerate(items):
        down, across = f.levels[0].shape
        total, interval = down * across, f.scans[0][3] or down * across
        n = last[j] - first[j] + 1
        if n != -(-total // interval):
            bad_items.add(j)
            continue
        need[first[j] : last[j] + 1] = interval
        need[last[j]] = total - interval * (n - 1)
    longest = int(need.max(initial=0))
    levels = np.zeros((len(starts), longest), np.int32)
    pos, pred, broken = starts.astype(np.int64) * 8, np.zeros(len(starts), np.int32), np.zeros(len(starts), bool)
    limit = len(three) - 1
    even = bool((need == longest).all())
    for k in range(longest):
        entry = lookup[(three[np.minimum(pos >> 3, limit)] >> (8 - (pos & 7)).astype(np.uint32)) & 0xFFFF]
        step = entry & 31
        live = step > 0 if even else (step > 0) | (need <= k)
        if not live.all():
            broken |= ~live
        pred = pred + (entry >> 5)
        levels[:, k] = pred
        pos += step
    whole = set()
    for j, (_, f, key) in enumerate(items):
        lo, hi = first[j], last[j] + 1
        if j not in bad_items and not broken[lo:hi].any():
            own = levels[lo:hi]
            flat = own.ravel() if need[lo] == longest else own[:, : need[lo]].ravel()
            f.levels[0] = flat[: f.levels[0].size].reshape(f.levels[0].shape)
            whole.add(key)
    return whole


def thumbnail_hash(samples: np.ndarray) -> str:
    """64 bits: on a grid of 8 rows and 9 columns of cells, is the mean of a cell's samples larger than that before it.

    A thumbnail of fewer rows or columns repeats them.
    """
    if not samples.size:
        return "0" * 16
    h, w = samples.shape
    y, x = np.arange(9) * h // 8, np.arange(10) * w // 9
    rows, cols = np.maximum(np.diff(y), 1), np.maximum(np.diff(x), 1)
    g = np.add.reduceat(np.add.reduceat(samples.astype(np.int64), y[:-1], axis=0), x[:-1], axis=1) / (rows[:, None] * cols[None, :])
    return np.packbits(g[:, 1:] > g[:, :-1]).tobytes().hex()


def _groups(sizes: list[int], most: int = 1 << 20):
    """Ranges of rows whose sizes add up to about `most`."""
    lo = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield lo, k + 1
            lo, total = k + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def _store(texts: pa.Array) -> pa.Array:
    out: list[bytes] = []
    rows = utf8(texts)
    for lo, hi in _groups([len(t) for t in rows]):
        out += encode([t + b"\0" * (-len(t) % ROW or ROW * (not t)) for t in rows[lo:hi]])
    return pa.array(out, pa.binary())


FEATURES = "width int, height int, thumbnail_hash string, error string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def _read(media: pa.Array) -> pa.Array:
    rows = media.to_pylist()
    out: list = []
    for lo, hi in _groups([len(m or b"") for m in rows]):
        for m, t in zip(rows[lo:hi], thumbnails(rows[lo:hi]), strict=True):
            if t is None:
                out.append((None,) * 9)
                continue
            w, h, samples, error = t
            stored = (len(m), hashlib.sha256(m).hexdigest())
            if error:
                out.append((None, None, None, error, None, None, None, *stored))
            else:
                p = samples.tobytes()
                out.append((w, h, thumbnail_hash(samples), "", len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ROW:]), *stored))
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = [{"int": pa.int32(), "string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in FEATURES.split(", ")]
    cols = list(zip(*out, strict=True)) or [()] * 9
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def with_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Append a column with the text's payload as JPEG bytes."""
    return df.withColumn(media, F.arrow_udf(_store, "binary")(F.col(text)))


def with_features(df: DataFrame, media: str = "media", features: str = "features") -> DataFrame:
    """Append a struct of dimensions, thumbnail hash, error, and digests of the thumbnail samples and of the file."""
    return df.withColumn(features, F.arrow_udf(_read, FEATURES)(F.col(media)).alias(features))


def assess(docs: DataFrame) -> DataFrame:
    """One row for each document: what its stored media says, read back from the stored bytes."""
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    rows = with_features(with_media(rows)).select("doc_id", "n_bytes", "features.*")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws("x", "width", F.concat_ws(":", "height", "thumbnail_hash")).alias("feature"))
