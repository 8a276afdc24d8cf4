"""Media, toxicity, quality rules and scoring against brute force, with the odd cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaymark.llm import jpeg_media, line_rules, suffix_lm, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "One two", "Ünï\x1c cødé \u3000 zażółć " * 40, "w " * 9000, "same text here", "same text here", "\x00\xff" * 70]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"


def odd(spark):
    """Nulls, empty and long texts, repeats, and columns whose names clash with results."""
    rows = [(i, t, "en", None, None, 9.0, None) for i, t in enumerate(ODD)] + [(6, "same text here", "en", "s", 1, None, True), (None, "no id at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# media


def test_media_round_trip(spark):
    got = jpeg_media.assess(odd(spark)).collect()
    assert len(got) == len(ODD) + 2
    for r, t in zip(got, [*ODD, "same text here", "no id at all"], strict=True):
        b = (t or "").encode()
        p = b + b"\0" * (-len(b) % 64 or 64 * (not b))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["payload_sha256"] == got[6]["payload_sha256"]}) == 1
    assert jpeg_media.assess(odd(spark).where("false")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=4))
def test_media_any_bytes(blobs):
    payloads = [b + b"\0" * (-len(b) % 64) for b in blobs]
    for p, t in zip(payloads, jpeg_media.thumbnails(jpeg_media.encode(payloads)), strict=True):
        assert t[3] == "" and t[2].tobytes() == p


def test_media_many_frames():
    p = np.random.default_rng(3).integers(0, 256, 64 * (jpeg_media.FRAME_ROWS + 3), dtype=np.uint8).tobytes()
    (media,) = jpeg_media.encode([p])
    w, h, samples, error = jpeg_media.thumbnails([media])[0]
    assert (w, h, error) == (512, 8 * (jpeg_media.FRAME_ROWS + 3), "") and samples.tobytes() == p


class Writer:
    """A slow baseline encoder for tests: any components, sampling and AC levels."""

    def __init__(self, interval=0):
        self.bits, self.out, self.interval, self.blocks, self.marker = "", b"", interval, 0, 0
        self.dc = jpeg_media._canonical({k: 4 for k in range(12)})
        self.ac = jpeg_media._canonical({0x00: 3, 0xF0: 4, **{run << 4 | cat: 8 for run in range(16) for cat in range(1, 9)}})

    def put(self, table, symbol, value=0, size=0):
        code, n = table[1][symbol]
        self.bits += f"{code:0{n}b}" + (f"{value if value >= 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    def block(self, diff, ac):
        n = abs(diff).bit_length()
        self.put(self.dc, n, diff, n)
        at = 0
        for k, v in ac:  # places 1..63, ascending
            run = k - at - 1
            while run > 15:
                self.put(self.ac, 0xF0)
                run -= 16
            n = abs(v).bit_length()
            self.put(self.ac, run << 4 | n, v, n)
            at = k
        if at < 63:
            self.put(self.ac, 0)

    def flush(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        self.out += bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        self.bits = ""

    def restart(self):
        self.flush()
        self.out += bytes([0xFF, 0xD0 + self.marker % 8])
        self.marker += 1


@pytest.mark.parametrize("interval", [0, 3])
def test_media_colour_with_ac(interval):
    """Three components at 4:2:0 with AC levels, interleaved, with and without restarts."""
    rng = np.random.default_rng(5)
    w = Writer()
    width, height = 40, 24  # 3 x 2 units of 16
    luma = rng.integers(-60, 60, (4, 6))
    pred, done = [0, 0, 0], 0
    for my in range(2):
        for mx in range(3):
            if interval and done and done % interval == 0:
                w.restart()
                pred = [0, 0, 0]
            for y in range(2):
                for x in range(2):
                    v = int(luma[2 * my + y, 2 * mx + x])
                    w.block(v - pred[0], [(int(k), int(rng.integers(1, 100))) for k in sorted(rng.choice(np.arange(1, 64), 4, replace=False))])
                    pred[0] = v
            for c in (1, 2):
                v = int(rng.integers(-50, 50))
                w.block(v - pred[c], [(63, -7)])
                pred[c] = v
            done += 1
    w.flush()
    seg = jpeg_media._segment
    data = b"\xff\xd8" + seg(0xFE, b"a comment") + seg(0xDB, b"\x00" + b"\x04" * 64) + seg(0xC0, bytes([8, 0, height, 0, width, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + seg(0xC4, b"\x00" + w.dc[0]) + seg(0xC4, b"\x10" + w.ac[0])
    data += (seg(0xDD, bytes([0, interval])) if interval else b"") + seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + w.out + b"\xff\xd9"
    got_w, got_h, samples, error = jpeg_media.thumbnails([data])[0]
    assert (got_w, got_h, error) == (width, height, "")
    assert (samples == np.clip(np.floor(luma[:3, :5] * 0.5 + 128.5), 0, 255)).all()


def test_media_broken(spark):
    good = jpeg_media.encode([b"x" * 64])[0]
    bad = [b"", b"text", good[:-2], good.replace(b"\xff\xc0", b"\xff\xc2"), good[:30]]
    assert all(t[3] for t in jpeg_media.thumbnails(bad))
    rows = spark.createDataFrame([(None,), (bytearray(b"no"),), (bytearray(good),)], "media binary")
    got = [r["features"] for r in jpeg_media.with_features(rows).collect()]
    assert got[0]["width"] is None and got[1]["error"] and got[2]["payload_sha256"] == hashlib.sha256(b"x" * 64).hexdigest()


# toxicity


def test_toxicity_learns_and_generalises(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = list(rng.choice(words, 30))
        if toxic:
            text.insert(int(rng.integers(0, 30)), "Slur,")
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.assess(docs, labels(spark, marks)).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    kept = toxicity.filter_documents(docs, labels(spark, marks))
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.collect()} & {r["doc_id"] for r in got if r["predicted"]}


def test_toxicity_odd_cases(spark):
    for marks in ([], [(1, 1, 0)], [(3, None, None), (None, 1, 1), (3, 1, 1), (3, 1, 0)]):
        got = toxicity.assess(odd(spark), labels(spark, marks)).collect()
        assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    same = [r["score"] for r in got if r["doc_id"] in (6, 7)]
    assert len(set(same)) == 1
    assert toxicity.filter_documents(odd(spark), labels(spark, [])).columns == odd(spark).columns
    assert toxicity.assess(odd(spark).where("false"), labels(spark, [])).count() == 0


def test_toxicity_reads_no_other_column(spark, data):
    docs, marks = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.train(docs, marks)
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    again = toxicity.train(changed, marks)
    assert (model["at"] == again["at"]).all() and (model["w"] == again["w"]).all()


# quality rules


def base_counts(text):
    words = WORD.findall(text)
    tri = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i in range(len(words) - 2):
        if tri[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(inside)


def test_quality_base_counts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = odd(spark).select("doc_id", "text").union(spark.createDataFrame([(77, "a b c d a b c d a\na b c\n \n \na b c\r\n" * 3)], "doc_id long, text string"))
    every = docs.select("doc_id", "text").union(extra)
    got = line_rules.assess(every, spark.read.parquet(f"{data}/labels.parquet")).collect()
    for r, (i, t) in zip(got, every.collect(), strict=True):
        want = base_counts(t or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{d}/labels.parquet")
    got = line_rules.assess(spark.read.parquet(f"{d}/documents.parquet"), marks).join(marks, "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in got]) > 0.95


def test_quality_odd_cases(spark):
    docs = odd(spark)
    for marks in ([], [(None, 1, 0)], [(3, 1, 0), (4, 0, 0)]):
        assert line_rules.assess(docs, labels(spark, marks)).count() == len(ODD) + 2
    kept = line_rules.filter_documents(docs, labels(spark, []))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {4, 5}
    assert line_rules.filter_documents(docs.where("false"), labels(spark, [])).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=7), st.lists(st.integers(-3, 3), min_size=4, max_size=4))
def test_viterbi_is_the_best_path(emit, trans):
    import itertools

    e, t = np.array(emit, float), np.array(trans, float).reshape(2, 2)
    score = lambda p: sum(e[i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False))
    assert score(line_rules.viterbi(e, t)) == max(map(score, itertools.product((0, 1), repeat=len(e))))


# language model


def base_score(text, counts, total, distinct):
    tokens = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]
    return len(tokens), sum(counts[t] > 0 for t in tokens), sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)


def check_scores(docs, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = collections.Counter()
    for i, t in rows:
        if not held(i):
            counts.update(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None])
    total, distinct = sum(counts.values()), len(counts)
    got = suffix_lm.assess(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t in rows:
        n, known, s = base_score(t, counts, total, distinct)
        want[i, held(i), n, known, total, round(s, 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    return got


def test_lm_base_scores(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = check_scores(docs, docs.select("doc_id", "text").collect())
    own = [r for r in got if not r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_lm_odd_cases(spark):
    docs = odd(spark)
    check_scores(docs, docs.select("doc_id", "text").collect())
    one = docs.where("doc_id = 7")  # crc32("7") % 10 is not 0
    check_scores(one, one.select("doc_id", "text").collect())
    assert suffix_lm.assess(docs.where("false")).count() == 0


def test_lm_is_a_distribution(spark):
    """The probabilities of all symbols behind any context sum to 1, the unseen one included."""
    rng = np.random.default_rng(2)
    chain = {"a": "bbbbc", "b": "ca", "c": "aab"}
    texts = []
    for _ in range(400):
        w = ["a"]
        while len(w) < 20:
            w.append(str(rng.choice(list(chain[w[-1]]))))
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _ = suffix_lm.train_tree(docs)
    assert len(model["k1"]) and (model["rest1"] < 1).any()
    symbols = range(len(model["numbers"]))
    unseen = 0.1 / model["norm"]
    for context in ([], [0], [1], [0, 1], [1, 2], [2, 0]):
        p = 0.0
        for s in symbols:
            x = np.array([*context, s])
            p += 10 ** (suffix_lm.score_tokens(x, model)[1] - (suffix_lm.score_tokens(x[:-1], model)[1] if context else 0))
        x = np.array([*context, -5])
        p += unseen * 10 ** (suffix_lm.score_tokens(x, model)[1] - (suffix_lm.score_tokens(x[:-1], model)[1] if context else 0))
        assert abs(p - 1) < 1e-9
