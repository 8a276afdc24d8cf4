"""Near copies, mixing, packing, sharding, chat windows, archive and the pipeline against brute force."""

import base64
import collections
import functools
import hashlib
import itertools
import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaymark.llm import chat_windows, maglev, mixing, ngram_join, packing, queries, warc_store

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), None, "clash") for i, t, s in rows], DOCS)


# near copies


def brute_components(rows):
    """Component of each row of (doc_id, text): by links between sets of word 5-grams."""
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
            up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return collections.Counter((d, len(sets[i]), None if d is None else low[top(i)]) for i, (d, _) in enumerate(rows))


def ngrams_of(docs):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_ngrams(docs).collect())


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.integers(1 << 30)}" for w in words]


def test_join_finds_every_link(spark):
    rng = np.random.default_rng(7)
    texts = []
    passage = [f"p{k}" for k in range(60)]
    for g in range(12):
        base = [f"g{g}w{k}" for k in rng.integers(0, 400, 120)]
        for _ in range(int(rng.integers(1, 7))):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.03]))))
    for k in range(25):  # a shared passage with own words around it: few of these are similar
        texts.append(" ".join(passage + [f"own{k}x{j}" for j in range(int(rng.integers(0, 60)))]))
    texts += ["", None, "a b", "A  b", "a b c d", "one two three four five", "ONE two\tthree four\nfive", "x " * 5000, "x " * 5001]
    order = rng.permutation(len(texts))
    rows = [(int(order[k]) * 10, t) for k, t in enumerate(texts)] + [(None, texts[0]), (5, texts[0]), (5, texts[0])]
    assert ngrams_of(docs_of(spark, [(i, t, None) for i, t in rows]).repartition(5)) == brute_components(rows)


def test_join_of_nothing(spark):
    empty = docs_of(spark, [(1, "a", None)]).where("false")
    assert ngram_join.join_ngrams(empty).count() == 0
    assert ngrams_of(docs_of(spark, [(1, None, None), (2, "", None)])) == {(1, 0, 1): 1, (2, 0, 2): 1}


def test_places_are_made_where_they_are_read():
    probe = pa.array([np.arange(3, dtype=np.uint64).tobytes(), b"", np.arange(2, dtype=np.uint64).tobytes()], pa.binary())
    pos = pa.array([None, None, np.array([9, 4], np.int32).tobytes()], pa.binary())
    got = ngram_join._places(pa.RecordBatch.from_pydict({"probe": probe, "pos": pos}))
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [[2, 1, 0], [], [9, 4]]


def test_keep_one(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = docs_of(spark, [(3, text, "a"), (1, text + " x", "b"), (1, text + " x", "b"), (2, "other words", "c"), (None, text, "d")])
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [(False, 1), (False, 2), (True, 0)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 40), min_size=1, max_size=14), min_size=1, max_size=8), st.frozensets(st.integers(0, 40), min_size=1, max_size=14))
def test_prefix_tree(sets, probe):
    array = lambda s: np.array(sorted(s), np.uint64)
    tree = ngram_join.PrefixTree([(k, array(s)) for k, s in enumerate(sets)])
    want = sorted((k, len(s & probe)) for k, s in enumerate(sets) if 100 * len(s & probe) >= 75 * len(s | probe))
    assert sorted(tree.similar(array(probe), 75, chunk=3)) == want
    for s in sets:  # the screen never loses a link
        if 100 * len(s & probe) >= 75 * len(s | probe):
            assert ngram_join.may_be_similar(ngram_join.bitmap(array(s)), len(s), ngram_join.bitmap(array(probe)), len(probe), 75)


# mixing


def brute_targets(sizes):
    """Rounds of sharing out, as the words say it: weights 5, 2, 1, stops at twice the size, excess reshared."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, live = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and live:
        each, total = left, sum(weight[s] for s in live)
        left = 0.0
        for s in list(live):
            target[s] += each * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                live.discard(s)
    return target


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), rng.choice(["a", "b", "ä", "z", ""])) for i in range(200)] + [(900, None, "a"), (901, "", None), (902, "x y z", None), (903, "hot " * 30000, "hot"), (0, "again", "a"), (0, "again", "a"), (None, "no id", "b")]
    docs = docs_of(spark, [(i, t, None if s is None else str(s)) for i, t, s in rows])
    got = mixing.taken(docs).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((i, len((t or "").split())) for i, t, _ in rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[None if s is None else str(s)] += len((t or "").split())
    want = brute_targets(dict(sizes))
    by = {(v, round(want[k], 6)) for k, v in sizes.items()}
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == by
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    taken = collections.Counter()
    for r in got:
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert all(abs(n - target) <= 1 for (_, target), n in taken.items())
    again = mixing.taken(docs.repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))


def test_shards_draw_and_totals_hold(spark):
    goals = spark.createDataFrame([("a", 5000, 7500.0), ("b", 3001, 800.4), (None, 77, 154.0), ("c", 10, 0.2), ("d", 0, 0.0)], "source string, source_size long, target double")
    block, shards = 16, 9
    got = mixing.draw(goals, shards, block, 7).collect()
    slots = {}
    for source, size, target in (("a", 5000, 7500.0), ("b", 3001, 800.4), (None, 77, 154.0)):
        want = min(int(target + 0.5), 2 * size)
        slots[source] = want // size * -(-size // block) + -(-(want % size) // block)
    by_source, by_shard, at = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in got:
        by_source[r["source"]] += r["n_slots"]
        by_shard[r["shard"]] += r["n_slots"]
        at[r["source"]].append((r["first_slot"], r["n_slots"]))
    assert by_source == slots
    total = sum(slots.values())
    assert by_shard == {k: total // shards + (k < total % shards) for k in range(shards)}
    for own in at.values():  # slot numbers of a source are used once each
        assert sorted(i for first, n in own for i in range(first, first + n)) == list(range(sum(n for _, n in own)))
    assert len({r["n_slots"] for r in got if r["source"] == "b"}) > 1  # drawn, not shared out evenly


def test_slots_take_each_block_once_a_turn(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(1 + i * 7 % 40)), "ab"[i % 2]) for i in range(60)]
    places = mixing.place(docs_of(spark, rows))
    _, spans = mixing.mix(places, block=16, shard_words=300)
    taken = collections.Counter()
    for r in spans.collect():
        assert 0 <= r["from_word"] < r["to_word"] <= r["size"] and r["to_word"] - r["from_word"] <= 16
        for w in range(r["from_word"], r["to_word"]):
            taken[r["doc_id"], r["turn"], w] += 1
    assert max(taken.values()) == 1


def test_mix_texts_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "s", "spans", 1, "k", "d"), (2, "d e", "s", "x", 2, "k", "d"), (None, None, None, None, None, None, None)], "doc_id long, text string, source string, spans string, __key int, mix_key string, mix_doc string")
    out = mixing.mixed_texts(df)
    assert out.columns == df.columns and {(r["doc_id"], r["spans"], r["__key"], r["mix_key"]) for r in out.collect()} <= {(1, "spans", 1, "k"), (2, "x", 2, "k")}
    kept = ngram_join.keep_one(df.withColumn("__id", F.lit(5)).withColumn("kept_id", F.lit("x")))
    assert kept.columns == [*df.columns, "__id", "kept_id"] and kept.count() == 3


def test_mix_texts_and_nothing(spark):
    docs = docs_of(spark, [(1, "a b\nc  d " * 90, "s"), (2, "e f g", "s"), (3, None, None)])
    out = mixing.mixed_texts(docs, block=16)
    assert out.columns == docs.columns
    words = sum(len((r["text"] or "").split()) for r in out.collect())
    assert words == sum(r["taken"] for r in mixing.taken(docs, block=16).collect())
    assert mixing.taken(docs.where("false")).count() == 0 and mixing.mixed_texts(docs.where("false")).count() == 0
    assert [r["taken"] for r in mixing.taken(docs.where("doc_id = 3")).collect()] == [0]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 99))
def test_permutation(size, key):
    assert sorted(mixing.permuted(np.arange(size), size, key)) == list(range(size))


# packing


def decreasing(counts, capacity, tightest):
    """How many sequences first fit or best fit needs, longest pieces first."""
    bins = []
    for a in sorted((a for a, n in counts.items() for _ in range(n)), reverse=True):
        fits = [k for k, b in enumerate(bins) if b + a <= capacity]
        if not fits:
            bins.append(a)
        else:
            bins[max(fits, key=lambda k: bins[k]) if tightest else fits[0]] += a
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 30), min_size=1, max_size=12))
@example({1: 1, 2: 1, 3: 1, 4: 1, 8: 17, 17: 13})
def test_plan_uses_every_piece_once(counts):
    used = collections.Counter()
    sequences = 0
    for lengths, n in packing.plan(counts, 32):
        assert sum(lengths) <= 32 and n > 0
        sequences += n
        for a in lengths:
            used[a] += n
    assert used == collections.Counter(counts)
    assert sequences <= min(decreasing(counts, 32, False), decreasing(counts, 32, True))
    assert sum(n for _, n in packing.best_fit(counts, 32)) == decreasing(counts, 32, True)


def fewest(sizes, capacity):
    """The least number of sequences, by trying everything."""
    best = len(sizes)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[k] <= capacity and bins[j] not in bins[:j]:
                put(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1 :]])
        put(k + 1, [*bins, sizes[k]])

    put(0, [])
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=8))
def test_plan_of_few_pieces_is_near_the_best(sizes):
    got = sum(n for _, n in packing.plan(dict(collections.Counter(sizes)), 16))
    assert got <= fewest(sorted(sizes, reverse=True), 16) * 11 / 9 + 6 / 9


ODD = st.text(alphabet=st.one_of(st.sampled_from(list("abcXYZÀÉßŸéñ '\u2019.,!?09<|>\n\t\x0b\u0085\u00a0\u2028\u0130\u1e9e")), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
@example(["it's 'S you'Re <|endoftext|>X <|ENDOFTEXT|>", "a\u0301b e\u0301", "İstanbul ǅ ΑΣ", "x" * 70 + "...!!!"])
def test_words_are_encoded_as_whole_texts(texts):
    words = _words()
    got = words.encoded([t.encode() for t in texts])
    want = [np.array(words.full.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert got == want


def test_stages_send_small_batches(spark):
    import corpus_pipeline

    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("64", "64")):
            spark.conf.set(name, given)
            corpus_pipeline.pack_sequences(spark, docs_of(spark, [(1, "a b", "s")]), "")
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_held_words_are_bounded():
    """Words of older lots go, what comes again is right again, and each distinct word of a lot is asked for once."""
    import public_tokenizers

    words = packing._Words(public_tokenizers.path("word_bpe_49k.json"), held=40)
    texts = [" ".join(f"{a}{b}{c}, é{b}{c}! {k}x" for k, c in enumerate("abcdef")) + "\t \n" for a in "qrst" for b in "uvwxyz"] * 2
    want = [np.array(words.full.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    got = []
    for lo in range(0, len(texts), 3):
        got += words.encoded([t.encode() for t in texts[lo : lo + 3]])
        assert len(words) <= 40 + 90 and len(words.old) <= 40 + 90  # a lot has at most 90 words, with and without marks
    assert got == want and words.encoded([]) == [] and words.encoded([b"", b" "]) == [b"", b""]


@functools.cache
def _words():
    import public_tokenizers

    return packing._Words(public_tokenizers.path("word_bpe_49k.json"))


def check_packing(rows, capacity=2048):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_texts(spark):
    import public_tokenizers
    import zlib
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [None, "", "Hello, World. It's 42!", "naïve <|endoftext|> x.", "word " * 5000, "same", "same", "A" * 3000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(5, "same", "s"), (None, "null id", "s")]
    got = packing.pack_documents(docs_of(spark, rows)).collect()
    check_packing(got)
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        mine = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i})
        assert mine == want
    assert packing.pack_documents(docs_of(spark, rows).where("false")).count() == 0
    whole = packing.sequences(docs_of(spark, rows)).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * 2048 for r in whole) and sum(r["n_tokens"] for r in whole) == sum(r["length"] for r in got)


# sharding, chat, archive: SQL twins, and the odd cases


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    df = queries.queries()[name](spark, data)
    cols = sorted(df.columns)
    rel = duck.sql(queries.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_sharding(spark):
    owner = maglev.lookup_table(maglev.shard_names(7), 101)
    assert max(collections.Counter(owner).values()) - min(collections.Counter(owner).values()) <= 1
    fewer = maglev.lookup_table(maglev.shard_names(6), 101)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True)) < 101 / 7 * 3
    with pytest.raises(ValueError, match="prime"):
        maglev.lookup_table(["a"], 100)
    rows = spark.createDataFrame([(1, 9, "x"), (1, 8, "y"), (None, 7, "z")], "doc_id long, slot int, shard string")
    got = maglev.place(rows, "doc_id", maglev.shard_names(7), 101).collect()
    assert len(got) == 3 and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert maglev.place(rows.where("false"), "doc_id", maglev.shard_names(7), 101).count() == 0


def test_chat_windows(spark):
    long = " ".join(["word"] * 150)
    rows = [(1, 0, "system", "Be <kind> [x]"), *[(1, k, "user" if k % 2 else "assistant", f"{long} \\l {k}") for k in range(1, 14)], (2, 3, "assistant", None), (2, 1, None, "</s>[INST]|>"), (None, None, "assistant", "z"), (3, 1, "user", "same"), (3, 1, "user", "same"), (4, 0, "assistant", long * 9)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, tokens int")
    w = chat_windows.windows(df)
    got = w.collect()
    assert len([r for r in got if r["conv_id"] == 1]) > 2
    for r in got:
        assert r["formatted"].count("</s>") == r["n_repeated"] + r["n_new"]
        if r["conv_id"] == 1:
            assert r["formatted"].startswith("<|system|>Be \\lkind\\g \\bx]</s>")
            assert r["tokens"] <= 512 and not r["over_budget"]
    assert any(r["n_repeated"] > 1 for r in got) and [r["over_budget"] for r in got if r["conv_id"] == 4] == [True]
    back = {r["conv_id"]: r for r in chat_windows.read_back(w).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        assert [tuple(t) for t in back[c]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert back[c]["loss_texts"] == [r[3] or "" for r in own if r[2] == "assistant"]
    assert chat_windows.digest(chat_windows.windows(df.where("false"))).count() == 0


@settings(max_examples=1, deadline=None)
@given(st.just(["\\", "\\\\l", "<<>>", "[\\b]", "\\s", "a\\gb", "", "<|x|>"]))
def test_escape(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_windows.escape(F.col("t")).alias("e"))
    for r in df.select("*", chat_windows.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not set("<>[") & set(r["e"])


def test_archive(spark):
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (3, "u\r\nWARC-Type: x", "same"), (9, None, "own ü"), (2, "e", ""), (7, "e", None), (4, "d", "twice"), (4, "d", "twice"), (None, "n", "lonely")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    records = warc_store.archive(df)
    for r in records.collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[size:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        assert rest[:size].partition(b"\r\n\r\n")[2] == (bytes(r["payload"]) if r["response"] else b"")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc_store.describe(records).collect()}
    assert got == {(5, "response", None), (1, "revisit", 5), (3, "revisit", 5), (9, "response", None), (7, "response", None), (2, "revisit", 7), (4, "response", None), (4, "revisit", 4), (None, "response", None)}
    digests = {r["page_id"]: (r["payload_digest"], r["payload_bytes"]) for r in warc_store.describe(records).collect()}
    assert digests[9] == (base64.b32encode(hashlib.sha1("own ü".encode()).digest()).decode(), 6)
    small = {(r["page_id"], r["record_type"]) for r in warc_store.describe(warc_store.archive(df, min_bytes=5)).collect()}
    assert {(1, "response"), (5, "response"), (3, "response")} <= small
    assert warc_store.describe(warc_store.archive(df.where("false"))).count() == 0


def test_archive_notices_changed_bytes(spark, tmp_path):
    path = str(tmp_path / "w")
    warc_store.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"y")).write.parquet(f"{path}/other")
    os.rename(f"{path}/payloads", f"{path}/gone")
    os.rename(f"{path}/other", f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc_store.read_archive(spark, path).collect()


# pipeline


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing columns and an empty table go through all stages."""
    import corpus_pipeline

    good = " ".join(f"word{k}" for k in range(80)) + "."
    rows = [(1, good, "en", "a", 5, "x"), (1, good, "en", "a", 5, "x"), (2, "", None, None, None, None), (None, None, None, None, None, None), (3, good + " tail", "en", None, 1, "y"), (4, "other " + good.replace("word", "term"), "de", "b", 2, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string"
    spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, docs in (("rows", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        for stage, f in corpus_pipeline.STAGES:
            before, docs = docs, f(spark, docs, str(tmp_path))
            if stage != "packing":
                assert docs.columns == before.columns
        got = docs.collect()
        assert {r["doc_id"] for r in got} == ({1, 4} if name == "rows" else set())
        check_packing(got)


def test_pipeline_stages(spark, data):
    """Each stage takes effect on all that the one before it kept."""
    import corpus_pipeline

    from quaymark.llm import line_rules, toxicity
    from quaymark.llm.common import keep

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "mixing", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    marks = spark.read.parquet(f"{data}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = keep(stages["toxicity"](spark, docs, data), "t1")
    assert {r[0] for r in one.select("doc_id").collect()} == {r["doc_id"] for r in toxicity.assess(docs, marks).where("predicted = 0").collect()}
    two = keep(stages["quality"](spark, one, data), "t2")
    assert {r[0] for r in two.select("doc_id").collect()} == {r["doc_id"] for r in line_rules.assess(one, marks).where("kept").collect()}
    three = keep(stages["near_copies"](spark, two, data), "t3")
    low = {c for _, _, c in brute_components([tuple(r) for r in two.select("doc_id", "text").collect()])}
    assert sorted(r[0] for r in three.select("doc_id").collect()) == sorted(low)
    four = keep(stages["mixing"](spark, three, data), "t4")
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    total = sum(len(WORD.findall(r[0] or "")) for r in three.select("text").collect())
    assert abs(sum(len(WORD.findall(r[0] or "")) for r in four.select("text").collect()) - 1.5 * total) <= 25
    assert check_packing(stages["packing"](spark, four, data).collect()) > 0
