"""The suffix tree keeps what is frequent by count, whatever its share, and asks its tables for what is not in the head."""

import math
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from quaymark.llm import suffix_lm


def scores(docs, model, words):
    return {r["doc_id"]: (r["base_score"], r["score"]) for r in suffix_lm.score(docs, model, words).collect()}


def test_a_context_of_a_small_share_is_kept(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 1000, 600)) for _ in range(1000)] + ["zq xj"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, words = suffix_lm.train_tree(docs)
    base, full = scores(docs.where("doc_id = 1000"), model, words)[1000]
    assert full - base > 3  # "zq" is one word in 15,000, and "xj" and the end are sure behind it


def chain(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(300):
        w = [f"v{i}" for i in rng.integers(0, 60, 40) ** 2 // 60]
        for i in range(1, 40):
            if rng.random() < 0.6:
                w[i] = f"n{w[i - 1]}"[:6]
        texts.append(" ".join(w))
    texts += [f"once{i} only{i} v1" for i in range(30)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(("head", "p_word"), [(0, 2.0), (60, 5e-3)])
def test_tables_give_what_the_head_gives(spark, monkeypatch, head, p_word):
    docs = chain(spark)
    want = scores(docs, *suffix_lm.train_tree(docs))
    assert any(f > b + 1 for b, f in want.values())
    monkeypatch.setattr(suffix_lm, "P_WORD", p_word)
    model, words = suffix_lm.train_tree(docs, head)
    assert len(model["k1"]) <= head and len(model["c1"]) <= head and model["tails"][1] is not None
    got = scores(docs, model, words)
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=0, atol=1e-6) for i in want)


def test_what_scores_need_of_the_tables_is_small(spark, monkeypatch):
    """A key that the head lacks is asked for once for some documents, not once for each token and level."""
    docs = chain(spark)
    model, words = suffix_lm.train_tree(docs, 0)
    kept, keep = {}, suffix_lm.keep

    def noted(df, name, *more, **named):
        out = keep(df, name, *more, **named)
        kept[name] = sum(f.stat().st_size for f in Path(out.kept_at.removeprefix("file:")).rglob("*.parquet"))
        return out

    monkeypatch.setattr(suffix_lm, "keep", noted)
    tokens = sum(r["n_tokens"] for r in suffix_lm.score(docs, model, words).collect())
    assert tokens > 10_000 and sum(kept.values()) < 8 * tokens


def strings(texts):
    """Every document as hashable symbols."""
    return [[*t.lower().split(), None] for t in texts]


def brute_tree(texts, depth):
    """The suffix tree by counting every string: (probability of a symbol behind a history, counts by length)."""
    docs = strings(texts)
    counts = [Counter(tuple(d[i : i + n]) for d in docs for i in range(len(d) - n + 1)) for n in range(1, depth + 2)]
    total, distinct = sum(counts[0].values()), len(counts[0])
    root = lambda s: (counts[0][(s,)] + 0.1) / (total + 0.1 * (distinct + 1))
    tree = {}  # context -> (rest, {symbol: probability})

    def p(history, symbol, longest):
        for n in range(min(longest, len(history)), 0, -1):
            c = tuple(history[len(history) - n :])
            if c in tree:
                rest, own = tree[c]
                return own[symbol] if symbol in own else rest * p(history, symbol, n - 1)
        return root(symbol)

    for n in range(1, depth + 1):
        behind = defaultdict(dict)
        for s, c in counts[n].items():
            if c >= suffix_lm.MIN_ENTRY and counts[n - 1][s[:-1]] >= suffix_lm.MIN_CONTEXT:
                behind[s[:-1]][s[-1]] = c
        new = {}
        for ctx, own in behind.items():
            t, q = counts[n - 1][ctx], {s: p(ctx, s, n - 1) for s in own}
            left, rest_q = t - sum(own.values()), max(1 - sum(q.values()), 1e-12)
            gain = sum(c * math.log(c / t / q[s]) for s, c in own.items()) + t * max(left / t, 1e-12) * math.log(max(left / t, 1e-12) / rest_q)
            if gain > (len(own) + 1) * 0.5 * math.log(max(total, 2)):
                rest = (left + suffix_lm.DISCOUNT * len(own)) / t
                new[ctx] = (rest, {s: (c - suffix_lm.DISCOUNT) / t + rest * q[s] for s, c in own.items()})
        tree |= new
    return lambda text: sum(math.log10(p(d[:i], d[i], depth)) for d in strings([text]) for i in range(len(d))), tree


def test_tree_equals_brute_force(spark):
    docs = chain(spark)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    texts += ["alpha beta gamma delta epsilon zeta eta"] * 40 + ["other beta gamma delta epsilon theta iota"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score, tree = brute_tree(texts, suffix_lm.DEPTH)
    assert max(map(len, tree)) == 5 and len(tree) > 8
    model, words = suffix_lm.train_tree(docs)
    assert len(model["c1"]) == len(tree)
    new = spark.createDataFrame([(0, "alpha beta gamma delta epsilon zeta"), (1, "beta gamma delta epsilon theta"), (2, "v1 v2 unseen v1"), (3, None), *[(10 + i, t) for i, t in enumerate(texts[:20])]], "doc_id long, text string")
    got = scores(new, model, words)
    for r in new.collect():
        assert abs(got[r["doc_id"]][1] - score(r["text"] or "")) < 1e-6


def test_held_out_documents_gain(spark, data):
    got = suffix_lm.assess(spark.read.parquet(f"{data}/documents.parquet")).where("held_out").collect()
    assert len(got) > 5 and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_keys_and_answers_are_read_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 1000):
        keys, values, there = np.sort(rng.integers(0, 1 << 63, n)), rng.normal(size=n), rng.random(n) < 0.5
        assert suffix_lm._unpacked_keys(suffix_lm._packed_keys(keys)).tolist() == keys.tolist()
        packed = suffix_lm._packed_answers(values, there)
        assert len(packed) == -(-n // 8) + 8 * int(there.sum())
        got = suffix_lm._unpacked_answers(packed, n)
        assert np.array_equal(np.isnan(got), ~there) and np.array_equal(got[there], values[there])


def test_only_tails_stay(spark):
    """Of the tree's tables scoring keeps on disk what the head lacks."""
    model, _ = suffix_lm.train_tree(chain(spark), 60)
    tails = [t for t in model["tails"] if t is not None]
    assert tails and len(model["tables"]) == len(tails) and all(t.columns == ["key", "v"] for t in model["tables"])


def test_packed_documents_go_lot_by_lot(spark, monkeypatch):
    """Scores are made a lot at a time, and what they have read is deleted."""
    docs = chain(spark)
    want = scores(docs, *suffix_lm.train_tree(docs.where("doc_id % 3 > 0")))
    monkeypatch.setattr(suffix_lm, "PIECE", 1 << 9)
    monkeypatch.setattr(suffix_lm, "held_out", lambda doc_id, out_of: doc_id % 3 == 0)
    kept, keep = [], suffix_lm.keep

    def noted(df, name, *more, **named):
        kept.append((name, keep(df, name, *more, **named)))
        return kept[-1][1]

    monkeypatch.setattr(suffix_lm, "keep", noted)
    got = {r["doc_id"]: (r["base_score"], r["score"]) for r in suffix_lm.assess(docs).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=0, atol=1e-6) for i in want)
    files = {name: Path(t.kept_at.removeprefix("file:")) for name, t in kept}
    assert not files["lm-tokens"].exists() and not files["lm-answers"].exists()
    assert sum(name == "lm-scores" for name, _ in kept) == suffix_lm.LOTS > 1


def test_pieces_are_packed_closely():
    rng = np.random.default_rng(5)
    numbers, piece = suffix_lm._Numbers(), suffix_lm._Piece()
    texts = [b" ".join(b"w%d" % i for i in rng.zipf(1.3, 400) % 50_000) for _ in range(100)] + [b"", b"w1"]
    for i, t in enumerate(texts):
        piece.add(i, t, numbers)
    distinct, packed = piece.packed(numbers)
    hashes, at = suffix_lm._unpacked(packed, distinct, piece.size)
    words = [x for t in texts for x in [*map(suffix_lm.word_hash, t.split()), suffix_lm.END, -1]]
    assert hashes[at].tolist() == words
    assert len(packed) < 6.7 * distinct + 1.4 * piece.size  # hashes in the order in which words came: 8 bytes for each


def test_what_is_sent_is_read_back():
    """Words with a number go as small numbers, others by their hashes."""
    rng = np.random.default_rng(6)
    frequent, others = rng.integers(0, 1 << 63, 50), rng.integers(0, 1 << 63, 20)
    for rows, words in ((1, 1), (30, 1), (30, 4)):
        numbers = rng.integers(-20, 50, (rows, words)).astype(np.int32)
        numbers[numbers >= 0] += 1
        counts = rng.integers(1, 1 << 31, rows).astype(np.uint32)
        sent, want = suffix_lm._Sent(counts[:, None], numbers, others), suffix_lm._words(numbers, frequent, others)
        for lo, hi in ((0, rows), (rows // 3, rows // 2 + 1)):
            raw = sent.part(lo, hi)
            assert len(raw) == (hi - lo) * 4 * (1 + words) + 8 * int((numbers[lo:hi] < 0).sum())
            got = suffix_lm._Sent.read(memoryview(raw + b"more"), hi - lo, words, frequent)
            assert got[0].tolist() == counts[lo:hi].tolist() and np.array_equal(got[1], want[lo:hi]) and bytes(got[2]) == b"more"


def test_the_shared_model_is_packed(spark):
    model, _ = suffix_lm.train_tree(chain(spark), 60)
    want, got = suffix_lm._shared(model), suffix_lm._Small(model).get()
    assert want.keys() == got.keys() and "rest1" not in got
    same = lambda a, b: all(map(same, a, b)) if isinstance(a, (list, tuple)) else np.array_equal(a, b) if isinstance(a, np.ndarray) else a == b
    assert all(same(want[k], got[k]) for k in want)
