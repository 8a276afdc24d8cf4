"""The two fitted models against plain Python: FTRL step by step, the field's gradient by differences and its likelihood by enumeration."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import common, line_rules, toxicity, warc_store


def plain_ftrl(examples, size, alpha, beta, l1, l2, passes):
    """One number at a time, as the rule is written: w from z and n, then z and n from the gradient."""
    z, n = [0.0] * size, [0.0] * size
    share = min(max(sum(y for _, y in examples) / len(examples), 0.02), 0.98) if examples else 0.5
    cost = (0.5 / (1 - share), 0.5 / share)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for x, y in examples:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-min(max(sum(w.values()), -35.0), 35.0)))
            g = (p - y) * cost[y]
            for i in x:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return [weight(i) for i in range(size)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 15), min_size=1), st.integers(0, 1)), max_size=25), st.sampled_from([0.0, 0.3, 2.0]), st.integers(1, 3))
def test_ftrl_equals_the_rule(rows, l1, passes):
    examples = [(np.array(sorted(x), np.uint32), y) for x, y in rows]
    got = toxicity.ftrl(examples, 4, alpha=0.3, beta=1.0, l1=l1, l2=1.0, passes=passes)
    assert np.allclose(got, plain_ftrl([(sorted(x), y) for x, y in rows], 16, 0.3, 1.0, l1, 1.0, passes), atol=1e-12)


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(4)
    examples = [(np.unique(np.concatenate([[0, 1 if y else 2], rng.integers(10, 1 << 10, 8)])).astype(np.uint32), int(y)) for y in rng.integers(0, 2, 400)]
    w = toxicity.ftrl(examples, 10, l1=5.0)
    assert w[1] > 0 > w[2] and (w == 0).mean() > 0.9


@given(st.sets(st.integers(0, (1 << 18) - 1), max_size=60), st.sampled_from([18, 22]))
def test_packed_features_are_read_back(numbers, bits):
    x = np.array(sorted(numbers), np.int64)
    assert toxicity.unpacked(toxicity.packed(x, bits), bits).tolist() == x.tolist()
    assert len(toxicity.packed(x, bits)) == 2 * len(x) + (4 << bits - 16)


def test_ftrl_holds_two_dense_arrays():
    examples = [(np.arange(0, 1 << 20, 64 + y, dtype=np.uint32), y) for y in (0, 1)]
    tracemalloc.start()
    toxicity.ftrl(examples, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * (8 << 20)


def objective(sequences, w, t, l2):
    """Weighted log likelihood by enumeration of all labellings, less the penalty, for each document."""
    y = [label for _, label in sequences]
    share = [np.mean([v == k for v in y]) for k in (0, 1)]
    total = 0.0
    for x, label in sequences:
        score = lambda path, x=x: sum(w[s, f].sum() for s, f in zip(path, x.astype(int), strict=True)) + sum(t[a, b] for a, b in itertools.pairwise(path))
        z = np.logaddexp.reduce([score(p) for p in itertools.product((0, 1), repeat=len(x))])
        total += 0.5 / share[label] * (score((label,) * len(x)) - z)
    return (total - 0.5 * l2 * ((w**2).sum() + (t**2).sum())) / len(sequences)


@pytest.mark.parametrize("seed", [1, 2])
def test_the_field_is_fitted_to_its_likelihood(seed):
    rng = np.random.default_rng(seed)
    sequences = [(rng.integers(0, line_rules.N_FEATURES, (n, 3)).astype(np.uint8), int(y)) for n, y in zip(rng.integers(1, 6, 12), [0, 1] * 6, strict=True)]
    w, t = line_rules.fit(sequences, rounds=400)
    best = objective(sequences, w, t, 1.0)
    assert best > objective(sequences, np.zeros_like(w), np.zeros_like(t), 1.0) + 0.01
    for size in (0.02, 0.1, 0.5):  # a concave function: near its maximum no direction leads up, but for what the last step of the fit leaves
        for _ in range(25):
            d, e = rng.normal(size=w.shape), rng.normal(size=t.shape)
            norm = math.sqrt((d**2).sum() + (e**2).sum())
            assert objective(sequences, w + size * d / norm, t + size * e / norm, 1.0) < best + 5e-4
        for a, b in itertools.product((0, 1), repeat=2):
            e = np.zeros_like(t)
            e[a, b] = size
            assert max(objective(sequences, w, t + e, 1.0), objective(sequences, w, t - e, 1.0)) < best + 1e-3


def test_one_round_moves_along_the_gradient():
    rng = np.random.default_rng(7)
    sequences = [(rng.integers(0, line_rules.N_FEATURES, (n, 2)).astype(np.uint8), y) for n, y in ((3, 0), (2, 1), (4, 1), (1, 0))]
    w, t = line_rules.fit(sequences, rounds=1)
    zero_w, zero_t, step = np.zeros_like(w), np.zeros_like(t), 1e-5
    for label, f in itertools.product((0, 1), sorted({int(f) for x, _ in sequences for f in x.ravel()})):
        d = zero_w.copy()
        d[label, f] = step
        slope = objective(sequences, zero_w + d, zero_t, 1.0) - objective(sequences, zero_w - d, zero_t, 1.0)
        assert abs(slope) < 1e-9 or np.sign(w[label, f]) == np.sign(slope)


def test_kept_files_go_with_the_driver(spark, tmp_path):
    kept = common.keep(spark.range(5), "test-keep")
    path, fs = common._file(spark, kept.kept_at)
    assert fs.exists(path) and kept.count() == 5
    common.discard(kept)
    assert not fs.exists(path) and not fs.cancelDeleteOnExit(path)
    again = common.keep(spark.range(5), "test-keep")
    path, fs = common._file(spark, again.kept_at)
    assert fs.cancelDeleteOnExit(path)  # it was down for deletion when the driver ends
    common.delete_at_end(spark, again.kept_at)
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    assert warc_store.describe(warc_store.archive(pages)).count() == 1
