"""Relational operators against short Python oracles."""

import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaymark.operators import bands, boxes, evaluation, ranking, retention, routing, tokens, voting

FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def token_rows(spark, pairs):
    return spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(pairs)], "image_id int, ord int, text string, score double")


def test_candidate_groups(spark):
    rows = tokens.collected(token_rows(spark, [("TCKU", 0.9), ("438607", 0.8), ("9", 0.6)]), ["image_id"])
    got = rows.select(F.explode(tokens.candidate_groups("pairs")).alias("g")).select("g.raw", F.round("g.score", 6)).collect()
    assert [tuple(r) for r in got] == [("TCKU", 0.9), ("438607", 0.8), ("9", 0.6), ("TCKU4386079", 0.766667), ("TCKU 438607 9", 0.766667), ("TCKU438607", 0.85), ("4386079", 0.7)]


def test_tokens_of_json(spark):
    bodies = [(1, '{"res": {"rec_texts": ["tcku", " ", "12"], "rec_scores": [0.9, 0.5]}}'), (2, '[[[[[0,0]], ["ab-1", 0.7]]]]'), (3, "broken"), (4, None)]
    got = tokens.tokens_of_json(spark.createDataFrame(bodies, "image_id int, body string"), "body", ["image_id"]).orderBy("image_id", "ord").collect()
    assert [tuple(r) for r in got] == [(1, 0, "TCKU", 0.9), (2, 0, "AB1", 0.7)]


def test_best_digit_and_letter(spark):
    best = lambda pairs: [tuple(r) for r in tokens.best_digit(token_rows(spark, pairs), ["image_id"]).select("digit", F.round("final", 6)).collect()]
    assert best([("A4", 0.7)]) == [("4", 0.9)]
    assert best([("45", 0.7)]) == [("5", 0.75)]
    assert best([("7", 0.5), ("S", 0.5)]) == [("7", 0.7)]
    assert best([("AC", 0.7)]) == []
    got = tokens.best_letter(token_rows(spark, [("T", 0.5), ("0X", 0.6)]), ["image_id"]).select("letter", F.round("final", 6)).collect()
    assert [tuple(r) for r in got] == [("T", 0.69)]


def test_numeric_vote(spark):
    rows = voting.numeric_candidates(token_rows(spark, [("438607", 0.9), ("9", 0.7), ("4386079", 0.8), ("4386071", 0.75)]), ["image_id"])
    got = {tuple(r) for r in rows.select("base6", "check_digit", F.round("score", 6), "direct", "source").collect()}
    assert got == {("438607", "", 0.94, False, "base6"), ("438607", "9", 0.94, True, "direct7"), ("438607", "1", 0.89, True, "direct7"), ("438607", "9", 0.9394, False, "combo")}
    pick = voting.pick_number(rows, ["image_id"]).select("base6", "check_digit", F.round("score", 6), "raw", "has_direct_full", "check_vote_count", F.round("check_margin", 6)).collect()
    assert [tuple(r) for r in pick] == [("438607", "9", 1.9794, "438607", True, 2, 0.9894)]
    side = spark.createDataFrame([(1, 0, "9", 0.5, "square"), (1, 1, "4", 0.9, "zone")], "image_id int, ord int, digit string, score double, source string")
    check = voting.resolve_check_digit(spark.createDataFrame([(1, "438607")], "image_id int, base6 string"), rows, side, ["image_id"]).select("check_digit", F.round("score", 6), "vote_count", "direct_count", "square_count").collect()
    assert [tuple(r) for r in check] == [("9", round(0.94 + 0.34 + 0.9394 * 0.74 + 0.5 + 0.18 + 0.08, 6), 2, 2, 1)]


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("abc"), st.integers(0, 3)), min_size=1, max_size=25))
def test_winner_breaks_ties_by_first_vote(spark, rows):
    df = spark.createDataFrame([(k, c, w, i) for i, (k, c, w) in enumerate(rows)], "k int, c string, w int, ord int").repartition(3)
    got = {r["k"]: (r["c"], r["vote"], r["vote_count"], r["margin"]) for r in ranking.winner(ranking.votes(df, ["k"], "c", "w", "ord"), ["k"]).collect()}
    for k in {k for k, _, _ in rows}:
        tally = {}
        for kk, c, w in rows:
            if kk == k:
                tally[c] = tally.get(c, 0) + w
        ranked = sorted(tally.items(), key=lambda x: -x[1])  # stable: first seen first
        assert got[k] == (ranked[0][0], ranked[0][1], len(ranked), ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0))


@FEW
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30), st.integers(0, 4))
def test_runs_and_merges(spark, strengths, gap):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(strengths)], "k int, pos int, strength int").repartition(3)
    runs = bands.threshold_runs(df, ["k"], 5)
    want, start = [], None
    for i, v in enumerate([*strengths, 0]):
        if v >= 5 and start is None:
            start = i
        elif v < 5 and start is not None:
            want.append((start, i, sum(strengths[start:i])))
            start = None
    assert sorted(tuple(r) for r in runs.select("start", "end", "strength").collect()) == want
    merged = []
    for s, e, _ in want:
        if merged and s - merged[-1][1] <= gap:
            merged[-1] = (merged[-1][0], e)
        else:
            merged.append((s, e))
    assert sorted(tuple(r) for r in bands.merge_gaps(runs, ["k"], gap).select("start", "end").collect()) == merged


def python_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: max(1, (r[2] - r[0]) * (r[3] - r[1]))
    return w * h / max(1.0, area(a) + area(b) - w * h)


@FEW
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 12), st.integers(1, 12)), min_size=1, max_size=6))
def test_suppression(spark, rects):
    rows = [(1, i, x, y, x + w, y + h, float(w * h)) for i, (x, y, w, h) in enumerate(rects)]
    df = spark.createDataFrame(rows, "k int, ord int, x1 int, y1 int, x2 int, y2 int, area double").repartition(2)
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(python_iou(r[2:6], k[2:6]) < 0.72 for k in kept):
            kept.append(r)
    assert [r["ord"] for r in boxes.suppress_two(df, ["k"]).orderBy("rank").collect()] == [r[1] for r in kept[:2]]
    assert [r["ord"] for r in boxes.suppress(df, ["k"]).orderBy("rank").collect()] == [r[1] for r in kept]


def test_first_valid_and_alerts(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False), (2, 2, False)], "k int, ord int, ok boolean")
    assert sorted((r["k"], r["ord"]) for r in ranking.first_valid_stop(rows, ["k"], "ord", F.col("ok")).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    cases = [(200, None, "TCKU4386079", "TCKU4386079", None, False), (200, None, "TCKU4386079", "WRONG", "TCKU4386079", False), (200, None, "TCKU4386070", "TCKU4386079", None, True), (200, None, "NOT_FOUND", None, None, False), (200, "raw_only", "NOT_FOUND", None, None, True), (500, "HTTP 500", "", "TCKU4386079", None, True), (None, "timeout", "", None, None, True)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, code int, error string, p string, el string, et string, want boolean")
    got = df.select("want", evaluation.is_alert(F.col("error"), F.col("code"), F.col("et"), F.col("el"), F.col("p")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_summary_of_nothing_and_one(spark):
    items = spark.createDataFrame([(1, 200, None, "A1", "a-1", None, 5.0)], "run int, status_code int, error string, normalized_predicted string, expected_label string, expected_text string, elapsed_ms double")
    r = evaluation.run_summary(items, ["run"]).first()
    assert (r["ok_requests"], r["latency_p95_ms"], r["label_accuracy"], r["text_accuracy"]) == (1, 5.0, 1.0, None)
    assert evaluation.run_summary(items.where("false"), ["run"]).count() == 0


def test_routing(spark):
    sizes = [(10, 100), (300, 100), (400, 100), (0, 0), (315, 100)]
    df = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(sizes)], "i int, w int, h int").orderBy("i")
    assert [r[0] for r in df.select(routing.layout(F.col("w"), F.col("h"), F.lit(False))).collect()] == ["vertical", "twolines", "oneline", "unknown", "oneline"]
    attempts = spark.createDataFrame([(1, 0, 0.9, "x", "", "RAW_ONLY", False), (1, 1, 0.1, "x", "TCKU438607", "FULL_11", True)], "k int, ord int, score double, raw_text string, base10 string, status string, is_valid_iso boolean")
    assert routing.best_attempt(attempts, ["k"]).first()["ord"] == 1


def cut_by_rule(profile, start, end, parts):
    """The rule in plain Python: smooth over seven places, then one cut after the other."""
    own = profile[start:end]
    n = len(own)
    mirror = lambda i: abs(i) if abs(i) < n else 2 * (n - 1) - abs(i)
    near = [sum(w * own[mirror(i + k - 3)] for k, w in enumerate(bands.GAUSSIAN_7)) for i in range(n)]
    least, reach, cuts = max(10, n // (2 * parts)), max(6, n // (3 * parts)), [0]
    for k in range(1, parts):
        goal = round(n * k / parts)
        lo, hi = max(cuts[-1] + least, goal - reach), min(n - (parts - k) * least, goal + reach)
        cuts.append(goal if hi <= lo else min(range(lo, hi), key=lambda i: (near[i], i)))
    out = [(start + a, start + b) for a, b in zip(cuts, [*cuts[1:], n], strict=True) if b - a >= 8]
    return out if len(out) > 1 else [(start, end)]


def test_valley_cuts(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        n = rng.randint(20, 140)
        a = rng.randint(0, 5)
        rows.append((k, [float(rng.randint(0, 9)) for _ in range(n)], a, n - rng.randint(0, 4), rng.randint(1, 5)))
    df = spark.createDataFrame(rows, "k int, profile array<double>, a int, b int, parts int")
    got = {r["k"]: [tuple(x) for x in r["c"]] for r in df.select("k", bands.split_at_valleys(F.col("profile"), F.col("a"), F.col("b"), F.col("parts")).alias("c")).collect()}
    assert got == {k: cut_by_rule(p, a, b, parts) if parts > 1 else [(a, b)] for k, p, a, b, parts in rows}


def test_tall_bands_are_cut(spark):
    rows = [(1, a, b, 200) for a, b in ((0, 12), (20, 32), (40, 52), (60, 96), (100, 104))]
    df = spark.createDataFrame(rows, "k int, start int, end int, h int")
    assert {r["typical_height"] for r in bands.typical_height(df, ["k"], "h").collect()} == {12}
    profile = spark.createDataFrame([(1, [0.0 if i in (71, 83) else 5.0 for i in range(200)])], "k int, profile array<double>")
    got = sorted((r["start"], r["end"]) for r in bands.refined_bands(df, profile, ["k"], "h").collect())
    assert got[:3] == [(0, 12), (20, 32), (40, 52)] and got[-1] == (100, 104) and len(got) == 7 and got[3][0] == 60 and got[5][1] == 96
    low = spark.createDataFrame([(2, 0, 3, 200)], "k int, start int, end int, h int")
    assert bands.typical_height(low, ["k"], "h").first()["typical_height"] is None


def test_quantiles_are_exact(spark):
    rng = random.Random(6)
    values = {None: [0.0, -3.5, 1e-9], "a": [rng.choice([1.5, 2.0, 1e6, -7.0]) for _ in range(50)], "b": [rng.uniform(-1e3, 1e5) for _ in range(301)], "c": [4.25]}
    rows = [(k, v) for k, own in values.items() for v in own] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["p"], r["m"]) for r in evaluation.quantiles(df, ["k"], "v", {"p": 0.95, "m": 0.5}).collect()}
    assert got.keys() == values.keys()
    for k, own in values.items():
        assert np.allclose(got[k], np.quantile(own, [0.95, 0.5]), rtol=1e-12, atol=1e-12)


def test_ties_go_to_the_first_reading(spark):
    base = spark.createDataFrame([(1, "123456")], "k int, base6 string")
    found = spark.createDataFrame([(1, (n,), "123456", d, 0.5, "r", False, "combo") for n, d in ((2, "7"), (10, "3"))], "k int, ord struct<a:int>, base6 string, check_digit string, score double, raw string, direct boolean, source string")
    none = spark.createDataFrame([], "k int, ord int, digit string, score double, source string")
    assert voting.resolve_check_digit(base, found, none, ["k"]).first()["check_digit"] == "7"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["123456", "654321", "111111"]), st.sampled_from(["", "1", "2", "3"]), st.integers(-4, 16), st.booleans()), max_size=9))
def test_both_picks_agree(spark, given_rows):
    """The choice over rows and the choice over an array are one rule."""
    rows = [(1, k, b, d, s / 16, f"{b}{d}{k}", direct, "x") for k, (b, d, s, direct) in enumerate(given_rows)]
    kind = "k int, ord int, base6 string, check_digit string, score double, raw string, direct boolean, source string"
    df = spark.createDataFrame(rows, kind)
    one = [tuple(r) for r in voting.pick_number(df, ["k"]).collect()]
    every = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ord", "base6", "check_digit", "score", "raw", "direct", "source"))).alias("c"))
    two = voting.with_pick(every, "c", "p").select("k", "p.*").select("k", "base6", "check_digit", "score", "raw", "has_direct_full", "check_vote_count", "check_margin")
    assert one == [tuple(r) for r in two.collect()]


def test_profiles_and_refined_bands(spark):
    pixels = spark.createDataFrame([(1, y, 255 if 10 <= y < 100 and y not in (54, 55) else 0) for y in range(120) for _ in range(3)] + [(1, 5, 9)], "k int, y int, v int")
    rows = bands.profile(pixels, ["k"], "y")
    assert {r["pos"]: r["strength"] for r in rows.collect()} == {y: 3 * (10 <= y < 100 and y not in (54, 55)) + (y == 5) for y in range(120)}
    runs = bands.threshold_runs(rows, ["k"], 2)
    assert sorted((r["start"], r["end"]) for r in runs.collect()) == [(10, 54), (56, 100)]
    high = runs.withColumn("h", F.lit(4000))
    assert bands.tall_enough(high, "h").count() == 0 and bands.tall_enough(high.withColumn("h", F.lit(120)), "h").count() == 2
    strengths = [float(abs(y % 30 - 15)) for y in range(120)]
    shaped = spark.createDataFrame([(1, 0, 20, 120), (1, 25, 45, 120), (1, 50, 70, 120), (1, 75, 115, 120)], 'k int, start int, `end` int, h int')
    cut = bands.refined_bands(shaped, spark.createDataFrame([(1, strengths)], "k int, profile array<double>"), ["k"], "h")
    got = sorted((r["start"], r["end"]) for r in cut.collect())
    assert got[:3] == [(0, 20), (25, 45), (50, 70)] and got[3:] == cut_by_rule(strengths, 75, 115, 2)
