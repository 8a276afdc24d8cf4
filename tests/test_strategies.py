"""Branches of the reading strategies, one at a time."""

import pytest
from pyspark.sql import functions as F

from quaymark.plans import best_of, strategies

TOKENS = "k int, part string, grp int, pass int, ord int, text string, score double"
GROUPS, SYMBOLS, VOTES = "k int, part string, grp int, n int, height int, width int", "k int, part string, grp int, i int, digit string, score double", "k int, ord int, digit string, score double, source string"


_ELEVEN, _TEN = {"segments": [20] * 11}, {"segments": [20] * 10}
_BOXED = [("segments", "letters", 0, "TCKU", 0.5), ("segments", "digits7", 0, "438607", 0.4), ("segments", "check", 0, "9", 0.6)]
_GRIDS = {"segments": [20] * 3, "grid11": [15] * 11, "grid10": [16] * 10}
_READ_TEN = [("grid10", "letters", 0, "TCKU", 0.9), ("grid10", "digits6", 0, "438607", 0.9)]
_BOTH = {"segments": [20] * 13, "grid11": [15] * 11}
_SECOND = [("grid11", "letters", 0, "MSKU", 0.9), ("grid11", "digits7", 0, "2737060", 0.9)]
#: Image: parts' heights by attempt, tokens (attempt, part, pass, text, score).
VERTICAL = {
    "boxed": (_ELEVEN, _BOXED), "no box": (_TEN, [("segments", "letters", 0, "TCKU", 0.5), ("segments", "digits6", 0, "438607", 0.4), ("segments", "check", 0, "9", 0.6)]),
    "halves": ({"segments": [20] * 9, "grid11": [15] * 11}, [("segments", "letters", 0, "TCKU", 1.0), ("grid11", "digits7", 0, "4386079", 1.0)]),
    "six": (_GRIDS, [("grid11", "digits7", 0, "438607", 0.9), *_READ_TEN]), "seven": (_GRIDS, [("grid11", "digits7", 0, "4386071", 0.9), *_READ_TEN]), "no eleven": ({k: v for k, v in _GRIDS.items() if k != "grid11"}, _READ_TEN),
    "same parts": (_GRIDS | {"grid11": [16] * 10}, [("grid11", "digits6", 0, "438607", 0.9), *_READ_TEN]),
    "valid first": (_BOTH, [("segments", "letters", 0, "TCKU", 0.1), ("segments", "digits7", 0, "4386079", 0.1), *_SECOND]), "valid second": (_BOTH, [("segments", "letters", 0, "TCKU", 0.1), ("segments", "digits7", 0, "4386078", 0.1), *_SECOND]),
    "few": ({"segments": [20] * 2}, [("segments", "letters", 0, "TCKU", 0.9)]), "none": ({}, []),
}


@pytest.fixture(scope="module")
def vertical(spark):
    parts = spark.createDataFrame([(k, a, i, h, 10) for k, (sizes, _) in VERTICAL.items() for a, hs in sizes.items() for i, h in enumerate(hs)], "k string, attempt string, i int, height int, width int")
    rows = spark.createDataFrame([(k, a, p, n, 0, t, s) for k, (_, tokens) in VERTICAL.items() for a, p, n, t, s in tokens], "k string, attempt string, part string, pass int, ord int, text string, score double")
    return {r["k"]: r for r in strategies.code_of_vertical(rows, parts, spark.createDataFrame([(k,) for k in VERTICAL], "k string"), ["k"]).collect()}


def test_vertical_score_is_a_sum_and_the_strip_may_raise_it(vertical):
    got = vertical["boxed"]
    assert (got["full_code"], got["is_valid_iso"], got["raw_text"]) == ("TCKU4386079", True, "TCKU 438607")
    assert got["score"] == pytest.approx(0.5 + 0.05 + 0.15 + max(0.4 + 0.11 + 0.08, 0.6 + 0.03 + 0.12 + 0.04 + 0.04))
    assert (vertical["no box"]["full_code"], vertical["no box"]["status"]) == ("TCKU438607", "PARTIAL_10")  # ten parts have no box to ask


def test_vertical_half_a_reading_ranks_low(vertical):
    got = vertical["halves"]
    assert (got["status"], got["score"], got["base10"], got["check_digit"], got["raw_text"]) == ("RAW_ONLY", -1.0, "", "", "4386079")  # nine parts are too few to read


def test_vertical_grid_of_ten_only_after_six_digits(vertical):
    assert (vertical["six"]["base10"], vertical["seven"]["base10"], vertical["no eleven"]["status"]) == ("TCKU438607", "", "NOT_FOUND")
    assert vertical["same parts"]["base10"] == ""  # the same parts are not read again


def test_vertical_stops_at_a_valid_code(vertical):
    assert (vertical["valid first"]["full_code"], vertical["valid second"]["full_code"]) == ("TCKU4386079", "MSKU2737060")


def test_vertical_without_parts(vertical):
    assert vertical["few"]["status"] == vertical["none"]["status"] == "NOT_FOUND" and len(vertical) == len(VERTICAL)


OWNER = ("owner", -1, 0, 0, "TCKU", 0.5)
_STRONG = ("owner", -1, 2, 0, "TCKU", 0.5)  # only the strongest pass reads it, which the first reading does not have
_TWICE = [("left", g, i, d, s) for g, s in ((1, 0.3), (2, 0.9)) for i, d in enumerate("4386")] + [("right", 1, i, d, 0.5) for i, d in enumerate("079")]
_CUT = [OWNER, ("left", -1, 0, 0, "438", 0.5), ("right", -1, 0, 0, "6079", 0.5)]
#: Image: tokens, groups, symbols, votes, whether a seam was found.
DOORS = {
    "symbols": ([OWNER], [("left", 0, 4, 1, 1), ("right", 0, 3, 1, 1)], [("left", 0, i, d, 0.5) for i, d in enumerate("4386")] + [("right", 0, i, d, 0.9) for i, d in enumerate("079")], [], True),
    "other signs": ([("owner", -1, 0, 0, "TCK", 0.5), ("left", -1, 0, 0, "U 43", 0.5), ("right", -1, 0, 0, "86079", 0.5)], [], [], [], True), "cut": (_CUT, [], [], [], True),
    "vote": ([OWNER], [], [], [(0, "7", 0.5, "square")], True), "no seam": ([OWNER], [], [], [], False), "nothing": ([], [], [], [], True),
    "twice": ([_STRONG], [("left", 1, 4, 1, 1), ("left", 2, 4, 1, 1), ("right", 1, 3, 1, 1)], _TWICE, [], True),
}


@pytest.fixture(scope="module")
def doors(spark):
    """(without, with) the hard reading."""
    make = lambda at, kind: spark.createDataFrame([(k, *r) for k, case in DOORS.items() for r in case[at]], kind.replace("k int", "k string"))
    images = spark.createDataFrame([(k, case[4]) for k, case in DOORS.items()], "k string, split boolean")
    tables = make(0, TOKENS), make(2, SYMBOLS), make(1, GROUPS), make(3, VOTES)
    return [{r["k"]: r for r in strategies.code_of_split_door(*tables, images, ["k"], hard).collect()} for hard in (False, True)]


def test_door_from_symbols(doors):
    for got in (d["symbols"] for d in doors):
        assert (got["full_code"], got["raw_text"]) == ("TCKU4386079", "TCKU 4386 079") and got["score"] == pytest.approx(0.5 + 0.06 + 0.15 + 0.9)


def test_door_repairs_from_its_raw_text(doors):
    got = doors[0]["other signs"]
    assert (got["full_code"], got["raw_text"]) == ("UABU0438600", "U 43 86079")  # digits of the text stand for letters, and letters for digits
    assert got["score"] == pytest.approx(0.35 + 0.03)
    got = doors[0]["cut"]
    assert (got["full_code"], got["raw_text"], got["score"]) == ("TCKU4386077", "TCKU 438 6079", pytest.approx(0.71))


def test_door_keeps_what_it_read(doors):
    got = doors[0]["vote"]
    assert (got["status"], got["base10"], got["check_digit"], got["score"]) == ("RAW_ONLY", "", "7", -1.0)
    assert all(d[k]["status"] == "NOT_FOUND" for d in doors for k in ("no seam", "nothing"))


def test_door_hard_first_seen_counts(doors):
    """A block read twice keeps the score of its first reading."""
    got = doors[1]["twice"]
    assert got["full_code"] == "TCKU4386079" and doors[0]["twice"]["base10"] == ""
    assert got["score"] == pytest.approx((0.5 + 0.06 + 0.15) + 0.58 * 0.4 + 0.42 * 0.61 + 0.04)


def test_two_lines_hand_on(spark):
    kinds = "k int, part string, pass int, ord int, text string, score double"
    rows = spark.createDataFrame([(1, "top", 0, 0, "MSKU", 0.5), (1, "digits7", 0, 0, "273706", 0.5), (2, "top", 0, 0, "MSKU", 0.5), (3, "bottom", 0, 0, "12", 0.5)], kinds)
    images = spark.createDataFrame([(1, True, True), (2, True, True), (3, True, False), (4, False, True)], "k int, bands boolean, split boolean")
    door_rows = spark.createDataFrame([(k, "owner", -1, 0, 0, "TCKU", 0.5) for k in (1, 2, 4)] + [(k, p, -1, 0, 0, t, 0.5) for k in (1, 2) for p, t in (("left", "4386"), ("right", "079"))], TOKENS)
    empty = lambda kind: spark.createDataFrame([], kind)
    votes = spark.createDataFrame([(1, 0, "0", 0.5, "zone")], VOTES)
    got = {r["k"]: (r["full_code"], r["status"]) for r in strategies.code_of_two_lines(rows, votes, (door_rows, empty(SYMBOLS), empty(GROUPS), empty(VOTES)), images, ["k"]).collect()}
    assert got == {1: ("MSKU2737060", "FULL_11"), 2: ("TCKU4386079", "FULL_11"), 3: ("", "RAW_ONLY"), 4: ("", "RAW_ONLY")}


def test_equal_contents_are_read_once(spark):
    images = spark.createDataFrame([(1, 10, 20, "a"), (2, 10, 20, "a"), (3, 20, 10, "a"), (4, 10, 20, None), (5, 10, 20, None)], "k int, height int, width int, digest string")
    tokens = spark.createDataFrame([(1, "fast", 0, "TCKU4386079", 1.0), (2, "fast", 0, "MSKU2737060", 1.0), (1, "hard", 0, "MSKU2737060", 1.0), (3, "fast", 0, "TCKU4386078", 0.5), (3, "hard", 0, "TCKU4386079", 0.5), (4, "hard", 0, "X", 0.5)], "k int, variant string, ord int, text string, score double")
    got = {r["k"]: (r["text"], r["variant"], r["reason"]) for r in best_of.best_of_variants(tokens, images, ["k"]).collect()}
    assert got == {1: ("TCKU4386079", "fast", "ok"), 2: ("TCKU4386079", "fast", "ok"), 3: ("TCKU4386079", "hard", "ok"), 4: ("", None, "uninitialized"), 5: ("", None, "uninitialized")}
    many = spark.createDataFrame([(3, "fast", i, f"T{i}", 0.5) for i in range(12)] + [(3, "fast", 12, "TCKU4386079", 0.5)], "k int, variant string, ord int, text string, score double")
    row = best_of.best_of_variants(many, images, ["k"]).where("k = 3").first()
    assert row["text_pair_count"] == 13 and len(row["text_pairs"]) == len(row["candidate_groups"]) == 8


def test_steps_bound_the_score(spark):
    rows = spark.createDataFrame([(1, 0, 0, "a", 0.99), (1, 1, 0, "b", 0.5), (1, 2, 0, "c", 0.5)], "k int, pass int, ord int, text string, score double")
    got = strategies.in_steps(rows, [(7, F.lit(True), "light", 0.1)]).orderBy("ord").collect()
    assert [(r["step"], r["text"], round(r["score"], 9)) for r in got] == [(7, "a", 1.0), (7, "b", 0.64)]


def test_replies_by_layout(spark):
    """The strategy of the layout answers if it found something; a wide image counts as one line; nothing anywhere is not found."""

    def replies(rows):
        df = spark.createDataFrame(rows, "k int, base10 string, check_digit string, raw_text string, score double")
        return strategies.routing.shape_full(df)

    images = spark.createDataFrame([(1, "oneline", 400, 100), (2, "twolines", 200, 100), (3, "vertical", 10, 100), (4, "unknown", 200, 100), (5, "twolines", 400, 100), (6, "vertical", 10, 100)], "k int, layout string, width int, height int")
    one = replies([(1, "TCKU438607", "9", "a", 0.5), (5, "TCKU438607", "", "b", 0.5)])
    two = replies([(2, "", "", "text alone", -1.0), (5, "MSKU273706", "0", "c", 0.5), (4, "MSKU273706", "0", "not asked", 0.5)])
    upright = replies([(3, "", "", "", -1.0), (6, "", "", "raw", -1.0)])
    generic = replies([(k, "CSQU305438", "3", "g", 0.1) for k in (1, 2, 3)])
    got = {r["k"]: (r["strategy"], r["full_code"], r["status"]) for r in strategies.code_by_layout(images, one, two, upright, generic, ["k"]).collect()}
    assert got == {1: ("oneline", "TCKU4386079", "FULL_11"), 2: ("twolines", "", "RAW_ONLY"), 3: ("generic", "CSQU3054383", "FULL_11"), 4: ("none", "", "NOT_FOUND"), 5: ("oneline", "TCKU438607", "PARTIAL_10"), 6: ("vertical", "", "RAW_ONLY")}
