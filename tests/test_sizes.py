"""What keeps plans and their work small, and sums that do not depend on how rows are dealt."""

import pytest
from pyspark.sql import functions as F

from quaymark import catalogue
from quaymark.functions import codes
from quaymark.operators import ranking, tokens, voting


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_lists_of_candidates_are_computed_once(spark):
    rows = spark.createDataFrame([("TCKU", [("TCKU", 0.5)])], "raw string, pairs array<struct<text:string,score:double>>")
    assert _plan(rows.select(codes.owner_candidates("raw").alias("x"))).count("translate(") == 1
    assert _plan(rows.select(tokens.candidate_groups("pairs").alias("x"))).count("sequence(2") == 1


@pytest.mark.parametrize("name", ["split_door_code", "two_line_code"])
def test_readings_are_not_one_plan(spark, data, name):
    """The answer joins what its readings kept; it does not hold their plans."""
    plan = _plan(catalogue.queries()[name](spark, data))
    assert "Generate" not in plan and "Window" not in plan and "Aggregate" not in plan


def _dealt(spark, rows, kind):
    """The rows in several orders and partitions."""
    df = spark.createDataFrame(rows, kind)
    return [df.orderBy(F.desc("ord")).coalesce(1), df.orderBy("ord").coalesce(1), df.repartition(5, "ord")]


def _one_after_another(weights):
    total = 0.0
    for w in weights:
        total += w
    return total


def test_votes_are_added_in_their_order(spark):
    weights = [1e16, 1.0, 1.0, 1.0, -1e16, 0.1, 0.7]
    for df in _dealt(spark, [(1, k, "a", w) for k, w in enumerate(weights)], "k int, ord int, c string, w double"):
        got = ranking.votes(df, ["k"], "c", "w", "ord").collect()
        assert [(r["c"], r["vote"], r["first_seen"]) for r in got] == [("a", _one_after_another(weights), 0)]


def test_equal_sums_of_a_number_are_settled_alike(spark):
    """0.1 + 0.2 + 0.3 is above 0.6 from left to right, 0.3 + 0.2 + 0.1 is not."""
    scores = [("222222", 0.6), ("111111", 0.1), ("111111", 0.2), ("111111", 0.3)]
    kind = "k int, ord int, base6 string, check_digit string, score double, raw string, direct boolean, source string"
    for df in _dealt(spark, [(1, i, b, "", s, b, False, "base6") for i, (b, s) in enumerate(scores)], kind):
        assert [(r["base6"], r["score"]) for r in voting.pick_number(df, ["k"]).collect()] == [("111111", 0.1 + 0.2 + 0.3)]


def test_equal_sums_beside_a_number_are_settled_alike(spark):
    votes = [("2", 0.86), ("1", 0.1), ("1", 0.2), ("1", 0.4)]  # with 0.08 for each square, 0.94 and, from the first on, a little more
    for df in _dealt(spark, [(1, i, d, s, "square") for i, (d, s) in enumerate(votes)], "k int, ord int, digit string, score double, source string"):
        got = [(r["digit"], r["vote"]) for r in voting.right_check_vote(df, ["k"]).collect()]
        assert got == [("1", _one_after_another([0.1 + 0.08, 0.2 + 0.08, 0.4 + 0.08]))]
