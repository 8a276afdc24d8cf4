"""Best rows, votes and margins.  Every helper takes the order that breaks ties; none uses a bare maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, keys: list[str], score: str | Column, order: list[str | Column]) -> DataFrame:
    """The row with the highest score of each key; of equal scores the first in `order`."""
    score = F.col(score) if isinstance(score, str) else score
    w = Window.partitionBy(*keys).orderBy(score.desc(), *order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def top(df: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def votes(df: DataFrame, keys: list[str], choice: str, weight: str | Column, order: str, out: str = "vote") -> DataFrame:
    """Sum of weights of each choice, with the order of its first vote.

    Weights are added one after another in `order`: the last digits of a sum depend on it, and so does who wins where sums
    are equal but for them.  A grouped sum adds in an order that changes from run to run.
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    rows = df.select(*keys, choice, F.col(order).alias("__at"), weight.alias("__weight"))
    w = Window.partitionBy(*keys, choice).orderBy("__at", "__weight")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*keys, choice, F.sum("__weight").over(so_far).alias(out), F.min("__at").over(so_far).alias("first_seen"), F.lead(F.lit(True)).over(w).alias("__more"))
    return rows.where("__more is null").drop("__more")


def winner(tally: DataFrame, keys: list[str], vote: str = "vote", first: str = "first_seen") -> DataFrame:
    """The choice with most votes of each key, how many choices there were and its margin over the next (or over nothing)."""
    w = Window.partitionBy(*keys).orderBy(F.col(vote).desc(), F.col(first))
    rows = tally.select("*", F.row_number().over(w).alias("__rank"), F.lead(vote).over(w).alias("__next"), F.count("*").over(Window.partitionBy(*keys)).alias("vote_count"))
    return rows.where("__rank = 1").withColumn("margin", F.col(vote) - F.coalesce("__next", F.lit(0) * F.col(vote))).drop("__rank", "__next")


def first_valid_stop(df: DataFrame, keys: list[str], order: str, valid: Column) -> DataFrame:
    """Rows up to and with the first valid one of each key; all rows if none is valid."""
    first = F.min(F.when(valid, F.col(order))).over(Window.partitionBy(*keys))
    return df.withColumn("__first", first).where(F.col("__first").isNull() | (F.col(order) <= F.col("__first"))).drop("__first")


def last_values(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Count of rows and the last value of each column; `order` must be unique within a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("processed"), *[F.max_by(c, order).alias(c) for c in columns])


def distinct_in_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return best(df, keys, F.lit(0), [order])


def numbered(df: DataFrame, order: str, out: str = "id", first: int = 1, ranges: int = 256) -> DataFrame:
    """Append `out`: the number of each row in the order of `order`, from `first` on, with no task that holds all rows.

    `ranges` bounds, taken from a sample of as many hundred values, cut the order into ranges; ranges are numbered inside
    and start where the counts of the ranges before them end.  The bounds are plain values, so that any run of the plan
    cuts alike; they decide the balance only, never the numbers.  `order` should be unique: equal values are numbered in any
    order and stay in one range.  Nulls come first.
    """
    sample = df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(100 * ranges)
    values = sorted(r[0] for r in sample.collect())  # at most 100 * ranges values
    bounds = sorted({values[len(values) * k // ranges] for k in range(1, ranges)}) if values else []
    at = F.coalesce(F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(order))), F.lit(0)) if bounds else F.lit(0)
    rows = df.withColumn("__range", F.when(F.col(order).isNull(), -1).otherwise(at))
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    counts = counts.select(F.col("__range").alias("__r"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    rows = rows.withColumn("__i", inside).join(F.broadcast(counts), F.col("__range") == F.col("__r"))
    return rows.withColumn(out, F.col("__before") + F.col("__i") + (first - 1)).drop("__range", "__r", "__before", "__i")
