"""One-dimensional bands: threshold runs, gap merging, the two strongest, symbol segmentation.

A profile row is (keys, pos, strength); a band row is (keys, start, end[, strength]) with an exclusive end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions.codes import let
from quaymark.operators.ranking import top


def profile(pixels: DataFrame, keys: list[str], axis: str, value: str = "v") -> DataFrame:
    """Count of non-zero pixels at each place of an axis."""
    return pixels.groupBy(*keys, F.col(axis).alias("pos")).agg(F.count_if(F.col(value) > 0).alias("strength"))


def threshold_runs(rows: DataFrame, keys: list[str], threshold: Column | float, pos: str = "pos", strength: str = "strength") -> DataFrame:
    """Maximal runs of neighbouring places at or over the threshold, with the sum of their strengths.

    A run ends at a place below the threshold or where places are missing; an open run ends behind its last place.
    """
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    w = Window.partitionBy(*keys).orderBy(pos)
    live = rows.where(F.col(strength) >= threshold).withColumn("__island", F.col(pos) - F.row_number().over(w))
    return live.groupBy(*keys, "__island").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.sum(strength).alias("strength")).drop("__island")


def merge_gaps(bands: DataFrame, keys: list[str], max_gap: Column | float, start: str = "start", end: str = "end", sums: tuple[str, ...] = ()) -> DataFrame:
    """Join bands whose gap to the one before is at most `max_gap`; for bands sorted and apart."""
    max_gap = max_gap if isinstance(max_gap, Column) else F.lit(max_gap)
    w = Window.partitionBy(*keys).orderBy(start, end)
    opens = F.coalesce((F.col(start) - F.lag(end).over(w) > max_gap).cast("int"), F.lit(1))
    rows = bands.withColumn("__opens", opens).withColumn("__group", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__group").agg(F.min(start).alias(start), F.max(end).alias(end), *[F.sum(s).alias(s) for s in sums]).drop("__group")


def two_strongest(bands: DataFrame, keys: list[str], min_gap: Column | float) -> DataFrame:
    """(keys, top_start, top_end, bottom_start, bottom_end): the two strongest bands by strength, then height, if far enough apart."""
    min_gap = min_gap if isinstance(min_gap, Column) else F.lit(min_gap)
    rows = top(bands, keys, 2, [F.col("strength").desc(), (F.col("end") - F.col("start")).desc(), F.col("start")])
    both = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("b")).where(F.size("b") == 2)
    both = both.select(*keys, F.col("b")[0]["start"].alias("top_start"), F.col("b")[0]["end"].alias("top_end"), F.col("b")[1]["start"].alias("bottom_start"), F.col("b")[1]["end"].alias("bottom_end"))
    return both.where(F.col("bottom_start") - F.col("top_end") >= min_gap)


def text_rows(profile_rows: DataFrame, keys: list[str], width: str, height: str) -> DataFrame:
    """Text row bands of an image: threshold 8 % of the width, gaps up to 1.8 % of the height, at least 6 % high."""
    dims = [*keys, width, height]
    runs = threshold_runs(profile_rows, dims, F.greatest(F.lit(2), (F.col(width) * 0.08).cast("int")))
    merged = merge_gaps(runs.drop("strength"), dims, F.greatest(F.lit(3), (F.col(height) * 0.018).cast("int")))
    tall = merged.where(F.col("end") - F.col("start") >= F.greatest(F.lit(8), (F.col(height) * 0.06).cast("int")))
    inside = profile_rows.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("pos"), F.col("strength"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    joined = tall.join(inside, same & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    return joined.groupBy(*dims, "start", "end").agg(F.sum("strength").alias("strength"))


def typical_height(bands: DataFrame, keys: list[str], height: str) -> DataFrame:
    """Append typical_height: the median height of the lower bands, those up to the 70th percentile, in whole pixels.

    Bands below 8 pixels or 1.5 % of the image's height (column `height`) are left out; null if no other is there.
    """
    tall = F.col("end") - F.col("start")
    least = F.greatest(F.lit(8), (F.col(height) * 0.015).cast("int"))
    some = bands.withColumn("__tall", F.when(tall >= least, tall))
    p70 = some.groupBy(*keys).agg(F.percentile("__tall", 0.7).alias("__p70"))
    short = some.join(p70, keys).where(F.col("__tall") <= F.col("__p70"))
    median = short.groupBy(*keys).agg(F.greatest(F.max(least), F.median("__tall").cast("int")).alias("typical_height"))
    return bands.join(median, keys, "left")


def parts_of(tall: Column, typical: Column) -> Column:
    """Into how many symbols a band falls: from 1.6 times the typical height on the rounded ratio, 2 to 6; else 1."""
    return F.when(tall >= (typical * 1.6).cast("int"), F.greatest(F.lit(2), F.least(F.lit(6), F.bround(tall / typical.cast("double")).cast("int")))).otherwise(1)


def choose_segmentation(refined: Column | str, raw: Column | str, merged: Column | str) -> Column:
    """Which of three lists of so many symbols counts: the first with 10 to 12; else refined if it has at least 8 and
    more than raw; else raw if it has at least 8 and more than merged; else merged."""
    refined, raw, merged = (F.col(c) if isinstance(c, str) else c for c in (refined, raw, merged))
    few = F.when(refined.between(10, 12), "refined").when(raw.between(10, 12), "raw").when(merged.between(10, 12), "merged")
    return F.coalesce(few, F.when((refined > raw) & (refined >= 8), "refined").when((raw > merged) & (raw >= 8), "raw").otherwise("merged"))


def tall_enough(bands: DataFrame, height: str, least: int = 8, share: float = 0.015) -> DataFrame:
    """The bands of at least `least` pixels and that share of the image's height."""
    return bands.where(F.col("end") - F.col("start") >= F.greatest(F.lit(least), (F.col(height) * share).cast("int")))


def equal_grid(df: DataFrame, start: str, end: str, parts: int) -> DataFrame:
    """One row for each of `parts` bands of equal height; places inside the region are rounded half to even, bands
    below 8 pixels or 4 % of the region are left out, and fewer than 10 parts give none."""
    tall = F.col(end) - F.col(start)
    edge = lambda k: F.bround(tall * k / F.lit(float(parts))).cast("int")
    cells = df.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(edge(k).alias("a"), edge(k + 1).alias("b")))).alias("part", "__g"))
    cells = cells.where((F.lit(parts) >= 10) & (F.col("__g.b") - F.col("__g.a") >= F.greatest(F.lit(8), (tall * 0.04).cast("int"))))
    return cells.withColumn("part_start", F.col(start) + F.col("__g.a")).withColumn("part_end", F.col(start) + F.col("__g.b")).drop("__g")


#: A Gaussian over seven places.
GAUSSIAN_7 = (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)


def smoothed(profile: Column) -> Column:
    """The profile under a Gaussian of seven places, mirrored at both ends."""

    def blur(own: Column) -> Column:
        n = F.size(own)
        span = F.greatest(n - 1, F.lit(1))

        def at(i: Column) -> Column:
            inside = F.abs(i) % (span * 2)
            return F.coalesce(F.try_element_at(own, F.when(inside < n, inside).otherwise(span * 2 - inside) + 1), own[0]).cast("double")

        return F.transform(own, lambda v, i: sum((at(i + k - 3) * w for k, w in enumerate(GAUSSIAN_7)), F.lit(0.0)))

    return let(profile, blur)


def split_at_valleys(profile: Column, start: Column, end: Column, parts: Column) -> Column:
    """array<struct<start, end>>: a band cut into `parts` at the weakest smoothed places near equal cuts.

    `profile`: strengths by place of the whole image.  A cut is looked for within a third of a part (6 places at
    least) of its equal place, and a part is half an equal part (10 places at least) high; without room the equal place
    counts.  Parts below 8 places are dropped; if fewer than two are left, the band stays whole.  A fold, since each
    cut bounds the next.
    """
    length = (end - start).cast("int")
    near = smoothed(F.slice(profile, start + 1, F.greatest(length, F.lit(1))))
    least = F.greatest(F.lit(10), F.floor(length / F.greatest(parts * 2, F.lit(2))).cast("int"))
    reach = F.greatest(F.lit(6), F.floor(length / F.greatest(parts * 3, F.lit(3))).cast("int"))

    def cut(done: Column, k: Column, near: Column) -> Column:
        goal = F.bround(length * k / parts.cast("double")).cast("int")
        lo, hi = F.greatest(F.element_at(done, -1) + least, goal - reach), F.least(length - (parts - k) * least, goal + reach)
        places = F.sequence(lo, F.greatest(lo, hi - 1))
        weakest = F.array_min(F.transform(places, lambda p: F.struct(F.try_element_at(near, p + 1).alias("v"), p.alias("p"))))["p"]
        return F.concat(done, F.array(F.when(hi <= lo, goal).otherwise(weakest)))

    found = let(near, lambda own: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), parts - 1)), F.array(F.lit(0)), lambda done, k: cut(done, k, own)))
    pair = lambda cuts: F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda a, i: F.struct((start + a).cast("int").alias("start"), (start + F.element_at(cuts, i + 2)).cast("int").alias("end")))
    pieces = let(F.concat(found, F.array(length)), pair)
    tall = F.filter(pieces, lambda p: p["end"] - p["start"] >= 8)
    whole = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
    return F.when((parts <= 1) | (length <= 0), whole).otherwise(F.when(F.size(tall) > 1, tall).otherwise(whole))


def refined_bands(bands: DataFrame, profiles: DataFrame, keys: list[str], height: str) -> DataFrame:
    """Tall bands cut at valleys: (keys, start, end).  `profiles`: (keys, profile), the strengths by place as an array."""
    rows = typical_height(bands, keys, height).join(profiles, keys)
    tall = F.col("end") - F.col("start")
    parts = F.when(F.col("typical_height").isNull(), 1).otherwise(parts_of(tall, F.col("typical_height"))).cast("int")
    return rows.select(*keys, F.explode(split_at_valleys(F.col("profile"), F.col("start"), F.col("end"), parts)).alias("__b")).select(*keys, "__b.*")


def deepest_valley(rows: DataFrame, keys: list[str], min_part: int, lo: float = 0.28, hi: float = 0.72, depth: float = 0.62) -> DataFrame:
    """(keys, cut): the first weakest place between `lo` and `hi` of a component's width, if the component falls in two there.

    No cut if the component is narrower than 20 or two parts, if less than 4 places are searched, if the valley is over
    `depth` of the peak or if a part would be narrower than `min_part`.  Each place of a component is a row (pos, strength).
    """
    w = Window.partitionBy(*keys)
    first, wide = F.min("pos").over(w), F.max("pos").over(w) - F.min("pos").over(w) + 1
    marked = rows.withColumn("__n", wide).withColumn("__at", F.col("pos") - first).withColumn("__peak", F.max("strength").over(w))
    n = F.col("__n")
    a, b = F.greatest(F.lit(2), (n * lo).cast("int")), F.least(n - 2, (n * hi).cast("int"))
    inner = marked.where((n >= max(20, 2 * min_part)) & (b - a >= 4) & (F.col("__at") >= a) & (F.col("__at") < b))
    low = inner.groupBy(*keys).agg(F.min(F.struct("strength", "__at", "pos")).alias("low"), F.first("__peak").alias("peak"), F.first("__n").alias("n"))
    good = (F.col("peak") > 0) & (F.col("low.strength") <= depth * F.col("peak")) & (F.col("low.__at") >= min_part) & (F.col("n") - F.col("low.__at") >= min_part)
    return low.where(good).select(*keys, F.col("low.pos").alias("cut"))
