"""Boxes: overlap, clamping, candidate squares and greedy suppression.  A box is (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iou(a: tuple, b: tuple) -> Column:
    """Shared area over joint area; areas count as 1 at least, boxes that do not overlap give 0."""
    ax1, ay1, ax2, ay2 = map(_c, a)
    bx1, by1, bx2, by2 = map(_c, b)
    w, h = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    area = lambda x1, y1, x2, y2: F.greatest(F.lit(1), (x2 - x1) * (y2 - y1)).cast("double")
    shared = (w * h).cast("double")
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(shared / F.greatest(F.lit(1.0), area(ax1, ay1, ax2, ay2) + area(bx1, by1, bx2, by2) - shared))


def clamp(x1, y1, x2, y2, width, height) -> Column:
    """The box inside the image, null if nothing is left."""
    box = F.struct(F.greatest(F.lit(0), _c(x1)).alias("x1"), F.greatest(F.lit(0), _c(y1)).alias("y1"), F.least(_c(width), _c(x2)).alias("x2"), F.least(_c(height), _c(y2)).alias("y2"))
    return F.when((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box)


def zone(width, height, x1: float, y1: float, x2: float, y2: float) -> Column:
    """A zone given in shares of the image, in whole pixels towards zero."""
    return clamp(*[(_c(d) * s).cast("int") for d, s in ((width, x1), (height, y1), (width, x2), (height, y2))], width, height)


def inner(x1, y1, x2, y2, margin: float) -> Column:
    """The box less a margin of its smaller side on all sides; the box itself if nothing is left."""
    m = (F.least(_c(x2) - _c(x1), _c(y2) - _c(y1)) * margin).cast("int")
    whole = F.struct(_c(x1).alias("x1"), _c(y1).alias("y1"), _c(x2).alias("x2"), _c(y2).alias("y2"))
    less = F.struct((_c(x1) + m).alias("x1"), (_c(y1) + m).alias("y1"), (_c(x2) - m).alias("x2"), (_c(y2) - m).alias("y2"))
    return F.when((less["x2"] > less["x1"]) & (less["y2"] > less["y1"]), less).otherwise(whole)


def padding(width, height, left: float = 0.10, right: float = 0.12, top: float = 0.07, bottom: float = 0.07) -> Column:
    return F.struct(*[(_c(d) * s).cast("int").alias(n) for n, d, s in (("left", width, left), ("right", width, right), ("top", height, top), ("bottom", height, bottom))])


def bounding_box(pixels: DataFrame, keys: list[str], width: str, height: str, pad: int = 2) -> DataFrame:
    """(keys, x1, y1, x2, y2) around all non-zero pixels, padded and inside the image."""
    box = pixels.where("v > 0").groupBy(*keys, width, height).agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"))
    return box.select(*keys, F.greatest(F.lit(0), F.col("a") - pad).alias("x1"), F.greatest(F.lit(0), F.col("b") - pad).alias("y1"), F.least(F.col(width), F.col("c") + 1 + pad).alias("x2"), F.least(F.col(height), F.col("d") + 1 + pad).alias("y2"))


def square_candidates(rects: DataFrame, zone_w: str, zone_h: str) -> DataFrame:
    """Rects (x, y, w, h) that look like the check digit's square, as padded boxes with their area: 1 to 45 % of
    the zone, sides alike, not at the left edge."""
    area, zone_area = (F.col("w") * F.col("h")).cast("double"), F.greatest(F.lit(1), F.col(zone_w) * F.col(zone_h)).cast("double")
    ok = (F.col("w") > 2) & (F.col("h") > 2) & area.between(zone_area * 0.01, zone_area * 0.45) & (F.col("w") / F.col("h")).between(0.62, 1.45) & (F.col("x") >= (F.col(zone_w) * 0.08).cast("int"))
    pad = (F.greatest("w", "h") * 0.14).cast("int")
    box = clamp(F.col("x") - pad, F.col("y") - pad, F.col("x") + F.col("w") + pad, F.col("y") + F.col("h") + pad, zone_w, zone_h)
    return rects.where(ok).withColumn("area", area).withColumn("box", box).where("box is not null").select("*", "box.*").drop("box")


def suppress_two(boxes: DataFrame, keys: list[str], order: str = "ord", threshold: float = 0.72) -> DataFrame:
    """At most two boxes of each key: the largest, and the largest of those that overlap it less than `threshold`."""
    w = Window.partitionBy(*keys).orderBy(F.col("area").desc(), order)
    ranked = boxes.withColumn("rank", F.row_number().over(w))
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = ranked.withColumn("__iou", iou(("x1", "y1", "x2", "y2"), tuple(first(c) for c in ("x1", "y1", "x2", "y2"))))
    second = F.min(F.when((F.col("rank") > 1) & (F.col("__iou") < threshold), F.col("rank"))).over(Window.partitionBy(*keys))
    return seen.withColumn("__second", second).where((F.col("rank") == 1) | (F.col("rank") == F.col("__second"))).drop("__iou", "__second")


def suppress(boxes: DataFrame, keys: list[str], order: str = "ord", threshold: float = 0.72, most: int = 1 << 30) -> DataFrame:
    """Greedy suppression without the limit of two: a fold over the boxes of a key, largest first."""
    item = F.struct((-F.col("area")).alias("minus_area"), F.col(order).alias("ord"), "x1", "y1", "x2", "y2")
    rows = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("b"))
    corners = lambda x: (x["x1"], x["y1"], x["x2"], x["y2"])
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda k, x: F.when((F.size(k) >= most) | F.exists(k, lambda y: iou(corners(x), corners(y)) >= threshold), k).otherwise(F.concat(k, F.array(x))))
    return rows.select(*keys, F.posexplode(kept).alias("rank", "__kept")).select(*keys, (F.col("rank") + 1).alias("rank"), F.col("__kept.ord").alias(order), (-F.col("__kept.minus_area")).alias("area"), "__kept.x1", "__kept.y1", "__kept.x2", "__kept.y2")


#: The three zones at the right in which a check digit is looked for, in shares of the image, from wide to tight.
CHECK_ZONES = (("primary", 0.72, 0.03, 1.0, 0.97), ("mid", 0.76, 0.05, 1.0, 0.95), ("tight", 0.84, 0.02, 1.0, 0.98))
INNER_MARGIN = 0.06


def check_zones(images: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """One row for each image and zone, with the zone's box in pixels."""
    table = F.array(*[F.struct(F.lit(n).alias("zone"), zone(width, height, *box).alias("box")) for n, *box in CHECK_ZONES])
    rows = images.select("*", F.posexplode(table).alias("zone_ord", "__z"))
    return rows.where("__z.box is not null").select(*images.columns, "zone_ord", "__z.zone", "__z.box.*")


def check_votes(squares: DataFrame, zone_reads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, digit, score, source, zone): reads of at most two squares of each zone, whole and inner, and of the zones.

    `squares` has (keys, zone_ord, zone, rank, digit, score, inner_digit, inner_score); empty reads give no vote.
    """
    whole = squares.select(*keys, "zone_ord", "zone", "rank", F.lit(0).alias("part"), "digit", "score", F.lit("square").alias("source"))
    inside = squares.select(*keys, "zone_ord", "zone", "rank", F.lit(1).alias("part"), F.col("inner_digit").alias("digit"), F.col("inner_score").alias("score"), F.lit("square_inner").alias("source"))
    zones = zone_reads.select(*keys, "zone_ord", "zone", F.lit(9).alias("rank"), F.lit(2).alias("part"), "digit", "score", F.lit("zone").alias("source"))
    every = whole.where("rank <= 2").unionByName(inside.where("rank <= 2")).unionByName(zones).where("digit <> ''")
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("zone_ord", "rank", "part"))
    return every.select(*keys, (order - 1).alias("ord"), "digit", "score", "source", "zone")


def left_to_right(parts: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Components in reading order: `i` counts from 0 by their left edges; of equal ones the upper first."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(x, "y")) - 1
    return parts.withColumn("i", place)
