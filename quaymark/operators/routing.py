"""Which layout an image has, which strategy answers, and how results are shaped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import codes
from quaymark.functions.text import clean
from quaymark.operators.ranking import best, top

VERTICAL_MAX, TWOLINES_MAX, ONELINE_MIN, HORIZONTAL_MIN = 0.22, 3.0, 3.0, 3.2


def layout(width: Column, height: Column, two_bands: Column, twolines_max: float = TWOLINES_MAX, oneline_min: float = ONELINE_MIN) -> Column:
    """vertical, twolines, oneline or unknown from the ratio of the sides and whether two text bands are apart."""
    ratio = width / height.cast("double")
    return F.when((height <= 0) | width.isNull() | height.isNull(), "unknown").when(ratio <= VERTICAL_MAX, "vertical").when(ratio <= twolines_max, "twolines").when(two_bands, "twolines").when(ratio >= oneline_min, "oneline").otherwise("unknown")


def is_horizontal(width: Column, height: Column) -> Column:
    return (height > 0) & (width / F.greatest(height, F.lit(1)).cast("double") >= HORIZONTAL_MIN)


def is_vertical(width: Column, height: Column) -> Column:
    return (height > 0) & (width / F.greatest(height, F.lit(1)).cast("double") <= VERTICAL_MAX)


def image_type(mode: Column, crop_layout: Column, direct_layout: Column) -> Column:
    """The crop's layout if it is known, else that of the whole image; unknown outside container mode."""
    return F.when(mode == "container", F.coalesce(F.nullif(crop_layout, F.lit("unknown")), F.nullif(direct_layout, F.lit("unknown")), F.lit("unknown"))).otherwise("unknown")


def route(layout_col: Column, horizontal: Column, vertical: Column, oneline_r: Column, twolines_r: Column, vertical_r: Column, generic_r: Column) -> Column:
    """The first strategy that applies and found something; each result is a struct with base10 and raw_text."""
    base = lambda r: F.coalesce(r["base10"], F.lit("")) != ""
    raw = lambda r: F.coalesce(r["raw_text"], F.lit("")) != ""
    one = (layout_col == "oneline") | horizontal
    return F.coalesce(F.when(one & base(oneline_r), oneline_r), F.when((layout_col == "twolines") & (base(twolines_r) | raw(twolines_r)), twolines_r), F.when(((layout_col == "vertical") | vertical) & (base(vertical_r) | (raw(vertical_r) & ~one)), vertical_r), generic_r)


def needs_retry(base10: Column, raw: Column) -> Column:
    """No base, and the raw text is six digits and nothing else."""
    return (F.coalesce(base10, F.lit("")) == "") & clean(raw).rlike("^[0-9]{6}$")


def result_rank(score: Column, raw: Column, base10: Column, status: Column, valid: Column) -> Column:
    """Score, 1 for text, 10 for a base, 2 or 4 by status, 3 for a right check digit."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return score + F.when(some(raw), 1.0).otherwise(0.0) + F.when(some(base10), 10.0).otherwise(0.0) + F.when(status == "PARTIAL_10", 2.0).when(status == "FULL_11", 4.0).otherwise(0.0) + F.when(valid, 3.0).otherwise(0.0)


def best_attempt(attempts: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The attempt of each key with the highest rank; the first of equals."""
    rank = result_rank(F.col("score"), F.col("raw_text"), F.col("base10"), F.col("status"), F.col("is_valid_iso"))
    return best(attempts.withColumn("rank", rank), keys, "rank", [order])


def eager_best(attempts: DataFrame, keys: list[str], enough: float = 0.93, stages: tuple[float, ...] = (0.83, 0.70)) -> DataFrame:
    """Best of staged attempts: a stage counts only while the best of those before it is under its mark, and none reached `enough`.

    Attempts are (keys, stage, ord, score); stage 0 always counts.
    """
    before = Window.partitionBy(*keys).orderBy("stage", "ord").rowsBetween(Window.unboundedPreceding, -1)
    stage_start = Window.partitionBy(*keys).orderBy("stage").rangeBetween(Window.unboundedPreceding, -1)
    mark = F.lit(float("inf"))
    for k, m in enumerate(stages, 1):
        mark = F.when(F.col("stage") == k, m).otherwise(mark)
    rows = attempts.withColumn("__so_far", F.max("score").over(before)).withColumn("__stages", F.max("score").over(stage_start))
    live = rows.where((F.coalesce("__so_far", F.lit(-1.0)) < enough) & ((F.col("stage") == 0) | (F.coalesce("__stages", F.lit(-1.0)) < mark)))
    return best(live, keys, "score", ["stage", "ord"]).drop("__so_far", "__stages")


def staged(df: DataFrame, stages: list[Callable[[DataFrame], DataFrame]], done: Column) -> DataFrame:
    """Run each stage only on rows that the stages before it left open; the union of all.

    Saves the costly stages for the hard rows.  Each stage gets the original columns and appends the same ones.
    """
    columns, open_rows, closed = df.columns, df, []
    for k, stage in enumerate(stages):
        out = stage(open_rows)
        closed.append(out if k == len(stages) - 1 else out.where(F.coalesce(done, F.lit(False))))
        open_rows = out.where(~F.coalesce(done, F.lit(False))).select(*columns)
    whole = closed[0]
    for part in closed[1:]:
        whole = whole.unionByName(part)
    return whole


def shape_full(df: DataFrame) -> DataFrame:
    """What the full-image reply holds: status from lengths, validity, reason; a missing score is -1, a score of 0 stays 0."""
    code = F.concat(F.coalesce("base10", F.lit("")), F.coalesce("check_digit", F.lit("")))
    status = codes.status(code, "raw_text")
    out = df.withColumn("full_code", F.when(F.length(code) >= 10, code).otherwise("")).withColumn("status", status).withColumn("score", F.coalesce("score", F.lit(-1.0))).withColumn("is_valid_iso", codes.is_valid(code))
    return out.withColumn("reason", F.when(F.col("full_code") != "", "ok").otherwise(F.lower("status")))


def shape_image(df: DataFrame, accept_other: bool = False) -> DataFrame:
    """What the full-image reply says: the code, or NOT_FOUND; with `accept_other` the raw text stands in for NOT_FOUND."""
    out = shape_full(df)
    found = F.coalesce(F.nullif("full_code", F.lit("")), F.lit("NOT_FOUND"))
    return out.withColumn("result", F.when(F.lit(accept_other) & (found == "NOT_FOUND"), F.coalesce("raw_text", F.lit(""))).otherwise(found))


def shape_of(height: Column, width: Column, channels: Column | None = None) -> Column:
    """[height, width, channels]; null where the image is missing."""
    parts = [height, width] if channels is None else [height, width, channels]
    known = height.isNotNull() & width.isNotNull()
    return F.when(known, F.filter(F.array(*[p.cast("int") for p in parts]), lambda x: x.isNotNull()))


def ratio_line(label: Column, name: Column, source: tuple[Column, Column], crop: tuple[Column, Column], box: Column) -> Column:
    """The line that says how a crop's sides compare with its image's: (height, width) of both, and the box, which may be null."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    ratio = lambda h, w: none(F.when((h > 0) & (w > 0), F.round(w / h.cast("double"), 3)))
    side = lambda a, b: F.when(box.isNotNull(), F.greatest(F.lit(0), box[b] - box[a]))
    fields = {"label": label, "file": F.coalesce(name, F.lit("")), "src_h": none(source[0]), "src_w": none(source[1]), "src_ratio": ratio(*source), "crop_h": none(crop[0]), "crop_w": none(crop[1]), "crop_ratio": ratio(*crop)}
    fields |= {"container_h": none(crop[0]), "container_w": none(crop[1]), "bbox_h": none(side("y1", "y2")), "bbox_w": none(side("x1", "x2"))}
    return F.concat(F.lit("[crop-ratio]"), *[F.concat(F.lit(f" {k}="), v) for k, v in fields.items()])


def first_valid_crop(results: DataFrame, keys: list[str], stop: bool = True, order: str = "crop") -> DataFrame:
    """One result of each image from those of its crops, in order: the first with a valid code, else the best by rank.

    With `stop` off the last valid one holds, as every crop is read.
    """
    valid = (F.col("base10") != "") & F.col("is_valid_iso")
    rank = result_rank(F.col("score"), F.col("raw_text"), F.col("base10"), F.col("status"), F.col("is_valid_iso"))
    place = F.col(order) if stop else -F.col(order)
    return best(results.withColumn("__r", F.when(valid, F.lit(float("inf"))).otherwise(rank)), keys, "__r", [F.when(valid, place).otherwise(F.col(order))]).drop("__r")


def shape_crop(df: DataFrame, accept_other: bool = False) -> DataFrame:
    """What the crop reply holds; with `accept_other` a NOT_FOUND result falls back to the candidate or the raw text."""
    out = shape_full(df).withColumn("candidate", F.col("full_code"))
    found = F.when(F.col("status").isin("FULL_11", "PARTIAL_10"), F.col("full_code")).otherwise("NOT_FOUND")
    fallback = F.coalesce(F.nullif("candidate", F.lit("")), F.nullif(F.coalesce("raw_text", F.lit("")), F.lit("")), F.lit("NOT_FOUND"))
    return out.withColumn("result", F.when(F.lit(accept_other) & (found == "NOT_FOUND"), fallback).otherwise(found))


def seam_pad(width: Column) -> Column:
    """Pixels on either side of a door seam that belong to neither part."""
    return F.greatest(F.lit(14), (width * 0.014).cast("int"))


def sides_of(width: Column, cut: Column) -> Column:
    """struct<left_end, right_start> of the parts beside a seam; null if one is too narrow."""
    left, right = F.greatest(F.lit(1), cut - seam_pad(width)), F.least(width, cut + seam_pad(width))
    wide = (left >= (width * 0.22).cast("int")) & (width - right >= (width * 0.12).cast("int"))
    return F.when(wide, F.struct(left.alias("left_end"), right.alias("right_start")))


def seam_allowed(width: Column, height: Column, cut: Column, max_ratio: float = 3.0, min_height: int = 420) -> Column:
    """May a door seam at `cut` split the image: tall enough, neither too narrow nor too wide, both sides wide enough beside the seam."""
    ratio = width / F.greatest(height, F.lit(1)).cast("double")
    return (height >= min_height) & ratio.between(1.35, max_ratio) & sides_of(width, cut).isNotNull()


def _left_bands(bands: DataFrame, keys: list[str], min_gap: Column) -> DataFrame:
    """(keys, x, gap, strengths): the two strongest text bands left of each place x, if far enough apart."""
    two = top(bands, [*keys, "x"], 2, [F.col("strength").desc(), (F.col("end") - F.col("start")).desc(), F.col("start")])
    both = two.groupBy(*keys, "x").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("b"), F.sum("strength").alias("strengths"), F.first("height").alias("height"))
    both = both.where(F.size("b") == 2).withColumn("gap", F.col("b")[1]["start"] - F.col("b")[0]["end"])
    return both.where(F.col("gap") >= min_gap).select(*keys, "x", "gap", "strengths")


def seam(columns: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x): where a door seam is likeliest.

    Column rows are (keys, x, edge, density, width, height), one for each column; band rows are (keys, x, start, end,
    strength, height), the text bands of the image left of the seam's pad at x.  Between 28 and 72 % of the width the
    columns with most edge less 0.35 of the peak per density are tried, a fortieth of them, 3 to 10; the two strongest
    bands at the left add 0.0008 of their strengths and 0.4 of their gap, and 20 of the distance of the left share from
    0.42 is taken off.  Without a candidate with two bands apart the strongest column counts.
    """
    w = Window.partitionBy(*keys)
    scored = columns.withColumn("__peak", F.greatest(F.lit(1.0), F.max("edge").over(w))).withColumn("__local", F.col("edge") - F.col("density") * F.col("__peak") * 0.35)
    lo, hi = (F.col("width") * 0.28).cast("int"), (F.col("width") * 0.72).cast("int")
    inner = scored.where((F.col("width") >= 200) & (F.col("height") >= 120) & (hi - lo >= 24) & (F.col("x") >= lo) & (F.col("x") < hi))
    order = w.orderBy(F.col("__local").desc(), "x")
    inner = inner.withColumn("__rank", F.row_number().over(order)).withColumn("__best", F.max("__local").over(w)).where("__best > 0")
    few = inner.where(F.col("__rank") <= F.least(F.lit(10), F.greatest(F.lit(3), F.floor((hi - lo) / 40))))
    sides = sides_of(F.col("width"), F.col("x"))
    few = few.withColumn("__left", sides["left_end"]).where("__left is not null")
    joined = few.join(_left_bands(bands, keys, F.greatest(F.lit(5), (F.col("height") * 0.02).cast("int"))), [*keys, "x"])
    score = F.col("__local") + 0.0008 * F.col("strengths") - 20.0 * F.abs(F.col("__left") / F.col("width").cast("double") - 0.42) + 0.4 * F.col("gap")
    tried = best(joined.withColumn("__score", score).where("__score > -1"), keys, "__score", ["__rank"]).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("x").alias("__x"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return inner.where("__rank = 1").join(tried, same, "left").select(*keys, F.coalesce("__x", "x").alias("x"))


def seam_candidates(images: DataFrame, estimated: str = "x") -> DataFrame:
    """One row for each place to try, each once: the estimated seam, then 30 to 70 % of the width in steps of 1.8 % (18 pixels at least).

    (columns of `images` without the estimate, cand_ord, x)
    """
    lo, hi, step = (F.col("width") * 0.30).cast("int"), (F.col("width") * 0.70).cast("int"), F.greatest(F.lit(18), (F.col("width") * 0.018).cast("int"))
    steps = F.when(hi > lo, F.sequence(lo, F.greatest(lo, hi - 1), step)).otherwise(F.array().cast("array<int>"))
    places = F.array_distinct(F.filter(F.concat(F.array(F.col(estimated).cast("int")), steps), lambda x: x.isNotNull()))
    rest = [c for c in images.columns if c != estimated]
    return images.select(*rest, F.posexplode(places).alias("cand_ord", "x"))


def split_at_seam(candidates: DataFrame, bands: DataFrame, keys: list[str], max_ratio: float = 3.0, min_height: int = 420) -> DataFrame:
    """(keys, x, seam_score): the candidate (keys, cand_ord, x, width, height) that splits best.

    0.001 of the strengths of the two strongest bands at the left and their gap, less 25 of the distance of the left
    share from 0.40; none where no candidate is allowed or has two bands apart.
    """
    ok = candidates.where(seam_allowed(F.col("width"), F.col("height"), F.col("x"), max_ratio, min_height))
    ok = ok.withColumn("__left", sides_of(F.col("width"), F.col("x"))["left_end"])
    rows = ok.join(_left_bands(bands, keys, F.greatest(F.lit(5), (F.col("height") * 0.015).cast("int"))), [*keys, "x"])
    score = 0.001 * F.col("strengths") + F.col("gap") - 25.0 * F.abs(F.col("__left") / F.col("width").cast("double") - 0.40)
    return best(rows.withColumn("seam_score", score).where("seam_score > -1"), keys, "seam_score", ["cand_ord"]).select(*keys, "x", "seam_score")
