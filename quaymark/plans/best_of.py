"""The best reading of a whole crop over its prepared variants, each content read once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.functions import codes
from quaymark.operators import ranking, tokens

#: A valid code of this score ends the search; how much a debug preview shows; the reason where no variant gave a code.
ENOUGH, PREVIEW, NOTHING = 0.93, 8, "uninitialized"


def readers(images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reader_*): for each image (keys, height, width, digest) the first one of equal size and content, which is read for all of them."""
    content = ["height", "width", "digest"]
    first = ranking.best(images, content, F.lit(0), keys).select(*[F.col(c).alias(f"__{c}") for c in content], *[F.col(k).alias(f"reader_{k}") for k in keys])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in content]
    return images.join(first, same[0] & same[1] & same[2]).select(*keys, *[f"reader_{k}" for k in keys])


def _variant(token_rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best code of each key with previews of what it was chosen from; none for keys without a code."""
    found = tokens.best_code(token_rows, keys).select(*keys, F.col("code").alias("text"), F.col("final").alias("score"), codes.is_valid("code").alias("is_valid"))
    pairs = tokens.collected(token_rows, keys).withColumn("groups", tokens.candidate_groups("pairs"))
    hits = F.array_distinct(F.flatten(F.transform("groups", lambda g: codes.code_windows(g["raw"]))))
    debug = pairs.select(
        *keys, F.size("pairs").alias("text_pair_count"), F.transform(F.slice("pairs", 1, PREVIEW), lambda p: F.struct(p["text"].alias("text"), F.round(p["score"], 4).alias("score"))).alias("text_pairs"),
        F.size("groups").alias("candidate_group_count"), F.transform(F.slice("groups", 1, PREVIEW), lambda g: g["raw"]).alias("candidate_groups"), F.slice(hits, 1, PREVIEW).alias("normalized_candidates"),
    )
    return found.join(debug, keys)


def best_of_variants(token_rows: DataFrame, images: DataFrame, keys: list[str], enough: float = ENOUGH) -> DataFrame:
    """(keys, text, score, is_valid, variant, reason and previews) of every image.

    Token rows have `variant`: fast, or hard, which counts only for images without a valid code of at least `enough` and
    then has to be better.  Images are (keys, height, width, digest); only the first image of each content needs tokens, the others
    get its answer.  Without a code the text is empty and the score -1.
    """
    who = readers(images, keys)
    own = [f"reader_{k}" for k in keys]
    asked = who.select(*own).distinct().withColumnsRenamed(dict(zip(own, keys, strict=True)))
    rows = token_rows.join(asked, keys, "left_semi")
    fast = _variant(rows.where("variant = 'fast'").drop("variant"), keys).withColumn("variant", F.lit("fast"))
    done = fast.where(F.col("is_valid") & (F.col("score") >= enough)).select(*keys)
    hard = _variant(rows.where("variant = 'hard'").drop("variant").join(done, keys, "left_anti"), keys).withColumn("variant", F.lit("hard"))
    best = ranking.best(fast.unionByName(hard), keys, "score", ["variant"]).withColumnsRenamed(dict(zip(keys, own, strict=True)))
    out = who.join(best, own, "left").drop(*own)
    blank = {"text": F.coalesce("text", F.lit("")), "score": F.coalesce("score", F.lit(-1.0)), "is_valid": F.coalesce("is_valid", F.lit(False)), "reason": F.when(F.col("text").isNull(), NOTHING).otherwise("ok")}
    return out.withColumns(blank)


def segmentation_debug(images: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segmentation): how many symbols each layout's regions gave, as one struct; what a layout does not look at is null.

    Images are (keys, layout, bands, split), found rows (keys, region), one for each symbol: top, bottom, owner, left,
    right, segments, grid11, square.  Two-line images without two bands count as split doors if a seam was found; layouts
    that are neither two lines nor vertical count square shapes.
    """
    names = ("top", "bottom", "owner", "left", "right", "segments", "grid11", "square")
    counts = found.groupBy(*keys).agg(*[F.count_if(F.col("region") == n).alias(f"__{n}") for n in names])
    rows = images.join(counts, keys, "left")
    two, upright = F.col("layout") == "twolines", F.col("layout") == "vertical"
    banded, door = two & F.col("bands"), two & ~F.col("bands") & F.col("split")
    many = lambda name, where: F.when(where, F.coalesce(f"__{name}", F.lit(0)))
    fields = [
        F.col("layout").alias("layout_type"), F.when(door, "split_door").alias("segmentation_kind"), many("top", banded).alias("top_symbol_count"), many("bottom", banded).alias("bottom_symbol_count"),
        many("owner", door).alias("owner_symbol_count"), many("left", door).alias("left_symbol_count"), many("right", door).alias("right_symbol_count"),
        many("segments", upright).alias("segmented_symbol_count"), many("grid11", upright).alias("grid11_symbol_count"), many("square", ~two & ~upright).alias("square_like_count"),
    ]
    return rows.select(*keys, F.struct(*fields).alias("segmentation"))
