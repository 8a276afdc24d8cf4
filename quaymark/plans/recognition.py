"""From token rows to a container code.  Every zone, variant or rotation is a value of a key column, not a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import codes
from quaymark.functions.text import clean, seal_quality
from quaymark.operators import ranking, routing, tokens, voting


def _named(keys: list[str], base: DataFrame, *parts: DataFrame) -> DataFrame:
    for p in parts:
        base = base.join(p, keys, "left")
    return base


def _with_defaults(rows: DataFrame, **values) -> DataFrame:
    """Columns that are not there get one value."""
    return rows.withColumns({c: F.lit(v) for c, v in values.items() if c not in rows.columns})


def owner_of(token_rows: DataFrame, keys: list[str], phase: str = "phase", bonus: str = "bonus") -> DataFrame:
    """(keys, owner, owner_score, owner_raw): the best owner of phase 0, or of phase 1 if that is needed and better.

    Needed are harder phases where there is no owner, its score is under 1.145 or its text has not just four characters.
    """
    own = [*keys, phase, bonus]
    each = tokens.best_owner(token_rows, own).withColumn("final", F.col("final") + F.col(bonus))
    each = ranking.best(each, [*keys, phase], "final", [bonus])
    found = each.groupBy(*keys).pivot(phase, [0, 1]).agg(F.first(F.struct("code", "final", "raw"))).withColumnsRenamed({"0": "__fast", "1": "__hard"})
    weak = F.col("__fast").isNull() | (F.col("__fast.final") < 1.145) | (F.length(clean("__fast.raw")) != 4)
    pick = F.when(F.col("__fast").isNull() | (weak & (F.col("__hard.final") > F.col("__fast.final"))), F.coalesce("__hard", "__fast")).otherwise(F.col("__fast"))
    return found.withColumn("__o", pick).select(*keys, F.col("__o.code").alias("owner"), F.col("__o.final").alias("owner_score"), F.col("__o.raw").alias("owner_raw"))


def needs_resize(base6: Column, check_digit: Column, direct: Column, votes: Column, margin: Column) -> Column:
    """Must the digit zones be read again enlarged?"""
    some = check_digit != ""
    return (base6 == "") | (~some & (votes > 0)) | (some & ~direct & (margin < 1.02))


def needs_hard(base6: Column, check_digit: Column, direct: Column, votes: Column, margin: Column) -> Column:
    """Must the digit zones be read with the dear preparation?"""
    return (base6 == "") | (check_digit == "") | (~direct & (votes > 1) & (margin < 0.90))


def needs_square(base6: Column, check_digit: Column, direct: Column, votes: Column, margin: Column) -> Column:
    """Must the squares beside the number be asked for the check digit?"""
    return (base6 != "") & ((check_digit == "") | (~direct & ((votes <= 0) | (margin < 1.00))))


def _gate(rule, pick: str) -> Column:
    return rule(*[F.col(pick)[c] for c in ("base6", "check_digit", "has_direct_full", "check_vote_count", "check_margin")])


def number_of(digit_tokens: DataFrame, side_votes: DataFrame, images: DataFrame, keys: list[str], resize: bool = True) -> DataFrame:
    """(keys, base6, check_digit, score, raw, has_direct_full, ..., vote_count, margin, direct_count, square_count).

    `digit_tokens`: token rows of all zones, with `phase` (0 fast, 1 enlarged, 2 hard), `zone` (its order), `zone_x` (where
    it begins, a share) and `bonus`.  A later phase counts only for images whose reading so far needs it; enlarged zones
    from behind 0.30 do not count where one check digit at most has votes.  Of the side votes the squares are asked, under
    the last gate; readings of a whole zone have no voice here.  `resize` is the setting `enable_resize_digit_pass`.
    """
    at = [*keys, "phase", "zone", "zone_x"]
    found = voting.numeric_candidates(digit_tokens, at, F.col("bonus")).withColumn("ord", F.struct("phase", "zone", "ord"))
    item = F.struct("ord", "phase", "zone_x", "base6", "check_digit", "score", "raw", "direct", "source")
    each = found.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__all"))
    none = F.array().cast(each.schema["__all"].dataType)
    rows = images.join(each, keys, "left").withColumn("__all", F.coalesce("__all", none))
    phase = lambda n: F.filter("__all", lambda x: x["phase"] == n)
    rows = voting.with_pick(rows.withColumn("__c", phase(0)), "__c", "__one")
    narrow = (F.col("__one.check_digit") != "") & (F.col("__one.check_vote_count") <= 1)
    enlarged = F.filter(phase(1), lambda x: ~narrow | (x["zone_x"] <= 0.30))
    rows = voting.with_pick(rows.withColumn("__c", F.when(F.lit(resize) & _gate(needs_resize, "__one"), F.concat("__c", enlarged)).otherwise(F.col("__c"))), "__c", "__two")
    rows = voting.with_pick(rows.withColumn("__c", F.when(_gate(needs_hard, "__two"), F.concat("__c", phase(2))).otherwise(F.col("__c"))), "__c", "__three")
    # one row for each image as it is; the aggregation keeps filters from being pushed below the picks, which would repeat them
    rows = rows.groupBy(*keys).agg(F.first(F.struct("__three", _gate(needs_square, "__three").alias("__ask"), "__c")).alias("__r")).select(*keys, "__r.*").select(*keys, "__three.*", "__ask", "__c")
    every = rows.select(*keys, F.explode_outer("__c").alias("__x")).select(*keys, "__x.*").where("base6 is not null")
    squares = side_votes.where(F.col("source").startswith("square"))
    resolved = voting.resolve_check_digit(rows.select(*keys, "base6"), every, squares, keys)
    counts = ("vote_count", "margin", "direct_count", "square_count")
    resolved = resolved.select(*keys, F.col("check_digit").alias("__digit"), F.col("score").alias("__score"), *counts)
    out = rows.drop("__c").join(resolved, keys, "left").withColumn("__ask", F.col("__ask") & (F.coalesce("__digit", F.lit("")) != ""))
    counts = [F.when(F.col("__ask"), F.col(c)).otherwise(F.lit(0).cast(out.schema[c].dataType)).alias(c) for c in counts]
    digit, score = F.when(F.col("__ask"), F.col("__digit")).otherwise(F.col("check_digit")), F.when(F.col("__ask"), F.greatest("score", "__score")).otherwise(F.col("score"))
    return out.select(*keys, "base6", digit.alias("check_digit"), score.alias("score"), "raw", "has_direct_full", "check_vote_count", "check_margin", *counts)


def longest_text(token_rows: DataFrame, keys: list[str], passes: list[str]) -> DataFrame:
    """(keys, text): the longest of the texts that the passes of each image read, the first of equals."""
    text = tokens.collected(token_rows, [*keys, *passes]).select(*keys, *passes, F.array_join(F.transform("pairs", lambda p: p["text"]), " ").alias("text"))
    return ranking.best(text, keys, F.length("text"), passes).select(*keys, "text")


def code_of_regions(owner_tokens: DataFrame, digit_tokens: DataFrame, side_votes: DataFrame, keys: list[str], resize: bool = True) -> DataFrame:
    """One-line images: owner zone, digit zones and votes from beside the number, to one result row.

    `owner_tokens` are token rows with `phase` and `bonus` (see `owner_of`), `digit_tokens` as `number_of` takes them; without
    these columns all is one fast reading.  The score is that of the owner and of the number together, each 0 at least.
    """
    owner_tokens, digit_tokens = _with_defaults(owner_tokens, phase=0, bonus=0.0), _with_defaults(digit_tokens, phase=0, zone=0, zone_x=0.3, bonus=0.0)
    images = owner_tokens.select(*keys).union(digit_tokens.select(*keys)).distinct()
    owner, number = owner_of(owner_tokens, keys), number_of(digit_tokens, side_votes, images, keys, resize)
    passes = owner_tokens.select(*keys, F.lit(0).alias("part"), "phase", F.lit(0).alias("zone"), "ord", "text", "score").unionByName(digit_tokens.select(*keys, F.lit(1).alias("part"), "phase", "zone", "ord", "text", "score"))
    rows = _named(keys, images, owner, number, longest_text(passes, keys, ["phase", "part", "zone"]))
    full = F.col("owner").isNotNull() & (F.col("base6") != "")
    both = F.concat_ws(" ", F.nullif("owner_raw", F.lit("")), F.nullif("raw", F.lit("")))
    score = F.greatest(F.coalesce("owner_score", F.lit(0.0)), F.lit(0.0)) + F.greatest(F.col("score"), F.lit(0.0))
    raw = F.coalesce(F.nullif(both, F.lit("")), "text", F.lit(""))
    return routing.shape_full(rows.select(*keys, raw.alias("raw_text"), F.when(full, F.concat("owner", "base6")).otherwise("").alias("base10"), F.when(full, F.col("check_digit")).otherwise("").alias("check_digit"), score.alias("score"), "vote_count", "margin", "direct_count", "square_count", "has_direct_full"))


def code_of_any(token_rows: DataFrame, keys: list[str], side_votes: DataFrame | None = None, variant: str = "variant", stage: str | None = None, images: DataFrame | None = None) -> DataFrame:
    """Generic fallback over variants (prepared images), by one score: the best of each variant, then of all variants.

    In a variant full codes have 0.8 of the text's score and 0.2 of their quality, bases 0.02 less; a variant without
    either has half its best token score.  Variants of a later `stage` count only while nothing before gave a base.  If there
    is a base, the digit with most side votes replaces the check digit.  Validity is that of the code as it was read.
    With `images`, all of them have a row: NOT_FOUND where nothing was read.
    """
    token_rows = token_rows.withColumn("__stage", F.col(stage) if stage else F.lit(0))
    own = [*keys, "__stage", variant]
    pairs = tokens.collected(token_rows, own)
    groups = pairs.select(*own, F.posexplode(tokens.candidate_groups("pairs")).alias("grp", "g")).select(*own, "grp", "g.raw", "g.score")
    full = groups.select(*own, "grp", "raw", "score", F.posexplode(codes.code_windows("raw")).alias("win", "code"))
    full = full.select(*own, "grp", F.lit(0).alias("kind"), "win", "code", (0.8 * F.col("score") + 0.2 * codes.code_quality("code")).alias("final"))
    base = groups.select(*own, "grp", "raw", "score", F.posexplode(codes.base_windows("raw")).alias("win", "code"))
    base = base.select(*own, "grp", F.lit(1).alias("kind"), "win", "code", (0.8 * F.col("score") + 0.2 * codes.base_quality("code") - 0.02).alias("final"))
    local = ranking.best(full.unionByName(base), own, "final", ["grp", "kind", "win"]).select(*own, "code", "final")
    text = pairs.select(*own, F.array_join(F.transform("pairs", lambda p: p["text"]), " ").alias("raw_text"), (0.5 * F.array_max(F.transform("pairs", lambda p: p["score"]))).alias("half"))
    each = text.join(local, own, "left").select(*own, "raw_text", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("final", "half").alias("final"))
    so_far = Window.partitionBy(*keys).orderBy("__stage").rangeBetween(Window.unboundedPreceding, 0)
    order = F.struct(F.col("final").alias("f"), (-F.row_number().over(Window.partitionBy(*keys).orderBy("__stage", variant))).alias("o"))
    each = each.withColumn("__order", order).withColumn("__best", F.max_by(F.struct("raw_text", "code", "final"), "__order").over(so_far))
    stops = F.when(F.col("__best.code") != "", F.col("__stage")).otherwise(F.lit(1 << 30))
    last = each.withColumn("__stop", stops)
    rows = ranking.best(last, keys, F.lit(0), ["__stop", F.col("__stage").desc()]).select(*keys, "__best.*")
    rows = rows.join(voting.right_check_vote(side_votes, keys), keys, "left") if side_votes is not None else rows.withColumn("digit", F.lit(None).cast("string")).withColumn("vote", F.lit(None).cast("double"))
    beside = (F.col("code") != "") & F.col("digit").isNotNull()
    rows = rows if images is None else images.select(*keys).join(rows, keys, "left").withColumns({"raw_text": F.coalesce("raw_text", F.lit("")), "code": F.coalesce("code", F.lit(""))})
    out = routing.shape_full(rows.select(*keys, "raw_text", "code", F.substring("code", 1, 10).alias("base10"), F.when(beside, F.col("digit")).otherwise(F.substring("code", 11, 1)).alias("check_digit"), F.when(beside, F.greatest("final", "vote")).otherwise(F.col("final")).alias("score")))
    return out.withColumn("is_valid_iso", codes.is_valid("code")).drop("code")


def seal_of(token_rows: DataFrame, keys: list[str], images: DataFrame | None = None) -> DataFrame:
    """Seal number: best token of each angle, then the best angle; later stages of angles count only while needed.

    With `images`, all of them have a row: an empty text of score -1 where nothing was read.
    """
    own = [*keys, "stage", "angle"]
    rows = tokens.best_text(token_rows, own, seal_quality("text")).select(*own, "text", F.col("final").alias("score"), F.col("angle").alias("ord"))
    found = routing.eager_best(rows, keys).select(*keys, "text", "score")
    if images is None:
        return found
    return images.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(-1.0)).alias("score"))
