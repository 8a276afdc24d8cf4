"""Recognised tokens: parsing, candidate groups and the best reading of a token list.

A token row is (image_id, ord, text, score); further key columns may stand in for image_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions import codes
from quaymark.functions.text import clean
from quaymark.operators.ranking import best

RESULT_SCHEMA = "res struct<rec_texts:array<string>,rec_scores:array<string>>"


def tokens_of_json(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """Token rows of recogniser results: both layouts, cleaned texts, empty ones dropped, bad scores 0, order kept.

    New layout: {"res": {"rec_texts": [...], "rec_scores": [...]}}; old layout: [[[box, [text, score]], ...]].
    Malformed bodies give no tokens.
    """
    new = F.from_json(body, RESULT_SCHEMA)["res"]
    n = F.least(F.size(new["rec_texts"]), F.size(new["rec_scores"]))
    zipped = F.transform(F.slice(new["rec_texts"], 1, F.greatest(n, F.lit(0))), lambda t, i: F.struct(t.alias("text"), F.try_element_at(new["rec_scores"], i + 1).alias("score")))
    lines = F.from_json(F.when(F.trim(body).startswith("["), F.concat(F.lit('{"p":'), F.col(body), F.lit("}"))), "p array<array<array<string>>>")["p"]
    old = F.transform(F.flatten(lines), lambda x: F.from_json(F.concat(F.lit('{"q":'), F.try_element_at(x, F.lit(2)), F.lit("}")), "q array<string>")["q"])
    old = F.transform(old, lambda q: F.struct(F.try_element_at(q, F.lit(1)).alias("text"), F.try_element_at(q, F.lit(2)).alias("score")))
    rows = df.select(*keys, F.posexplode(F.coalesce(zipped, old)).alias("ord", "t"))
    rows = rows.select(*keys, "ord", clean("t.text").alias("text"), F.coalesce(F.col("t.score").try_cast("double"), F.lit(0.0)).alias("score"))
    return rows.where("text <> ''")


def zipped_passes(rows: DataFrame, keys: list[str], readings: str, bonuses: tuple[float, ...]) -> DataFrame:
    """(keys, ord, text, score) from one array of (text, score) for each key, a reading for each prepared picture of a batch.

    Readings stand beside the bonus of their pass by position, as far as both lists reach; passes without text give no
    token, and a score with its bonus is 1 at most.
    """
    both = F.zip_with(F.slice(readings, 1, len(bonuses)), F.array(*map(F.lit, bonuses)), lambda r, b: F.struct(r["text"].alias("text"), F.least(F.lit(1.0), r["score"] + b).alias("score")))
    found = rows.select(*keys, F.posexplode(both).alias("ord", "t")).select(*keys, "ord", "t.text", "t.score")
    return found.where("text <> '' and score is not null")


def collected(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key with the ordered token array `pairs`."""
    return tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "text", "score"))).alias("pairs"))


def candidate_groups(pairs: Column | str, longest: int = 6) -> Column:
    """array<struct<raw, score>>: singles, all joined without and with spaces, then windows of 2 to `longest` tokens, by mean score.

    Of equal (raw, score to 6 places) the first stays; empty texts are dropped.
    """
    joined = lambda part, sep: F.struct(F.array_join(F.transform(part, lambda x: x["text"]), sep).alias("raw"), (F.aggregate(part, F.lit(0.0), lambda a, x: a + x["score"]) / F.size(part)).alias("score"))

    alone = lambda p: F.transform(p, lambda x: F.struct(x["text"].alias("raw"), x["score"].alias("score")))
    with_text = lambda every: F.filter(every, lambda g: g["raw"] != "")

    def groups(p: Column) -> Column:
        sizes = F.when(F.size(p) >= 2, F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(longest), F.size(p))))).otherwise(F.array().cast("array<int>"))
        windows = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p) - n + 1)), lambda i: joined(F.slice(p, i, n), ""))))
        return with_text(F.concat(alone(p), F.array(joined(p, ""), joined(p, " ")), windows))

    def distinct(every: Column) -> Column:
        # each list is computed once: inside a lambda it would be computed again for each of its elements
        keys = F.transform(every, lambda g: F.struct(g["raw"], F.round(g["score"], 6)))
        return codes.let(keys, lambda seen: F.filter(every, lambda g, i: F.array_position(seen, F.struct(g["raw"], F.round(g["score"], 6))) == i + 1))

    p = F.col(pairs) if isinstance(pairs, str) else pairs
    found = codes.let(p, lambda p: codes.let(groups(p), distinct))
    return F.when(F.size(p) == 1, with_text(alone(p))).when(F.size(p) > 1, found).otherwise(F.array().cast("array<struct<raw:string,score:double>>"))


def _groups(tokens: DataFrame, keys: list[str]) -> DataFrame:
    return collected(tokens, keys).select(*keys, F.posexplode(candidate_groups("pairs")).alias("grp", "g")).select(*keys, "grp", "g.raw", "g.score")


def best_owner(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, final, raw): best owner code over groups; +0.03 where the cleaned group has four characters."""
    rows = _groups(tokens, keys).select(*keys, "grp", "raw", "score", F.posexplode(codes.owner_candidates("raw")).alias("cand", "c"))
    final = F.col("score") + F.col("c.bonus") + F.when(F.length(clean("raw")) == 4, 0.03).otherwise(0.0)
    return best(rows.select(*keys, "grp", "cand", F.col("c.code").alias("code"), final.alias("final"), "raw"), keys, "final", ["grp", "cand"]).drop("grp", "cand")


def best_code(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, final, raw): best full code over groups; 0.75 of the score, 0.25 of the quality, 0.10 for a right check digit."""
    rows = _groups(tokens, keys).select(*keys, "grp", "raw", "score", F.posexplode(codes.code_windows("raw")).alias("win", "code"))
    final = 0.75 * F.col("score") + 0.25 * codes.code_quality("code") + F.when(codes.is_valid("code"), 0.10).otherwise(0.0)
    return best(rows.withColumn("final", final), keys, "final", ["grp", "win"]).select(*keys, "code", "final", "raw")


def best_digit(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, digit, final): best single digit; bonuses for standing alone, last and short, less 0.03 for each further digit."""
    rows = tokens.withColumn("m", codes.as_digits(clean("text"))).withColumn("many", F.length(F.regexp_replace("m", "[^0-9]", "")))
    rows = rows.select(*keys, "ord", "score", "m", "many", F.posexplode(F.split("m", "")).alias("i", "ch")).where(F.col("ch").rlike("^[0-9]$"))
    final = F.col("score") + F.when(F.col("many") == 1, 0.12).otherwise(-0.03 * (F.col("many") - 1)) + F.when(F.col("i") == F.length("m") - 1, 0.04).otherwise(0.0) + F.when(F.length("m") <= 2, 0.04).otherwise(0.0)
    return best(rows.withColumn("final", final), keys, "final", ["ord", "i"]).select(*keys, F.col("ch").alias("digit"), "final")


def best_letter(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, letter, final): best single letter; bonuses for standing alone, short and at an end, less 0.03 for each further letter."""
    rows = tokens.withColumn("m", codes.as_letters(clean("text"))).withColumn("many", F.length(F.regexp_replace("m", "[^A-Z]", "")))
    rows = rows.select(*keys, "ord", "score", "m", "many", F.posexplode(F.split("m", "")).alias("i", "ch")).where(F.col("ch").rlike("^[A-Z]$"))
    final = F.col("score") + F.when(F.col("many") == 1, 0.12).otherwise(-0.03 * (F.col("many") - 1)) + F.when(F.length("m") <= 2, 0.05).otherwise(0.0) + F.when((F.col("i") == 0) | (F.col("i") == F.length("m") - 1), 0.02).otherwise(0.0)
    return best(rows.withColumn("final", final), keys, "final", ["ord", "i"]).select(*keys, F.col("ch").alias("letter"), "final")


def best_number(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, base6, check_digit, final, raw): best run of digits; 7 or more give a check digit and 0.18, six give 0.08."""
    rows = tokens.select(*keys, "ord", "score", F.posexplode(codes.digit_runs("text")).alias("i", "run")).where(F.length("run") >= 6)
    final = F.col("score") + F.when(F.length("run") >= 7, 0.18).otherwise(0.08)
    rows = rows.withColumn("final", final)
    return best(rows, keys, "final", ["ord", "i"]).select(*keys, F.substring("run", 1, 6).alias("base6"), F.substring("run", 7, 1).alias("check_digit"), "final", F.col("run").alias("raw"))


def digit_chunks(tokens: DataFrame, keys: list[str], min_len: int, max_len: int | None = None, short_final: bool = False) -> DataFrame:
    """(keys, ord, chunk, score, raw): digit runs of the groups, cut to `max_len`; the first of each (chunk, score to 3 places) stays."""
    rows = _groups(tokens, keys).select(*keys, "grp", "raw", "score", F.posexplode(codes.digit_runs("raw")).alias("i", "run"))
    rows = rows.withColumn("chunk", F.col("run") if max_len is None else F.substring("run", 1, max_len)).where(F.length("run") >= min_len)
    if max_len is not None:
        rows = rows.where(F.length("chunk") >= min_len)
        if not short_final:
            rows = rows.where((F.length("chunk") == max_len) | (F.length("run") < max_len))
    rows = rows.withColumn("thousandths", F.bround(F.col("score") * 1000).cast("long")).withColumn("at", F.struct("grp", "i"))
    rows = best(rows, [*keys, "chunk", "thousandths"], F.lit(0), ["at"])
    return rows.select(*keys, F.col("at").alias("ord"), "chunk", "score", "raw")


def best_text(tokens: DataFrame, keys: list[str], quality: Column) -> DataFrame:
    """Best token by 0.8 of its score and 0.2 of its quality; the first of equals."""
    return best(tokens.withColumn("final", 0.8 * F.col("score") + 0.2 * quality), keys, "final", ["ord"])


def mean_sequence(digits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, score): a digit sequence with its mean score, empty and -1 unless every place was read."""
    agg = digits.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "digit"))), lambda x: x["digit"]), "").alias("t"), F.avg(F.greatest("score", F.lit(0.0))).alias("s"), (F.count("*") == F.count(F.nullif("digit", F.lit("")))).alias("full"))
    return agg.select(*keys, F.when(F.col("full"), F.col("t")).otherwise("").alias("text"), F.when(F.col("full"), F.col("s")).otherwise(-1.0).alias("score"))
