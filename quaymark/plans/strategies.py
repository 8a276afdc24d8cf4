"""Reading strategies for codes on two lines, on split doors and below each other, over token tables.

Each reading of an image is rows of one table: (keys, part, grp, pass, ord, text, score).  `part` names the region or the
strip of symbols, `grp` the way in which its symbols were found (-1: the region as it is), `pass` how the picture was
prepared (0 plain, 1 light, 2 strong).  A step of a strategy reads one part with some of the passes and a bonus;
steps, groups and attempts are values of columns, never loops over images.  A fallback is one more reading of the whole
table, whose answer counts for the images that the reading before it left open.  Each reading is computed and kept by
itself (`sources.scratch`): the plan of all together outgrows a driver's memory.

Further tables: `groups` (keys, part, grp, n, height, width) has the number of symbols found and the size of their
strip, `symbols` (keys, part, grp, i, digit, score) what each of them was read as, from left to right ('' if nothing),
`votes` (keys, ord, digit, score, source) readings of a check digit from beside the number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import codes
from quaymark.functions.text import clean
from quaymark.operators import ranking, routing, tokens, voting
from quaymark.sources.scratch import keep

#: Passes that a profile takes, and the bonus of each pass.
PROFILES = {"minimal": 1, "light": 2, "full": 3}
PASS_BONUS = (0.03, 0.04, 0.02)

REGION = -1  # `grp` of a region that is read as it is

_some = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != ""
_text = lambda *cols: F.concat_ws(" ", *[F.nullif(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit("")) for c in cols])


def in_steps(rows: DataFrame, steps: list[tuple]) -> DataFrame:
    """Token rows with `step` and `bonus`, one for each step (number, condition, profile, bonus) that reads them.

    The score gains the step's and the pass's bonus, up to 1; `ord` counts through the passes.
    """
    step = lambda n, where, profile, bonus: F.when(where & (F.col("pass") < PROFILES[profile]), F.struct((n if isinstance(n, Column) else F.lit(n)).cast("int").alias("step"), F.lit(float(bonus)).alias("bonus")))
    rows = rows.withColumn("__s", F.explode(F.array(*[step(*s) for s in steps]))).where("__s is not null")
    score = F.least(F.lit(1.0), F.col("score") + (F.col("__s.bonus") + F.element_at(F.array(*map(F.lit, PASS_BONUS)), F.col("pass") + 1)))
    return rows.withColumn("score", score).withColumn("ord", (F.col("pass") * (1 << 20) + F.col("ord")).cast("int")).select("*", "__s.step", "__s.bonus").drop("__s", "pass")


def _of(rows: DataFrame, *parts: str) -> DataFrame:
    """The rows of some parts; taken before rows are joined, so that a step sorts and keeps its own rows only."""
    return rows.where(F.col("part").isin(*parts))


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the steps that found something the first."""
    return ranking.best(rows, keys, F.lit(0), ["step"])


def _joined_text(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return tokens.collected(rows, keys).select(*keys, F.array_join(F.transform("pairs", lambda p: p["text"]), " ").alias(name))


def _result(rows: DataFrame, keys: list[str], check_of_incomplete: Column | None = None) -> DataFrame:
    """Rows (keys, owner, owner_score, base6, check_digit, number_score, raw_text) as replies: a code needs both of its halves."""
    full = _some("owner") & _some("base6")
    score = F.greatest(F.coalesce("owner_score", F.lit(0.0)), F.lit(0.0)) + F.greatest(F.coalesce("number_score", F.lit(0.0)), F.lit(0.0))
    check = F.when(full, F.coalesce("check_digit", F.lit(""))).otherwise(F.lit("") if check_of_incomplete is None else F.coalesce(check_of_incomplete, F.lit("")))
    return routing.shape_full(rows.select(*keys, "raw_text", F.when(full, F.concat("owner", "base6")).otherwise("").alias("base10"), check.alias("check_digit"), F.when(full, score).otherwise(-1.0).alias("score")))


def _not_found(images: DataFrame, keys: list[str]) -> DataFrame:
    return routing.shape_full(images.select(*keys, *[F.lit("").alias(c) for c in ("raw_text", "base10", "check_digit")], F.lit(-1.0).alias("score")))


def _prefer(first: DataFrame, second: DataFrame, keys: list[str], take_second: Column) -> DataFrame:
    """Replies of `first`, or of `second` where it has the image and `take_second` (over `a` and `b`, the two replies) holds."""
    as_one = lambda df, name: df.select(*keys, F.struct(*[c for c in first.columns if c not in keys]).alias(name))
    both = as_one(first, "a").join(as_one(second, "b"), keys, "left")
    return both.select(*keys, F.when(F.col("b").isNotNull() & take_second, F.col("b")).otherwise(F.col("a")).alias("r")).select(*keys, "r.*")


# Symbols below each other.


def vertical_attempts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, attempt, ord, effort, n): what is tried for each image, in order, from the parts (keys, attempt, i, height, width).

    10 to 12 segments are read with full effort; 8, 9, 13 or 14 with light effort, then a grid of eleven; otherwise the
    grid of eleven, and a grid of ten if that calls for it.  Parts of the same sizes as in an earlier attempt are not read again.
    """
    each = parts.groupBy(*keys, "attempt").agg(F.count("*").cast("int").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "height", "width"))), lambda p: F.struct(p["height"], p["width"])).alias("shape"))
    image = Window.partitionBy(*keys)
    many = F.coalesce(F.max(F.when(F.col("attempt") == "segments", F.col("n"))).over(image), F.lit(0))
    of = lambda name: F.col("attempt") == name
    each = each.withColumn("many", many).withColumn("has_grid", F.max(of("grid11")).over(image)).withColumn("ord", F.when(of("segments"), 0).when(of("grid11"), 1).otherwise(2))
    clear, near = F.col("many").between(10, 12), F.col("many").between(8, 14)
    effort = F.when(of("segments") & clear, "full").when(of("segments") & near, "light").when(of("grid11") & ~clear, "light").when(of("grid10") & ~near & F.col("has_grid"), "light")
    each = each.withColumn("effort", effort).where("effort is not null")
    again = F.row_number().over(Window.partitionBy(*keys, "shape").orderBy("ord"))
    return each.withColumn("again", again).where("again = 1").select(*keys, "attempt", "ord", "effort", "n")


def code_of_vertical(token_rows: DataFrame, parts: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Codes of images whose symbols stand below each other: attempts in order up to the first valid code, else the best by rank.

    Token rows have `attempt` beside `part`: letters, digits7 (with the check digit), digits6, check.  The check digit's
    own strip is asked only where there are eleven parts and the number came without one.
    """
    own = [*keys, "attempt"]
    plan = vertical_attempts(parts, keys)
    read = plan.where("n >= 10").select(*own, "effort", "n")
    part, full, boxed = (lambda name: F.col("part") == name), F.col("effort") == "full", F.col("n") >= 11
    steps = lambda names, *taken: in_steps(_of(token_rows, *names).join(read, own), [*taken])
    letters = steps(["letters"], (0, part("letters"), "light", 0.02), (1, part("letters") & full, "full", 0.01))
    digits = steps(["digits7", "digits6"], (10, part("digits7"), "light", 0.08), (11, part("digits6") & ~boxed, "light", 0.02), (12, part("digits6") & full, "full", 0.0))
    owner = _first(tokens.best_owner(letters, [*own, "step"]), own).select(*own, F.col("code").alias("owner"), F.col("final").alias("owner_score"), F.col("raw").alias("r1"))
    number = _first(tokens.best_number(digits, [*own, "step"]), own).select(*own, "base6", F.col("check_digit").alias("read"), F.col("final").alias("s2"), F.col("raw").alias("r2"))
    last = tokens.best_digit(steps(["check"], (20, boxed, "minimal", 0.0)), own).select(*own, "digit", F.col("final").alias("s3"))
    each = plan.join(owner, own, "left").join(number, own, "left").join(last, own, "left")
    asked = (F.col("read") == "") & F.col("digit").isNotNull()
    each = each.withColumn("check_digit", F.when(asked, F.col("digit")).otherwise(F.col("read"))).withColumn("number_score", F.when(asked, F.greatest("s2", "s3")).otherwise(F.col("s2")))
    tried = _result(each.withColumn("raw_text", _text("r1", "r2")), own).join(plan.select(*own, "ord"), own)
    ten = F.max(F.when(F.col("attempt") == "grid11", routing.needs_retry(F.col("base10"), F.col("raw_text")))).over(Window.partitionBy(*keys))
    tried = tried.withColumn("__ten", ten).where((F.col("attempt") != "grid10") | F.col("__ten")).drop("__ten")
    valid = (F.col("base10") != "") & F.col("is_valid_iso")
    tried = ranking.first_valid_stop(tried, keys, "ord", valid)
    rank = routing.result_rank(F.col("score"), F.col("raw_text"), F.col("base10"), F.col("status"), F.col("is_valid_iso"))
    chosen = ranking.best(tried.withColumn("__rank_of", F.when(valid, F.lit(float("inf"))).otherwise(rank)), keys, "__rank_of", ["ord"]).drop("__rank_of", "ord", "attempt")
    return _prefer(_not_found(images, keys), chosen, keys, F.lit(True))


# Doors that a seam splits: the owner at the upper left, four digits at the lower left, two and the check digit at the right.


def _sequences(symbols: DataFrame, groups: DataFrame, keys: list[str], part: str, size: int) -> DataFrame:
    """(keys, grp, text, score) of the first `size` symbols where there are so many and all were read."""
    own = [*keys, "grp"]
    enough = groups.where((F.col("part") == part) & (F.col("n") >= size)).select(*own)
    rows = symbols.where((F.col("part") == part) & (F.col("i") < size)).join(enough, own, "left_semi").withColumnRenamed("i", "ord")
    return tokens.mean_sequence(rows, own).where("text <> ''")


def _longest_run(runs: Column, least: int) -> Column:
    """The first of the longest runs of at least so many digits; null if there is none."""
    return F.array_max(F.transform(F.filter(runs, lambda r: F.length(r) >= least), lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("at"), r.alias("run"))))["run"]


def door_standard(token_rows: DataFrame, symbols: DataFrame, groups: DataFrame, votes: DataFrame, doors: DataFrame, keys: list[str]) -> DataFrame:
    """First reading of a split door; a reading that lacks a half is repaired from its own raw text.

    Digits come from single symbols (group 0), where enough were found and all read, else from runs in the region's
    text.  For the repair the whole raw text is one token of score 0.35 for the owner, and all its digits in a row are the number.
    """
    zero = F.col("grp") == 0
    part = lambda name, region: (F.col("part") == name) & (F.col("grp") == (REGION if region else 0))
    four = groups.where((F.col("part") == "owner") & zero & (F.col("n") >= 4)).select(*keys, F.lit(True).alias("__four"))
    owners = in_steps(_of(token_rows, "owner").where(F.col("grp") <= 0).join(four, keys, "left"), [(0, part("owner", True), "light", 0.03), (1, part("owner", True), "minimal", 0.01), (2, part("owner", False) & F.col("__four"), "minimal", 0.05)])
    text = lambda name, out: _joined_text(in_steps(token_rows.where(part(name, True)), [(0, F.lit(True), "minimal", 0.03)]), keys, out)
    owner = ranking.best(tokens.best_owner(owners, [*keys, "step"]), keys, "final", ["step"]).select(*keys, F.col("code").alias("owner"), F.col("final").alias("owner_score"), F.col("raw").alias("owner_raw"))
    owner = keep(owner, "door_owner")
    sym, three = symbols.where(zero), groups.where(zero & (F.col("part") == "right") & (F.col("n") >= 3))
    left = _sequences(sym, groups, keys, "left", 4).select(*keys, F.col("text").alias("l_seq"), F.col("score").alias("l_score"))
    of_three = _sequences(sym, groups, keys, "right", 3)
    of_two = _sequences(sym, groups, keys, "right", 2).join(three.select(*keys), keys, "left_anti")
    right = of_three.unionByName(of_two).select(*keys, F.col("text").alias("r_seq"), F.col("score").alias("r_score"))
    vote = voting.right_check_vote(votes, keys)
    out = doors.select(*keys)
    for table in (owner, left, text("left", "l_text"), right, text("right", "r_text"), vote):
        out = out.join(table, keys, "left")
    l_runs, r_run = F.filter(codes.digit_runs("l_text"), lambda r: F.length(r) >= 4), _longest_run(codes.digit_runs("r_text"), 2)
    tail = F.coalesce("r_seq", F.substring(r_run, 1, 3))
    out = out.withColumn("quad", F.coalesce("l_seq", F.substring(F.try_element_at(l_runs, F.lit(1)), 1, 4), F.lit(""))).withColumn("tail", F.coalesce(tail, F.lit("")))
    out = out.withColumn("number_raw", _text("l_seq", F.when(F.col("l_seq").isNull(), F.col("l_text")), "r_seq", F.when(F.col("r_seq").isNull(), F.col("r_text"))))
    out = out.withColumn("own_check", F.substring("tail", 3, 1)).withColumn("check_digit", F.coalesce(F.nullif("own_check", F.lit("")), "digit", F.lit("")))
    none = F.lit(-1.0)
    out = out.withColumn("number_score", F.greatest(none, F.coalesce("l_score", none), F.coalesce("r_score", none), F.coalesce(F.when(F.col("own_check") == "", F.col("vote")), none)))
    out = out.withColumn("base6", F.when((F.length("quad") >= 4) & (F.length("tail") >= 2), F.concat("quad", F.substring("tail", 1, 2))).otherwise("")).withColumn("raw_text", _text("owner_raw", "number_raw"))
    # the repair
    lacking = (F.col("raw_text") != "") & ~(_some("owner") & _some("base6"))
    size_bonus = F.when(F.length(clean("raw_text")) == 4, 0.03).otherwise(0.0)
    again = F.array_max(F.transform(codes.owner_candidates("raw_text"), lambda c, i: F.struct((0.35 + c["bonus"] + size_bonus).alias("final"), (-i).alias("at"), c["code"].alias("code"))))
    out = out.withColumn("__lacking", lacking).withColumn("__again", again).withColumn("__digits", F.regexp_replace(codes.as_digits(clean("number_raw")), "[^0-9]", ""))
    better = F.col("__lacking") & (F.col("__again.final") > F.coalesce("owner_score", none))
    six, seven = F.col("__lacking") & (F.length("__digits") >= 6) & ~_some("base6"), F.col("__lacking") & (F.length("__digits") >= 7) & ~_some("check_digit")
    out = out.select(
        *keys, "raw_text", F.when(better, F.col("__again.code")).otherwise(F.col("owner")).alias("owner"), F.when(better, F.col("__again.final")).otherwise(F.col("owner_score")).alias("owner_score"), "number_score",
        F.when(six, F.substring("__digits", 1, 6)).otherwise(F.col("base6")).alias("base6"), F.when(seven, F.substring("__digits", 7, 1)).otherwise(F.col("check_digit")).alias("check_digit"),
    )
    return _result(out, keys, F.col("check_digit"))


#: Bonus of the profiles, in order, for strips of symbols and for regions.
_HARD = (("minimal", 0, 0.05, 0.01), ("light", 1, 0.08, 0.03), ("full", 2, 0.09, 0.04))
_HARD_OWNER = (("minimal", 0, 0.04, 0.01), ("light", 1, 0.07, 0.03), ("full", 2, 0.09, 0.04))


def _hard_steps(part: str, profiles: tuple, strip: Column) -> list[tuple]:
    """Strips group by group, each with all profiles, then the region; `strip` says which groups have one."""
    at, here = F.col("grp") * 10 + 5, F.col("part") == part
    return [(at + k, here & (F.col("grp") > 0) & strip, p, bonus) for p, k, bonus, _ in profiles] + [(1_000_000 + k, here & (F.col("grp") == REGION), p, bonus) for p, k, _, bonus in profiles]


def _first_seen(candidates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each value once, as it was first read: later readings do not count, however good."""
    return ranking.best(candidates, [*keys, value], F.lit(0), ["ord"])


def door_hard(token_rows: DataFrame, symbols: DataFrame, groups: DataFrame, votes: DataFrame, doors: DataFrame, keys: list[str]) -> DataFrame:
    """Second reading of a split door: symbols found in several ways (groups 1, 2, ...) and regions, with every profile.

    Blocks of four at the left and tails of two or three digits at the right are gathered over all passes, each value as it
    was first seen; every block goes with every tail, and the best pair is the number.  Strips of equal size are read once.
    """
    own = [*keys, "part", "grp"]
    shaped = groups.where((F.col("part") == "owner") & (F.col("grp") > 0) & (F.col("n") >= 3) & F.col("height").isNotNull())
    shaped = ranking.best(shaped, [*keys, "height", "width", F.least("n", F.lit(4))], F.lit(0), ["grp"])
    sided = groups.where((F.col("grp") > 0) & (((F.col("part") == "left") & (F.col("n") >= 4)) | ((F.col("part") == "right") & (F.col("n") >= 2))))
    strips = shaped.select(*own).unionByName(sided.select(*own)).withColumn("__strip", F.lit(True))
    def rows(part: str, profiles: tuple) -> DataFrame:
        found = _of(token_rows, part).where(F.col("grp") != 0).join(_of(strips, part), own, "left").withColumn("__strip", F.coalesce("__strip", F.lit(False)))
        return in_steps(found, _hard_steps(part, profiles, F.col("__strip")))

    owner = ranking.best(tokens.best_owner(rows("owner", _HARD_OWNER), [*keys, "step"]), keys, "final", ["step"]).select(*keys, F.col("code").alias("owner"), F.col("final").alias("owner_score"), F.col("raw").alias("owner_raw"))
    owner = keep(owner, "door_hard_owner")
    read = symbols.where(F.col("grp") > 0)
    at = lambda step, grp=0, i=0: F.struct(step.cast("int").alias("step"), F.struct(F.lit(grp).cast("int").alias("grp"), F.lit(i).cast("int").alias("i")).alias("ord"))

    def chunks(part: str, shortest: int, longest: int, short: bool) -> DataFrame:
        found = tokens.digit_chunks(rows(part, _HARD), [*keys, "step"], shortest, longest, short_final=short)
        score = F.col("score") + F.when(F.col("step") < 1_000_000, 0.05).otherwise(0.0)
        return found.select(*keys, F.struct("step", F.struct(F.col("ord.grp").cast("int").alias("grp"), F.col("ord.i").cast("int").alias("i")).alias("ord")).alias("ord"), "chunk", score.alias("score"), "raw")

    def sequences(part: str, size: int, place: int, bonus: float) -> DataFrame:
        found = _sequences(read, groups, keys, part, size)
        return found.select(*keys, at(F.col("grp") * 10 + place).alias("ord"), F.col("text").alias("chunk"), (F.col("score") + bonus).alias("score"), F.col("text").alias("raw"))

    left = keep(_first_seen(sequences("left", 4, 0, 0.10).unionByName(chunks("left", 4, 4, False)), keys, "chunk"), "door_hard_left")
    tails = sequences("right", 3, 0, 0.11).unionByName(sequences("right", 2, 1, 0.05)).unionByName(chunks("right", 2, 3, True))
    tails = keep(_first_seen(tails, keys, "chunk"), "door_hard_tails")
    number = voting.quads_and_tails(left, tails, keys).withColumnsRenamed({"score": "number_score", "raw": "number_raw"})
    vote = voting.right_check_vote(votes, keys).select(*keys, F.col("digit").alias("square"), (F.col("vote")).alias("square_score"))
    out = doors.select(*keys).join(owner, keys, "left").join(number, keys, "left").join(vote, keys, "left")
    missing = F.col("base6").isNull()
    out = out.withColumn("number_raw", F.when(missing, F.col("square")).otherwise(F.col("number_raw"))).withColumn("raw_text", _text("owner_raw", "number_raw"))
    out = out.withColumn("check_digit", F.when(missing, F.col("square")).otherwise(F.col("check_digit"))).withColumn("number_score", F.when(missing, F.col("square_score")).otherwise(F.col("number_score")))
    return _result(out, keys, F.col("check_digit"))


def code_of_split_door(token_rows: DataFrame, symbols: DataFrame, groups: DataFrame, votes: DataFrame, images: DataFrame, keys: list[str], hard: bool = True) -> DataFrame:
    """Codes of split doors; `images` has `split`: whether a seam was found.  The hard reading counts only where the first left no code.

    It replaces the first where it has a code, or a raw text where the first had none.  (Its passes are dear, so a recogniser
    makes their tokens for these images alone; tokens of others change nothing.)
    """
    doors = images.where("split")
    first = keep(door_standard(token_rows, symbols, groups, votes, doors, keys), "door_standard")
    if hard:
        second = keep(door_hard(token_rows, symbols, groups, votes, doors, keys), "door_hard")
        first = _prefer(first, second, keys, (F.col("a.base10") == "") & ((F.col("b.base10") != "") | ((F.col("b.raw_text") != "") & (F.col("a.raw_text") == ""))))
    return _prefer(_not_found(images, keys), first, keys, F.lit(True))


# Two lines.


def code_of_two_lines(token_rows: DataFrame, bottom_votes: DataFrame, door: tuple[DataFrame, DataFrame, DataFrame, DataFrame], images: DataFrame, keys: list[str], hard: bool = True) -> DataFrame:
    """Codes of images with two text bands; whole images are handed on to the split-door reading where that fails.

    `images` has `bands` (whether two bands were found) and `split`.  Token rows: part top (the owner), digits7, digits6 and
    bottom (the number, three readings that vote together), check (the check digit alone).  `door`: token rows, symbols, groups
    and votes for the fallback, which answers if it has a code or a raw text, and always for images without two bands.
    """
    part = lambda name: F.col("part") == name
    banded = images.where("bands").select(*keys)
    rows = token_rows.join(banded, keys, "left_semi")
    owner = tokens.best_owner(in_steps(_of(rows, "top"), [(0, part("top"), "light", 0.03)]), keys).select(*keys, F.col("code").alias("owner"), F.col("final").alias("owner_score"), F.col("raw").alias("owner_raw"))
    numeric = in_steps(_of(rows, "digits7", "digits6", "bottom"), [(10, part("digits7"), "light", 0.06), (11, part("digits6"), "light", 0.04), (12, part("bottom"), "minimal", 0.02)])
    found = voting.numeric_candidates(numeric.select(*keys, "step", "bonus", "ord", "text", "score"), [*keys, "step", "bonus"], F.col("bonus"))
    found = keep(found.withColumn("ord", F.struct("step", "ord")), "two_lines_numbers")
    number = voting.pick_number(found, keys).select(*keys, "base6", F.col("check_digit").alias("read"), F.col("score").alias("s"), F.col("raw").alias("number_raw"))
    texts = _joined_text(numeric, [*keys, "step"], "all_text")
    texts = ranking.best(texts, keys, F.length("all_text"), ["step"]).select(*keys, "all_text")
    alone = tokens.best_digit(in_steps(_of(rows, "check"), [(20, part("check"), "full", 0.0)]), keys).select(*keys, F.col("digit").alias("d1"), F.col("final").alias("f1"))
    beside = voting.right_check_vote(bottom_votes, keys).select(*keys, F.col("digit").alias("d2"), F.col("vote").alias("f2"))
    out = banded
    for table in (owner, number, texts, alone, beside):
        out = out.join(table, keys, "left")
    asked = F.col("base6").isNotNull() & (F.col("read") == "") & F.coalesce("d1", "d2").isNotNull()
    longer = F.length(F.coalesce("number_raw", F.lit(""))) > F.length(F.coalesce("all_text", F.lit("")))
    out = out.withColumn("raw_text", _text("owner_raw", F.when(longer, F.col("number_raw")).otherwise(F.col("all_text"))))
    out = out.withColumn("check_digit", F.when(asked, F.coalesce("d1", "d2")).otherwise(F.col("read"))).withColumn("number_score", F.when(asked, F.greatest("s", F.when(F.col("d1").isNotNull(), F.col("f1")).otherwise(F.col("f2")))).otherwise(F.col("s")))
    first = keep(_prefer(_not_found(images, keys), _result(out, keys), keys, F.lit(True)), "two_lines")
    second = code_of_split_door(*door, images, keys, hard)
    return _prefer(first, second, keys, (F.col("a.base10") == "") & ((F.col("b.base10") != "") | (F.col("b.raw_text") != "")))


# All layouts.

#: What the replies of all strategies have.
REPLY = ("raw_text", "base10", "check_digit", "score", "full_code", "status", "is_valid_iso", "reason")


def code_by_layout(images: DataFrame, one_line: DataFrame, two_lines: DataFrame, upright: DataFrame, generic: DataFrame, keys: list[str]) -> DataFrame:
    """One reply for each image (keys, layout, width, height): the first of the strategies for its layout and shape that found something, else the generic one.

    An image for which no strategy has a row is not found.  `strategy` names the one that answered.
    """
    out = images
    for name, replies in (("oneline", one_line), ("twolines", two_lines), ("vertical", upright), ("generic", generic)):
        out = out.join(replies.select(*keys, F.struct(*REPLY, F.lit(name).alias("strategy")).alias(name)), keys, "left")
    found = routing.route(F.col("layout"), routing.is_horizontal(F.col("width"), F.col("height")), routing.is_vertical(F.col("width"), F.col("height")), *map(F.col, ("oneline", "twolines", "vertical", "generic")))
    chosen = out.select(*keys, found.alias("r")).where("r is not null").select(*keys, "r.*")
    return _prefer(_not_found(images, keys).select(*keys, *REPLY).withColumn("strategy", F.lit("none")), chosen, keys, F.lit(True))
