"""Container codes (four letters, six digits, a check digit) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaymark.functions.text import clean, col

#: Characters that are taken for each other, position by position.
DIGITS_AS_LETTERS = ("012345678", "OIZBASGZB")
LETTERS_AS_DIGITS = ("OQDUILZSBG", "0000112586")
#: A character's place here is its value in the check sum; multiples of 11 are left out for letters.
VALUES = "0123456789A?BCDEFGHIJK?LMNOPQRSTU?VWXYZ"

_NO_TEXTS = "array<string>"


def as_letters(c: Column) -> Column:
    return F.translate(c, *DIGITS_AS_LETTERS)


def as_digits(c: Column) -> Column:
    return F.translate(c, *LETTERS_AS_DIGITS)


def owner(c: Column) -> Column:
    """Cleaned, in letters; from four characters on the first three and U."""
    mapped = as_letters(clean(c))
    return F.when(F.length(mapped) >= 4, F.concat(F.substring(mapped, 1, 3), F.lit("U"))).otherwise(mapped)


def check_digit(code10: Column | str) -> Column:
    """Sum of value times two to the place, mod 11, where 10 becomes 0; null unless it is four letters and six digits."""
    c = col(code10)
    places = [(F.position(F.substring(c, i + 1, 1), F.lit(VALUES)) - 1) * (1 << i) for i in range(10)]
    total = places[0]
    for p in places[1:]:
        total = total + p
    return F.when(c.rlike("^[A-Z]{4}[0-9]{6}$"), total % 11 % 10)


def is_valid(code11: Column | str) -> Column:
    """Four letters, seven digits, and the last is the check digit of the others."""
    c = clean(code11)
    return F.coalesce(c.rlike("^[A-Z]{4}[0-9]{7}$") & (check_digit(F.substring(c, 1, 10)).cast("string") == F.substring(c, 11, 1)), F.lit(False))


def _window(part: Column, digits: int) -> Column:
    """Owner and digits of a part of 4 + digits characters; null if that makes no code."""
    code = F.concat(owner(F.substring(part, 1, 4)), as_digits(F.substr(part, F.lit(5))))
    return F.when((F.length(part) == 4 + digits) & code.rlike(f"^[A-Z]{{4}}[0-9]{{{digits}}}$"), code)


def _windows(s: Column, size: int) -> Column:
    """All parts of `size` characters, from left to right; none if the text is shorter."""
    starts = F.when(F.length(s) >= size, F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - size + 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(s, i, F.lit(size)))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once for all places at which it is used."""
    return F.transform(F.array(value), use)[0]


def _codes_at_every_place(s: Column, size: int) -> Column:
    """The code at each place of cleaned text, null where there is none: three letters, U, and digits, each character as what it stands for."""

    def codes(x: Column) -> Column:
        starts = F.when(F.length(x["l"]) >= size, F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x["l"]) - size + 1))).otherwise(F.array().cast("array<int>"))
        found = F.transform(starts, lambda i: F.concat(F.substr(x["l"], i, F.lit(3)), F.lit("U"), F.substr(x["d"], i + 4, F.lit(size - 4))))
        return F.filter(found, lambda c: c.rlike(f"^[A-Z]{{4}}[0-9]{{{size - 4}}}$"))

    return let(F.struct(as_letters(s).alias("l"), as_digits(s).alias("d")), codes)


def _distinct(codes: Column) -> Column:
    return F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))


def code_windows(c: Column | str) -> Column:
    """All codes of 11 characters read from windows of the cleaned text, distinct, in order."""
    return F.array_distinct(_codes_at_every_place(clean(c), 11))


def base_windows(c: Column | str) -> Column:
    """Codes of 10 characters: windows, then turned blocks (digits before letters), then each letter block with each digit block."""
    s = clean(c)
    turned = F.transform(F.regexp_extract_all(s, F.lit("([0-9]{6}[A-Z]{4})"), 1), lambda m: _window(F.concat(F.substr(m, F.lit(7)), F.substring(m, 1, 6)), 6))
    letters, digits = F.regexp_extract_all(s, F.lit("([A-Z]{4,})"), 1), F.regexp_extract_all(s, F.lit("([0-9]{6,})"), 1)
    paired = F.flatten(F.transform(letters, lambda a: F.transform(digits, lambda d: _window(F.concat(F.substring(a, 1, 4), F.substring(d, 1, 6)), 6))))
    found = _distinct(F.concat(_codes_at_every_place(s, 10), turned, paired))
    return F.when(F.length(s) >= 10, found).otherwise(F.array().cast(_NO_TEXTS))


def owner_candidates(c: Column | str) -> Column:
    """array<struct<code, bonus>>: whole (0.12), one of five dropped (0.07), windows of four (0.03); the first bonus of a code holds."""
    item = lambda code, bonus: F.struct(F.concat(F.substring(code, 1, 3), F.lit("U")).alias("code"), F.lit(bonus).alias("bonus"))  # noqa: E731  four letters each
    none = F.array().cast("array<struct<code:string,bonus:double>>")

    def candidates(s: Column) -> Column:
        whole = F.when(F.length(s) == 4, F.array(item(s, 0.12))).otherwise(none)
        dropped = F.when(F.length(s) == 5, F.array(*[item(F.concat(F.substring(s, 1, i), F.substring(s, i + 2, 5)), 0.07) for i in range(5)])).otherwise(none)
        return F.concat(whole, dropped, F.transform(_windows(s, 4), lambda w: item(w, 0.03)))

    def distinct(every: Column) -> Column:
        return let(F.transform(every, lambda x: x["code"]), lambda seen: F.filter(every, lambda x, i: F.array_position(seen, x["code"]) == i + 1))

    return let(F.regexp_replace(as_letters(clean(c)), "[^A-Z]", ""), lambda s: let(candidates(s), distinct))


def code_quality(c: Column | str) -> Column:
    """0 unless it is a code; else 0.95, and 1 with a right check digit."""
    s = clean(c)
    return F.when(s.rlike("^[A-Z]{4}[0-9]{7}$"), F.least(F.lit(1.0), 0.95 + F.when(is_valid(s), 0.05).otherwise(0.0))).otherwise(0.0)


def base_quality(c: Column | str) -> Column:
    return F.when(clean(c).rlike("^[A-Z]{4}[0-9]{6}$"), 1.0).otherwise(0.0)


def first_code(c: Column | str) -> Column:
    """The first code in upper-case text, with no word character beside it; null if there is none."""
    return F.nullif(F.regexp_extract(F.upper(F.coalesce(col(c), F.lit(""))), r"\b([A-Z]{4}[0-9]{7})\b", 1), F.lit(""))


def embedded_code(c: Column) -> Column:
    """The first code anywhere in already normalised text, or empty."""
    return F.regexp_extract(c, "[A-Z]{4}[0-9]{7}", 0)


def digit_runs(c: Column | str) -> Column:
    """Runs of digits in the cleaned text with look-alike letters read as digits."""
    return F.regexp_extract_all(as_digits(clean(c)), F.lit("([0-9]+)"), 1)


def status(code: Column | str, raw: Column | str) -> Column:
    """FULL_11, PARTIAL_10, RAW_ONLY or NOT_FOUND, from lengths alone."""
    n = F.length(F.coalesce(col(code), F.lit("")))
    return F.when(n == 11, "FULL_11").when(n == 10, "PARTIAL_10").when(F.coalesce(col(raw), F.lit("")) != "", "RAW_ONLY").otherwise("NOT_FOUND")
