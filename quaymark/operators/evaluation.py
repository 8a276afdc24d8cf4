"""Dataset evaluation: items from images, labels, texts and replies; the alert predicate; run summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import codes, text
from quaymark.functions.text import normalise, or_null
from quaymark.operators.ranking import best

#: The parts of a request in the order in which a report stacks them.
REPORT_STAGES = ("read_ms", "decode_ms", "bbox_ms", "ocr_ms", "validation_ms", "postprocess_ms")


def label_of(content: Column | str) -> Column:
    """The first code in a label file, else its whole text normalised, else null."""
    return F.coalesce(codes.first_code(content), or_null(normalise(content)))


def text_of(content: Column | str) -> Column:
    return or_null(normalise(content))


def _parts(path: Column | str) -> Column:
    """The parts of an upload's path, without empty ones."""
    return F.filter(F.split(F.replace(text.col(path), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")


def upload_role(path: Column | str) -> Column:
    """images, labels or text; null for what is none of them.

    An image counts in a folder `images` anywhere on the way or at the top, a note in a folder `labels`, else `text`.
    """
    parts = F.transform(_parts(path), F.lower)
    under = lambda role: F.array_contains(parts, role)
    image, note = text.suffix(path).isin(*text.IMAGE_SUFFIXES), text.suffix(path) == "txt"
    return F.when(image & (under("images") | (F.size(parts) == 1)), "images").when(note & under("labels"), "labels").when(note & under("text"), "text")


def dataset_name(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row: the first part that all paths share, or a fixed name if there are several or none."""
    root = paths.agg(F.min(F.try_element_at(_parts(path), F.lit(1))).alias("a"), F.max(F.try_element_at(_parts(path), F.lit(1))).alias("b"))
    return root.select(F.when(F.col("a") == F.col("b"), F.concat(F.lit("uploaded:"), F.col("a"))).otherwise("uploaded:folder").alias("dataset"))


def match_sidecars(images: DataFrame, notes: DataFrame, value: str, out: str) -> DataFrame:
    """Left join of a note to each image: the file `<stem>.txt` first, else the one with the image's own name.

    Of several notes of one name the least value counts.
    """
    by_txt = notes.where(text.suffix("name") == "txt").groupBy(text.stem("name").alias("__stem")).agg(F.min(value).alias("__a"))
    by_name = notes.groupBy(F.col("name").alias("__name")).agg(F.min(value).alias("__b"))
    rows = images.join(by_txt, text.stem("file_name") == F.col("__stem"), "left").join(by_name, F.col("file_name") == F.col("__name"), "left")
    return rows.withColumn(out, F.coalesce("__a", "__b")).drop("__stem", "__a", "__name", "__b")


def join_labels(images: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """images with label and text by stem; of several uploads for one stem the last holds (`ord` says which)."""
    last = lambda df, v, out: best(df, ["stem"], F.col("ord"), [v]).select("stem", F.col(v).alias(out))
    return images.join(last(labels, "label", "expected_label"), "stem", "left").join(last(texts, "expected_text", "expected_text"), "stem", "left")


def items_of(replies: DataFrame) -> DataFrame:
    """Item columns from replies (status_code, body, body_text, elapsed_ms, transport_error)."""
    ok = F.col("status_code") == 200
    rows = replies.withColumn("predicted_text", F.when(ok, text.result_text("body", "body_text")).otherwise("")).withColumn("raw_text", F.when(ok, text.raw_text("body", "body_text")).otherwise(""))
    rows = rows.withColumn("normalized_predicted", normalise("predicted_text")).withColumn("stage_timings", text.stage_timings("body"))
    return rows.withColumn("error", F.coalesce(F.nullif("transport_error", F.lit("")), request_outcome(F.col("status_code"), F.col("normalized_predicted"), text.failure_reason("body"))))


def request_outcome(status_code: Column, predicted: Column, reason: Column) -> Column:
    """`HTTP <code>` if the reply is not ok; the failure reason if nothing was found; else null."""
    return F.when(status_code != 200, F.concat(F.lit("HTTP "), status_code.cast("string"))).when(predicted.isin("", "NOTFOUND"), F.nullif(reason, F.lit("")))


def predicted_of(normalized: Column, predicted: Column) -> Column:
    """The normalised prediction, or the prediction as it came where that is missing or empty."""
    return F.coalesce(F.nullif(normalized.cast("string"), F.lit("")), predicted.cast("string"))


def is_alert(error: Column, status_code: Column, expected_text: Column, expected_label: Column, predicted: Column) -> Column:
    """An error, a status other than none or 200, or an expected value that the prediction (see `predicted_of`) does not meet."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    expected = normalise(F.coalesce(F.nullif(some(expected_text), F.lit("")), some(expected_label)))
    return (some(error) != "") | ~some(status_code).isin("", "200") | ((expected != "") & (normalise(predicted) != expected))


def is_alert_on_page(error: Column, status_code: Column, expected_text: Column, expected_label: Column, predicted: Column) -> Column:
    """The page's variant: ASCII letters and digits only, and status 0 is no alert."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    expected = text.clean(F.coalesce(F.nullif(some(expected_text), F.lit("")), some(expected_label)))
    return (some(error) != "") | ~some(status_code).isin("", "0", "200") | ((expected != "") & (text.clean(predicted) != expected))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column for each share): exact quantiles with linear interpolation.

    No task holds all values of a key.  Values are counted by ranges (sign and leading bits), running sums over the ranges
    say which of them hold the ranks asked for, and only values of those are ranked, each range by itself.
    """
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull()).select(F.struct(*keys).alias("k"), v.alias("v"))  # a struct joins with its nulls
    scale = F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.signum("v") * (F.log2(F.abs("v")) + 1100))
    rows = rows.withColumn("range", F.floor(scale * 64))
    counts = rows.groupBy("k", "range").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("k").orderBy("range")) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("k")))
    spots = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("all") - 1)).alias("at")) for name, p in shares.items()])
    asked = counts.select("k", "range", "n", "before", F.explode(spots).alias("q"))
    at = F.col("q.at")
    ends = F.array(F.struct(F.floor(at).alias("rank"), (1 - at + F.floor(at)).alias("weight")), F.struct((F.floor(at) + 1).alias("rank"), (at - F.floor(at)).alias("weight")))
    asked = asked.select("k", "range", "before", "n", F.col("q.name").alias("name"), F.explode(ends).alias("e")).where("e.weight > 0 and e.rank >= before and e.rank < before + n")
    asked = asked.select("k", "range", (F.col("e.rank") - F.col("before") + 1).alias("rank"), "name", F.col("e.weight").alias("weight"))
    inside = rows.join(asked.select("k", "range").distinct(), ["k", "range"], "left_semi").groupBy("k", "range", "v").agg(F.count("*").alias("n"))
    inside = inside.withColumn("to", F.sum("n").over(Window.partitionBy("k", "range").orderBy("v")))
    found = asked.join(inside, ["k", "range"]).where("rank <= to and rank > to - n")
    sums = found.groupBy("k").agg(*[F.sum(F.when(F.col("name") == name, F.col("v") * F.col("weight"))).alias(name) for name in shares])
    return sums.select(*[F.col("k")[k].alias(k) for k in keys], *shares)


def run_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, latencies (mean and exact 95th percentile, 3 places) and accuracies (4 places; null without labels) of each run.

    Rounding is half away from zero.
    """
    return _summary(items, keys, {"latency_p95_ms": 0.95}).drop("latency_median_ms")


def _summary(items: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    ok = (F.col("status_code") == 200) & ~some("error")
    ok = F.coalesce(ok, F.lit(False))
    predicted = F.coalesce("normalized_predicted", F.lit(""))
    match = lambda c: some(c) & (predicted != "") & (predicted == normalise(c))
    out = items.groupBy(*keys).agg(
        F.count("*").alias("total_images"), F.count_if(ok).alias("ok_requests"), F.count_if(~ok).alias("failed_requests"), F.count_if(ok & predicted.isin("", "NOTFOUND")).alias("not_found_count"),
        F.round(F.avg("elapsed_ms"), 3).alias("latency_mean_ms"),
        F.count_if(some("expected_label")).alias("label_total"), F.count_if(match("expected_label")).alias("label_matches"), F.count_if(some("expected_text")).alias("text_total"), F.count_if(match("expected_text")).alias("text_matches"),
    )
    times = quantiles(items, keys, "elapsed_ms", shares).select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.round(n, 3).alias(n) for n in shares])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = out.join(times, same, "left").drop(*[f"__{k}" for k in keys])
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 4)
    return out.withColumn("label_accuracy", share("label_matches", "label_total")).withColumn("text_accuracy", share("text_matches", "text_total"))


def short_report(items: DataFrame, keys: list[str]) -> DataFrame:
    """Median and 95th percentile, success, failed, not found and done of each run."""
    s = _summary(items, keys, {"latency_p95_ms": 0.95, "latency_median_ms": 0.5})
    s = s.select(*keys, "latency_p95_ms", "latency_median_ms", F.col("ok_requests").alias("success"), F.col("failed_requests").alias("failed"), F.col("not_found_count").alias("not_found"))
    return s.withColumn("done", F.greatest(F.lit(0), F.col("success") - F.col("not_found")))


def latencies(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean_ms, p95_ms) of a column of times."""
    means = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 3).alias("mean_ms"))
    return means.join(quantiles(rows, keys, value, {"p95_ms": 0.95}).select(*keys, F.round("p95_ms", 3).alias("p95_ms")), keys, "left")


def log_rows(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Report rows: number within the run, seconds of recognition, overhead and total, expected and predicted codes."""
    ms = lambda k: F.coalesce(F.try_element_at("stage_timings", F.lit(k)), F.lit(0.0))
    recognition = ms("bbox_ms") + ms("ocr_ms") + ms("validation_ms") + ms("postprocess_ms")
    elapsed = F.coalesce("elapsed_ms", F.lit(0.0))
    seconds = F.when(recognition > 0, recognition).otherwise(elapsed)
    code = lambda c: F.nullif(codes.embedded_code(normalise(c)), F.lit(""))
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    predicted = predicted_of(F.col("normalized_predicted"), F.col("predicted_text"))
    kind = F.coalesce(F.nullif("number_type", F.lit("")), F.lit("unknown"))
    photo = F.struct(F.col("file_name").alias("file"), kind.alias("type"), one(F.coalesce(code("expected_text"), code("expected_label"))).alias("expected"), one(code(predicted)).alias("predicted"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return items.select(*keys, number.alias("request_id"), (seconds / 1000).alias("recognition_sec"), (F.greatest(F.lit(0.0), elapsed - seconds) / 1000).alias("overhead_sec"), (elapsed / 1000).alias("total_sec"), F.array(photo).alias("photos"))


def stage_stack(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each item and stage with where its bar begins and ends; without any timing all time is in the last stage."""
    ms = [F.coalesce(F.try_element_at("stage_timings", F.lit(k)), F.lit(0.0)) for k in REPORT_STAGES]
    total = sum(ms[1:], ms[0])
    values = [*ms[:-1], F.when(total > 0, ms[-1]).otherwise(F.coalesce("elapsed_ms", F.lit(0.0)))]
    rows = items.select(*keys, F.posexplode(F.array(*[F.struct(F.lit(n).alias("stage"), v.alias("ms")) for n, v in zip(REPORT_STAGES, values, strict=True)])).alias("stage_ord", "s")).select(*keys, "stage_ord", "s.stage", "s.ms")
    w = Window.partitionBy(*keys).orderBy("stage_ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bar_end", F.sum("ms").over(w)).withColumn("bar_start", F.col("bar_end") - F.col("ms"))


def thinned_labels(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Marks which bars keep a label: all up to 40, else every n/25-th."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    i = F.row_number().over(w.orderBy(order)) - 1
    return rows.withColumn("labelled", F.when(n <= 40, True).otherwise(i % F.greatest(F.lit(1), F.floor(n / 25)) == 0))
