"""The report of a test run.  Spark aggregates; only the summary row and the bars of one run are rendered here."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions import text
from quaymark.operators import evaluation, retention


def report_parts(items: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame]:
    """(summary, bars) of one run: a row of counts with shares as text, and a row for each item and stage."""
    own = items.where(F.col("run_id") == run_id)
    summary = evaluation.short_report(own, ["run_id"])
    share = F.try_divide(F.col("done").cast("double"), F.col("success") + F.col("failed"))
    summary = summary.select("run_id", "success", "failed", "not_found", "done", text.percent(share).alias("done_share"), text.number("latency_median_ms").alias("median"), text.number("latency_p95_ms").alias("p95"))
    bars = own.select("id", "file_name", "stage_timings", "elapsed_ms")
    return summary, evaluation.stage_stack(bars, ["id", "file_name"]).orderBy("id", "stage_ord")


def render(summary: DataFrame, bars: DataFrame, alerts: DataFrame | None = None) -> str:
    """HTML of one run; its items are as many as one test run has images."""
    s = summary.first()
    head = "".join(f"<tr><th>{escape(k)}</th><td>{escape(str(v))}</td></tr>" for k, v in (s.asDict() if s else {}).items())
    rows = "".join(f"<tr><td>{escape(r['file_name'] or '')}</td><td>{escape(r['stage'])}</td><td>{r['bar_start']:.3f}</td><td>{r['bar_end']:.3f}</td></tr>" for r in bars.toLocalIterator())
    red = "".join(f"<li>{escape(r['file_name'] or '')}</li>" for r in alerts.toLocalIterator()) if alerts is not None else ""
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Test run</title></head><body><table>{head}</table><ul>{red}</ul><table>{rows}</table></body></html>"


def write_once(items: DataFrame, run_id: int, folder: str) -> str:
    """Render the report to `folder`/run_<id>.html unless it is there; through Hadoop's file systems, so any store works."""
    jvm, conf = items.sparkSession.sparkContext._jvm, items.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/run_{run_id}.html")
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        own = items.where(F.col("run_id") == run_id)
        alert = evaluation.is_alert(F.col("error"), F.col("status_code"), F.col("expected_text"), F.col("expected_label"), F.col("normalized_predicted"))
        body = render(*report_parts(items, run_id), own.where(alert).select("file_name"))
        out = fs.create(path, True)
        out.write(bytearray(body.encode()))
        out.close()
    return path.toString()


def remove(files: DataFrame, folder: str, dry_run: bool = True) -> list[str]:
    """Delete the report files named in `files` (see `retention.delete_set`); with `dry_run` only say which."""
    names = sorted(r["name"] for r in files.select("name").toLocalIterator())
    return names if dry_run else [n for n in names if _deleted(files, folder, n)]


def _deleted(files: DataFrame, folder: str, name: str) -> bool:
    context = files.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return bool(path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, False))


def clean_up(files: DataFrame, runs: DataFrame, folder: str, now: Column, rule: retention.Retention, mode: str = "policy", dry_run: bool = False, reason: str = "manual") -> dict:
    """Remove reports and say what was done; the names are sorted, the counts are those of the files before.

    `candidate_count` names what the rule takes, `removed_count` what is gone (or would be, in a dry run).
    """
    said = {"mode": mode, "reason": reason, "dry_run": dry_run, "cleanup_enabled": rule.enabled, "max_age_days": rule.max_age_days, "keep_last_runs": rule.keep_last_runs, "total_files": files.count()}
    if retention.skipped(rule, mode, reason):
        return said | {"removed_count": 0, "removed_files": [], "skipped": "auto cleanup disabled"}
    kept = sorted(r["run_id"] for r in retention.recent_runs(runs, rule).collect()) if mode == "policy" else []  # at most keep_last_runs
    names = remove(retention.delete_set(files, runs, now, rule, mode), folder)
    gone = len(names) if dry_run else sum(_deleted(files, folder, n) for n in names)
    return said | {"candidate_count": len(names), "removed_count": gone, "removed_files": names, "kept_recent_run_ids": kept}
