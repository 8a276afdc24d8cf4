"""Which report files may go: those of no recent run and older than the cut-off."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.sources.settings import cast_like


@dataclass(frozen=True)
class Retention:
    """Days a report is kept at least (1 or more), newest runs whose reports stay (0 or more), whether old ones go by themselves."""

    max_age_days: int = 30
    keep_last_runs: int = 100
    enabled: bool = True

    @classmethod
    def of(cls, env: dict, stored: dict) -> Retention:
        """Environment over stored settings (nested or by dotted name) over defaults; what is no number is passed over.  Names are fixed values."""
        env_name, name = "ADMIN_UI_REPORTS_CLEANUP_", "testing.reports_cleanup."
        inner = stored.get("testing") if isinstance(stored.get("testing"), dict) else {}
        inner = inner.get("reports_cleanup") if isinstance(inner.get("reports_cleanup"), dict) else {}

        def given(key: str):
            return [v for v in (env.get(env_name + key.upper()), inner.get(key, stored.get(name + key))) if v not in (None, "")]

        def number(key: str, default: int, least: int) -> int:
            for v in given(key):
                try:
                    return max(least, int(v))
                except (TypeError, ValueError):
                    continue
            return default

        flag = given("enabled")
        enabled = cast_like(flag[0], cls.enabled) if flag else cls.enabled
        return cls(number("max_age_days", cls.max_age_days, 1), number("keep_last_runs", cls.keep_last_runs, 0), enabled)


def run_id_of(name: Column | str) -> Column:
    """The run a report file belongs to; null for other names."""
    return F.regexp_extract(F.col(name) if isinstance(name, str) else name, r"^run_(\d+)\.html$", 1).try_cast("long")


def recent_runs(runs: DataFrame, rule: Retention) -> DataFrame:
    """(run_id) of the newest runs, whose reports stay."""
    return runs.select(F.col("id").alias("run_id")).orderBy(F.col("run_id").desc()).limit(rule.keep_last_runs)


def delete_set(files: DataFrame, runs: DataFrame, now: Column, rule: Retention, mode: str = "policy") -> DataFrame:
    """Files (name, run_id, mtime) to remove; a file without a run id is never protected by a run.  Mode all takes every file."""
    if mode == "all":
        return files
    old = F.col("mtime") < now - F.make_dt_interval(F.lit(rule.max_age_days))
    return files.join(recent_runs(runs, rule), "run_id", "left_anti").where(old)


def skipped(rule: Retention, mode: str, reason: str) -> bool:
    """Automatic removal by policy does nothing while it is turned off; by hand it works all the same."""
    return mode == "policy" and not rule.enabled and reason != "manual"
