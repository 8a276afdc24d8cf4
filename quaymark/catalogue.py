"""The registered queries of the recognition-analytics operators and their SQL twins.

The driver tables hold no photos, so each operator runs on a stand-in: codes are made of a fixed owner and
a key, `events.value` stands for a latency, `event_type` for a status, `user_id` for a request or image.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaymark.plans import bench_queries, code_queries, layout_queries, reading_queries, service_queries, strategy_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**bench_queries.QUERIES, **code_queries.QUERIES, **layout_queries.QUERIES, **reading_queries.QUERIES, **strategy_queries.QUERIES, **service_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**bench_queries.SQL, **code_queries.SQL, **layout_queries.SQL, **reading_queries.SQL, **strategy_queries.SQL, **service_queries.SQL}
