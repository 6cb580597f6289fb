"""Statistics of a workload and a harness that times queries one by one."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order_stats import percentiles


def match_stats(counts: DataFrame) -> DataFrame:
    """One row over queries with a match: n, mean, min, p50, max of ``matches``."""
    return percentiles(counts.where("matches > 0"), "matches", (50,)).select("n", "mean", "min", "p50", "max")


def floor_percentiles(counts: DataFrame, value: str = "matches") -> DataFrame:
    """One row: p50, p90, p95, p99 by rank."""
    return percentiles(counts, value).select("p50", "p90", "p95", "p99")


def run_log(counts: DataFrame) -> DataFrame:
    """(query_ord, qid, matches) of the queries with a match, as a verbose run lists them."""
    return counts.where("matches > 0").select("query_ord", "qid", "matches")


def order_statistic(values: list[float], p: int) -> float | None:
    """sorted[floor(p * n / 100)], None for no values."""
    return sorted(values)[min(len(values) - 1, p * len(values) // 100)] if values else None


def timed(queries: Iterable, ask: Callable[[object], int], told: Callable[[object, float, int], None] | None = None) -> dict:
    """Run ``ask`` for each query; latencies in microseconds of those with a match, each of which ``told`` hears of."""
    spent, matched, asked = [], [], 0
    for q in queries:
        began = time.perf_counter()
        n = ask(q)
        took, asked = (time.perf_counter() - began) * 1e6, asked + 1
        if n > 0:
            spent.append(took)
            matched.append(n)
            if told:
                told(q, took, n)
    mean = lambda x: sum(x) / len(x) if x else None
    return {"queries": asked, "matched": len(matched), "latency_us": {"mean": mean(spent), **{f"p{p}": order_statistic(spent, p) for p in (50, 90, 95, 99)}}, "matches": {"mean": mean(matched), "min": min(matched, default=None), "p50": order_statistic(matched, 50), "max": max(matched, default=None)}}


def materialise(df: DataFrame) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


def with_totals(df: DataFrame, name: str):
    """The frame with counters that fill while it runs: documents, postings, words. Returns (frame, observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("documents"), F.sum("n_postings").alias("postings"), F.sum("length").alias("words")), seen
