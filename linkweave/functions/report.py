"""Latency reports: statistics by operation and code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_report(samples: DataFrame, *keys: str, value: str = "ns") -> DataFrame:
    """count, mean, standard deviation, median, 99th percentile and maximum by keys."""
    x = F.col(value)
    return samples.groupBy(*keys).agg(F.count("*").alias("count"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.percentile(x, F.lit(0.5)).alias("p50"), F.percentile(x, F.lit(0.99)).alias("p99"), F.max(x).alias("max"))
