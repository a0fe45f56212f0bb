"""Generated graphs and workloads for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators.graph import canonical


def ring_edges(spark: SparkSession, n: int) -> DataFrame:
    """(i, src, dst): for i in 0 .. 2n-1 the pair (i mod n, (7 i + 13) mod n), loops left out, repeats kept."""
    return spark.range(2 * n).select(F.col("id").alias("i"), (F.col("id") % n).alias("src"), ((F.col("id") * 7 + 13) % n).alias("dst")).filter("src <> dst")


def caterpillar(spark: SparkSession, n: int, spine_share: float = 0.3, chain: int = 4, chord_share: float = 0.05, seed: int = 42) -> DataFrame:
    """Edges of a spine path with short chains hung on it and a few chords."""
    spine = max(1, int(n * spine_share))
    path = spark.range(max(0, spine - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    place = F.pmod(F.xxhash64(F.floor((F.col("id") - spine) / chain), F.lit(seed)), F.lit(spine))
    rest = spark.range(spine, n).select(F.when((F.col("id") - spine) % chain == 0, place).otherwise(F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    chords = spark.range(int(n * chord_share)).select(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n)).alias("src"), F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(n)).alias("dst"))
    return canonical(path.union(rest).union(chords))


def sample_pairs(vertices: DataFrame, n: int, seed: int = 12345) -> DataFrame:
    """(pair_id, u, v): up to ``n`` pseudo-random pairs of different vertices."""
    shuffled = vertices.select("id", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h", "id").limit(2 * n)
    halves = shuffled.selectExpr("id", "row_number() OVER (ORDER BY h, id) - 1 AS r")
    return halves.groupBy(F.floor(F.col("r") / 2).alias("pair_id")).agg(F.min_by("id", "r").alias("u"), F.max_by("id", "r").alias("v")).filter("u <> v")


def first_deleted(edges: DataFrame, share: float = 0.2, seed: int = 12345) -> DataFrame:
    """The share of edges that come first in a seeded shuffle."""
    return edges.filter(F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1000)) < int(1000 * share))
