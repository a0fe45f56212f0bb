"""Per-vertex projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.graph import Graph, symmetric


def degrees(g: Graph) -> DataFrame:
    """(id, degree) of every vertex, isolated ones included."""
    count = symmetric(g.edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return g.vertices.join(count, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def active(g: Graph) -> DataFrame:
    """Vertices that have an edge."""
    return symmetric(g.edges).select(F.col("src").alias("id")).distinct().join(g.vertices, "id", "left_semi")


def isolated(g: Graph) -> DataFrame:
    """Vertices that have none."""
    return g.vertices.join(symmetric(g.edges).select(F.col("src").alias("id")), "id", "left_anti")


def neighbors(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, neighbor) of the asked ids."""
    return symmetric(g.edges).join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))


def retain_active(g: Graph, asked: DataFrame) -> DataFrame:
    """Rows of ``asked(pos, id)`` with an active id; positions and repeats stay."""
    return asked.join(symmetric(g.edges).select(F.col("src").alias("id")), "id", "left_semi").select(*asked.columns)
