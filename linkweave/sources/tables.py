"""Graphs and operation logs derived from the standard tables.

The two sides of a bipartite graph have even and odd ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators.graph import Graph, canonical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_part_edges(spark: SparkSession, sf_dir: str, least: int = 46) -> DataFrame:
    """Orders with the parts they hold in quantity; deep, many components."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= least)
    return canonical(rows.select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")))


def part_supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and suppliers of returned large lines; isolated vertices remain."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 49")
    edges = canonical(rows.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")))
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("id"))
    return Graph(parts.union(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"))).distinct(), edges)


def purchase_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users with the k values of their purchases; dense and shallow."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    k = F.get_json_object("props", "$.k").cast("long")
    edges = canonical(rows.select((F.col("user_id") * 2).alias("src"), (k * 2 + 1).alias("dst")))
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return Graph(ids, edges)


def grouped_purchase_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Purchases within groups of 25 users: many components of moderate size, with cycles."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    k = F.get_json_object("props", "$.k").cast("long")
    first = F.floor(F.col("user_id") / 25) * 1000
    edges = canonical(rows.select((first + F.col("user_id") % 25).alias("src"), (first + 500 + k % 60).alias("dst")))
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return Graph(ids, edges)


def event_ops(spark: SparkSession, sf_dir: str, least: float | None = None) -> DataFrame:
    """ops(seq, op, u, v): errors delete, clicks ask, all else inserts."""
    rows = table(spark, sf_dir, "events")
    if least is not None:
        rows = rows.filter(F.col("value") >= least)
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "query").otherwise("insert")
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.select(F.col("event_id").alias("seq"), op.alias("op"), (F.col("user_id") * 2).alias("u"), (k * 2 + 1).alias("v"))
