"""Undirected simple graphs as tables.

``edges(src, dst)`` holds each edge once with src < dst; ``vertices(id)`` is the
fixed vertex set.  DataFrames are immutable, so a copy of a graph is the graph,
and replacing its edges gives a new one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(pairs: DataFrame, u: str = "src", v: str = "dst") -> DataFrame:
    """Distinct edges with src < dst; self-loops and null ends are left out."""
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    return pairs.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).filter("src < dst AND src IS NOT NULL").distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    return edges.select("src", "dst").union(edges.select("dst", "src"))


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def empty(spark: SparkSession, n: int) -> Graph:
        """``n`` isolated vertices 0 .. n-1."""
        if n <= 0:
            raise ValueError("a graph has at least one vertex")
        return Graph(spark.range(n), spark.createDataFrame([], "src long, dst long"))

    @staticmethod
    def from_edges(vertices: DataFrame, pairs: DataFrame, u: str = "src", v: str = "dst", strict: bool = False) -> Graph:
        """Edges between known vertices; duplicates collapse.

        With ``strict``, a self-loop or an unknown end is an error when the
        edges are read; else such pairs are left out.
        """
        ids = vertices.select("id")
        if strict:
            a, b = F.col(u), F.col(v)
            known = pairs.join(ids.select(F.col("id").alias("__a")), a == F.col("__a"), "left").join(ids.select(F.col("id").alias("__b")), b == F.col("__b"), "left")
            good = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (a != b)
            checked = known.select(a.alias("src"), F.when(good, b).otherwise(F.raise_error(F.concat(F.lit("no edge between vertices: "), a.cast("string"), F.lit(", "), b.cast("string")))).alias("dst"))
            return Graph(ids, canonical(checked))
        edges = canonical(pairs, u, v)
        return Graph(ids, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))

    @staticmethod
    def from_adjacency(lists: DataFrame) -> Graph:
        """Rows (id, neighbors array); made symmetric, each id is a vertex."""
        pairs = lists.select(F.col("id").alias("src"), F.explode("neighbors").alias("dst"))
        return Graph.from_edges(lists.select("id"), pairs)

    @staticmethod
    def from_csr(rows: DataFrame, neighbors: DataFrame) -> Graph:
        """``rows(id, degree)`` in id order and ``neighbors(pos, neighbor)``, both counted from 0."""
        from linkweave.sources.formats import csr_pairs

        return Graph.from_edges(rows.select("id"), csr_pairs(rows, neighbors))

    def with_edges(self, pairs: DataFrame) -> Graph:
        return Graph.from_edges(self.vertices, pairs)

    def with_adjacency(self, lists: DataFrame) -> Graph:
        """The edges of rows (id, neighbors), of which there is one for each vertex."""
        n, found, known = self.vertices.count(), lists.count(), lists.select("id").distinct().join(self.vertices, "id", "left_semi").count()
        if not n == found == known:
            raise ValueError(f"{found} lists of {known} known vertices for {n} vertices")
        return Graph.from_edges(self.vertices, lists.select(F.col("id").alias("src"), F.explode("neighbors").alias("dst")))

    def without_edges(self) -> Graph:
        return Graph(self.vertices, self.edges.limit(0))

    def adjacency(self) -> DataFrame:
        """(id, neighbors sorted) of vertices with edges."""
        return symmetric(self.edges).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbors"))

    def isolate(self, ids: DataFrame) -> Graph:
        """All edges at the given vertices (column id) go."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(self.vertices, edges.select("src", "dst"))
