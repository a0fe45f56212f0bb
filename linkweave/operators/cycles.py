"""Fundamental cycles of the breadth-first spanning forest, and bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.graph import Graph
from linkweave.operators.traversal import paths_up, search, spanning_forest
from linkweave.plans.scratch import Scratch


def non_tree_edges(g: Graph, forest: DataFrame) -> DataFrame:
    """Edges (src, dst) that are no parent-child pair of the forest, with their root."""
    tree = forest.filter("parent IS NOT NULL").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))
    roots = forest.select(F.col("id").alias("src"), "root")
    return g.edges.join(tree, ["src", "dst"], "left_anti").join(roots, "src").select("src", "dst", "root")


def cycle_basis(g: Graph, roots: DataFrame | None = None) -> DataFrame:
    """(root, u, v, cycle) for each non-tree edge (u < v): the ids from u over the lowest common ancestor to v.

    ``roots`` (column id) restricts the basis to the trees searched from there;
    without it every component is searched from its smallest id.
    """
    spark = g.edges.sparkSession
    scratch = Scratch(spark, "cycles")
    if roots is None:
        forest = spanning_forest(g)
    else:
        forest = search(g, roots).select(F.col("source").alias("root"), "id", F.col("dist").alias("depth"), "parent")
    extra = scratch.write(non_tree_edges(g, forest).withColumn("edge", F.monotonically_increasing_id()), "extra")
    ends = extra.select((F.col("edge") * 2).alias("key"), F.col("root").alias("source"), F.col("src").alias("id")).union(extra.select(F.col("edge") * 2 + 1, "root", "dst"))
    tree = forest.select(F.col("root").alias("source"), "id", "parent")
    ways = scratch.write(paths_up(tree, ends), "ways")
    up = ways.select(F.shiftright("key", 1).alias("edge"), (F.col("key") % 2).alias("end"), "path")
    a = up.filter("end = 0").select("edge", F.col("path").alias("pu"))
    b = up.filter("end = 1").select("edge", F.col("path").alias("pv"))
    both = extra.join(a, "edge").join(b, "edge")
    # Paths from the root share a beginning; its last vertex is the common ancestor.
    same = F.size(F.filter(F.arrays_zip("pu", "pv"), lambda z: z["pu"] == z["pv"]))
    rest = lambda c: F.slice(c, F.col("same") + 1, F.size(c))
    cycle = F.concat(F.reverse(rest("pu")), F.slice("pu", F.col("same"), 1), rest("pv"))
    return both.withColumn("same", same).select("root", F.col("src").alias("u"), F.col("dst").alias("v"), cycle.alias("cycle"))


def cycle_rank(g: Graph) -> DataFrame:
    """(comp, rank): edges - vertices + 1 of each component with an edge."""
    from linkweave.operators.components import component_labels

    own = component_labels(g.edges.sparkSession, g.edges)
    n = own.groupBy("comp").agg(F.count("*").alias("n"))
    m = g.edges.join(own.withColumnRenamed("id", "src"), "src").groupBy("comp").agg(F.count("*").alias("m"))
    return n.join(m, "comp").select("comp", (F.col("m") - F.col("n") + 1).alias("rank"))


def bridges(g: Graph) -> DataFrame:
    """(src, dst) of edges whose deletion splits their component: those on no fundamental cycle."""
    cycles = cycle_basis(g)
    closed = F.concat("cycle", F.slice("cycle", 1, 1))
    steps = F.transform(F.sequence(F.lit(1), F.size("cycle")), lambda i: F.struct(F.element_at(closed, i).alias("a"), F.element_at(closed, i + 1).alias("b")))
    on = cycles.select(F.explode(steps).alias("e")).select(F.least("e.a", "e.b").alias("src"), F.greatest("e.a", "e.b").alias("dst")).distinct()
    return g.edges.join(on, ["src", "dst"], "left_anti").select("src", "dst")
