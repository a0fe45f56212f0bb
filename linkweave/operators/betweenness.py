"""Betweenness of candidate vertices over given (terminal, root) pairs.

Two meanings, each under its own name: ``grouped`` counts the pairs for which a
candidate lies on any shortest path; ``pairwise`` those for which it lies on
the one path that the smallest-parent rule picks.  A pair whose root is the
super root stands for the terminal with every base town in ``pairwise`` and for
nothing in ``grouped``.  Pairs that aren't connected count for no candidate.
``auto`` picks by size: grouped if roots and candidates are fewer than the
terminal pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.components import component_labels
from linkweave.operators.graph import Graph
from linkweave.operators.traversal import GROUP_EDGES, NONE, Arrays, search, split
from linkweave.plans.scratch import Scratch

#: What a row asks of its component: a pair, a terminal with the super root, or a base town.
PAIR, SUPER, TOWN = 0, 1, 2


def _all(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Every candidate with its count, 0 where there is none."""
    ids = candidates.select(F.col("id").alias("candidate")).distinct()
    return ids.join(found, "candidate", "left").select("candidate", F.coalesce("n", F.lit(0)).alias("betweenness"))


def grouped(g: Graph, candidates: DataFrame, terminals: DataFrame, super_root: int | None = None) -> DataFrame:
    """(candidate, betweenness): pairs (terminal, root) with d(root, terminal) = d(root, c) + d(c, terminal)."""
    pairs = terminals.select("terminal", "root").distinct()
    if super_root is not None:
        pairs = pairs.filter(F.col("root") != super_root)
    # Distances from the candidates serve both sides, as the graph has no directions.
    far = search(g, candidates.select("id")).select(F.col("source").alias("c"), "id", "dist")
    direct = search(g, pairs.select(F.col("root").alias("id"))).select(F.col("source").alias("root"), F.col("id").alias("terminal"), F.col("dist").alias("drt"))
    known = pairs.join(direct, ["root", "terminal"])
    near = known.join(far.select("c", F.col("id").alias("root"), F.col("dist").alias("drc")), "root")
    on = near.join(far.select("c", F.col("id").alias("terminal"), F.col("dist").alias("dct")), ["c", "terminal"]).filter("drt = drc + dct")
    return _all(candidates, on.groupBy(F.col("c").alias("candidate")).agg(F.count("*").alias("n")))


def _count_group(edges: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """(candidate, n): how many of the chosen paths of a group's pairs hold each vertex.

    A search's tree is summed from its deepest level up, so no path is listed.
    """
    if not len(edges):
        return pd.DataFrame({"candidate": [], "n": []}).astype("int64")
    g = Arrays(edges["src"].to_numpy(), edges["dst"].to_numpy())
    comp, kind = asked["comp"].to_numpy(), asked["kind"].to_numpy()
    town, everywhere = np.zeros(len(g.ids), int), np.zeros(len(g.ids), bool)
    town[np.searchsorted(g.ids, asked["root"].to_numpy()[kind == TOWN])] = 1
    everywhere[np.searchsorted(g.ids, asked["terminal"].to_numpy()[kind == SUPER])] = True
    # One terminal of each component in a sweep.
    starts = np.searchsorted(g.ids, asked["terminal"].to_numpy()[kind != TOWN])
    sources = pd.DataFrame({"comp": comp[kind != TOWN], "start": starts}).drop_duplicates().sort_values(["comp", "start"])
    sources["sweep"] = sources.groupby("comp").cumcount()
    sweep = np.full(len(g.ids), -1)
    sweep[sources["start"].to_numpy()] = sources["sweep"].to_numpy()
    roots = np.searchsorted(g.ids, asked["root"].to_numpy()[kind == PAIR])
    turn = sweep[np.searchsorted(g.ids, asked["terminal"].to_numpy()[kind == PAIR])]
    order = np.argsort(turn, kind="stable")
    roots, turn = roots[order], turn[order]
    total = np.zeros(len(g.ids), int)
    for k, one in sources.groupby("sweep"):
        dist, parent, origin = g.search(one["start"].to_numpy())
        hit = np.flatnonzero(dist >= 0)
        n = np.zeros(len(g.ids), int)
        n[hit] = town[hit] * everywhere[origin[hit]]
        np.add.at(n, roots[np.searchsorted(turn, k) : np.searchsorted(turn, k + 1)], 1)
        hit = hit[np.argsort(dist[hit], kind="stable")]
        ends = np.searchsorted(dist[hit], np.arange(1, dist.max() + 2))
        for level in range(len(ends) - 2, -1, -1):
            at = hit[ends[level] : ends[level + 1]]
            np.add.at(n, parent[at], n[at])
        total += n
    return pd.DataFrame({"candidate": g.ids[total > 0], "n": total[total > 0]})


def _count_levels(g: Graph, pairs: DataFrame, group_edges: int, scratch: Scratch) -> DataFrame:
    """(candidate, n) for connected pairs (terminal, root, n) of large components, each level of the trees a join."""
    tree = search(g, pairs.select(F.col("terminal").alias("id")), group_edges)
    ends = pairs.groupBy(F.col("terminal").alias("source"), F.col("root").alias("id")).agg(F.sum("n").alias("n"))
    ends = scratch.write(ends.join(tree.select("source", "id", "dist"), ["source", "id"]), "ends")
    below, out = ends.limit(0).select("source", "id", "n"), ends.limit(0).select(F.col("id").alias("candidate"), "n")
    for level in range(ends.agg(F.max("dist")).first()[0] or 0, -1, -1):
        here = ends.filter(F.col("dist") == level).select("source", "id", "n").unionByName(below).groupBy("source", "id").agg(F.sum("n").alias("n"))
        here = scratch.write(here, "here")
        out = out.unionByName(scratch.write(here.groupBy(F.col("id").alias("candidate")).agg(F.sum("n").alias("n")), "counts"))
        up = tree.filter(F.col("dist") == level).select("source", "id", "parent")
        scratch.drop(below)
        below = scratch.write(here.join(up, ["source", "id"]).groupBy("source", F.col("parent").alias("id")).agg(F.sum("n").alias("n")), "below")
        scratch.drop(here)
        if level % 32 == 0:
            out = scratch.write(out.groupBy("candidate").agg(F.sum("n").alias("n")), "counted")
    return out


def pairwise(g: Graph, candidates: DataFrame, terminals: DataFrame, base_towns: DataFrame | None = None, super_root: int | None = None, group_edges: int = GROUP_EDGES) -> DataFrame:
    """(candidate, betweenness): pairs whose chosen shortest path holds the candidate, ends included.

    Only pairs within a component are looked at.  A component of at most
    ``group_edges`` edges gets its terminals and base towns as lists, not as
    pairs, and its trees are summed in the task that searches.
    """
    spark = g.edges.sparkSession
    scratch = Scratch(spark, "pairwise")
    own = component_labels(spark, g.edges, scratch=scratch)
    pairs = terminals.select("terminal", "root").distinct().join(g.vertices.select(F.col("id").alias("terminal")), "terminal", "left_semi")
    pairs = scratch.write(pairs.join(own.withColumnRenamed("id", "terminal"), "terminal", "left"), "pairs")
    plain = pairs if super_root is None else pairs.filter(F.col("root") != super_root)
    one = F.lit(1).cast("long").alias("n")
    # A vertex without edges is connected with itself only.
    alone = plain.filter("comp IS NULL AND terminal = root").select(F.col("terminal").alias("candidate"), one)
    asked = plain.join(own.withColumnRenamed("id", "root"), ["root", "comp"]).select("comp", "terminal", "root", F.lit(PAIR).alias("kind"))
    if super_root is not None and base_towns is not None:
        special = pairs.filter(F.col("root") == super_root).select("terminal", "comp")
        towns = base_towns.select(F.col("id").alias("root")).distinct()
        alone = alone.union(special.filter("comp IS NULL").join(towns.withColumnRenamed("root", "terminal"), "terminal", "left_semi").select("terminal", one))
        towns = towns.join(own.withColumnRenamed("id", "root"), "root")
        none = F.lit(NONE).cast("long")
        asked = asked.union(special.join(towns, "comp", "left_semi").select("comp", "terminal", none, F.lit(SUPER)))
        asked = asked.union(towns.join(special, "comp", "left_semi").select("comp", none, "root", F.lit(TOWN)))
    asked = scratch.write(asked, "asked")
    edges, large, group = split(g, own, asked.select("comp").distinct(), group_edges, scratch)
    left = edges.join(large, "comp", "left_anti").select("src", "dst", group).groupBy("group")
    right = asked.join(large, "comp", "left_anti").select("comp", "terminal", "root", "kind", group).groupBy("group")
    found = left.cogroup(right).applyInPandas(_count_group, "candidate long, n long").unionByName(alone)
    if not large.isEmpty():
        rest = scratch.write(asked.join(large, "comp", "left_semi"), "rest")
        towns = rest.filter(F.col("kind") == TOWN).select("comp", "root")
        each = rest.filter(F.col("kind") == PAIR).select("terminal", "root", one)
        each = each.union(rest.filter(F.col("kind") == SUPER).select("comp", "terminal").join(towns, "comp").select("terminal", "root", one))
        found = found.unionByName(_count_levels(Graph(g.vertices, edges.join(large, "comp", "left_semi").select("src", "dst")), each, group_edges, scratch))
    return _all(candidates, found.groupBy("candidate").agg(F.sum("n").alias("n")))


def subset_betweenness(g: Graph, candidates: DataFrame, terminals: DataFrame, base_towns: DataFrame | None = None, super_root: int | None = None, mode: str = "grouped") -> DataFrame:
    """Either meaning by name, or ``auto``."""
    if mode == "auto":
        n = terminals.distinct().count()
        mode = "grouped" if terminals.select("root").distinct().count() + candidates.distinct().count() < n else "pairwise"
    if mode == "grouped":
        return grouped(g, candidates, terminals, super_root)
    if mode == "pairwise":
        return pairwise(g, candidates, terminals, base_towns, super_root)
    raise ValueError(f"unknown mode {mode!r}")
