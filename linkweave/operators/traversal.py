"""Breadth-first search from many sources, shortest paths, spanning forests.

The rule that makes results unique: a vertex's parent is its smallest neighbour
one step nearer to the source.

Components with at most ``GROUP_EDGES`` edges are packed into groups of about
that size; a group is a sorted adjacency array in one task, and one sweep
searches from one source of each of its components.  Larger components are
searched level by level with joins, the state of each level written to the
shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.operators.components import component_labels
from linkweave.operators.graph import Graph, symmetric
from linkweave.plans.scratch import Scratch

GROUP_EDGES = 200_000
NONE = -(2**63)


class Arrays:
    """Sorted adjacency of a small edge list with arbitrary ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = flat[: len(src)], flat[len(src) :]
        u, v = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((v, u))
        self.to = v[order]
        self.start = np.searchsorted(u[order], np.arange(len(self.ids) + 1))

    def search(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distance, parent, start) by index from starts in different components; -1 where unreached or without parent."""
        dist, parent, origin = (np.full(len(self.ids), -1) for _ in range(3))
        dist[starts], origin[starts], level, front = 0, starts, 0, np.asarray(starts)
        while len(front):
            level += 1
            sizes = self.start[front + 1] - self.start[front]
            at = np.repeat(self.start[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            came, to = np.repeat(front, sizes), self.to[at]
            new = dist[to] < 0
            came, to = came[new], to[new]
            # Smallest parent first, so that the first of each vertex counts.
            order = np.lexsort((came, to))
            front, first = np.unique(to[order], return_index=True)
            dist[front], parent[front] = level, came[order][first]
            origin[front] = origin[parent[front]]
        return dist, parent, origin


def _search_group(edges: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(edges):
        g = Arrays(edges["src"].to_numpy(), edges["dst"].to_numpy())
        sources = sources.drop_duplicates().sort_values(["comp", "source"])
        for _, one in sources.groupby(sources.groupby("comp").cumcount()):
            dist, parent, origin = g.search(np.searchsorted(g.ids, one["source"].to_numpy()))
            hit = dist >= 0
            up = np.where(parent[hit] >= 0, g.ids[parent[hit]], NONE)
            out.append(pd.DataFrame({"source": g.ids[origin[hit]], "id": g.ids[hit], "dist": dist[hit], "parent": up}))
    if not out:
        return pd.DataFrame({"source": [], "id": [], "dist": [], "parent": []}).astype("int64")
    return pd.concat(out)


def _search_levels(edges: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    both = scratch.write(symmetric(edges), "both")
    front = scratch.write(sources.select("source", F.col("source").alias("id"), F.lit(0).cast("long").alias("dist"), F.lit(None).cast("long").alias("parent")).distinct(), "front")
    seen, level = front, 0
    while not front.isEmpty():
        level += 1
        step = front.select("source", F.col("id").alias("src")).join(both, "src").groupBy("source", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        # Neighbours of a level lie on the one before, on it, or beyond it.
        near = seen.filter(F.col("dist") >= level - 2).select("source", "id")
        front = step.join(near, ["source", "id"], "left_anti").select("source", "id", F.lit(level).cast("long").alias("dist"), "parent")
        front = scratch.write(front, "front")
        seen = seen.unionByName(front)
        if level % 32 == 0:
            seen = scratch.write(seen, "seen")
    return seen


def split(g: Graph, own: DataFrame, wanted: DataFrame, group_edges: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, Column]:
    """Edges (src, dst, comp) of the wanted components, the large ones among these, and the group of each other one."""
    edges = g.edges.join(own.withColumnRenamed("id", "src"), "src").join(wanted, "comp", "left_semi")
    edges = scratch.write(edges.select("src", "dst", "comp"), "edges")
    sizes = edges.groupBy("comp").agg(F.count("*").alias("m"))
    large = scratch.write(sizes.filter(F.col("m") > group_edges).select("comp"), "large")
    groups = max(1, -(-edges.count() // max(1, group_edges)))
    return edges, large, F.pmod(F.xxhash64("comp"), F.lit(groups)).alias("group")


def search(g: Graph, sources: DataFrame, group_edges: int = GROUP_EDGES) -> DataFrame:
    """(source, id, dist, parent) of everything reached from the sources (column id).

    A source without edges reaches itself; unknown sources give no rows.
    """
    spark = g.edges.sparkSession
    scratch = Scratch(spark, "search")
    asked = sources.select("id").distinct().join(g.vertices, "id", "left_semi")
    own = component_labels(spark, g.edges, scratch=scratch)
    placed = scratch.write(asked.join(own, "id", "left").select(F.col("id").alias("source"), "comp"), "sources")
    edges, large, group = split(g, own, placed.select("comp").dropna().distinct(), group_edges, scratch)
    left = edges.join(large, "comp", "left_anti").select("src", "dst", group).groupBy("group")
    right = placed.dropna().join(large, "comp", "left_anti").select("source", "comp", group).groupBy("group")
    found = left.cogroup(right).applyInPandas(_search_group, "source long, id long, dist long, parent long").withColumn("parent", F.when(F.col("parent") != NONE, F.col("parent")))
    if not large.isEmpty():
        more = _search_levels(edges.join(large, "comp", "left_semi").select("src", "dst"), placed.join(large, "comp", "left_semi").select("source"), scratch)
        found = found.unionByName(more)
    alone = placed.filter("comp IS NULL").select("source", F.col("source").alias("id"), F.lit(0).cast("long").alias("dist"), F.lit(None).cast("long").alias("parent"))
    return scratch.write(found.unionByName(alone), "found")


def climb(tree: DataFrame, starts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, step, id): from each start (key, source, id) up the parents of ``tree`` to the source."""
    rows = scratch.write(starts.select("key", "source", "id", F.lit(0).cast("long").alias("step")), "climb")
    out, step = rows, 0
    up = tree.select("source", "id", "parent")
    while not rows.isEmpty():
        step += 1
        rows = rows.join(up, ["source", "id"]).filter("parent IS NOT NULL").select("key", "source", F.col("parent").alias("id"), F.lit(step).cast("long").alias("step"))
        rows = scratch.write(rows, "climb")
        out = out.unionByName(rows)
        if step % 32 == 0:
            out = scratch.write(out, "climbed")
    return out.select("key", "step", "id")


def _paths_group(tree: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    up = dict(zip(zip(tree["source"], tree["id"], strict=True), tree["up"], strict=True))
    out = []
    for key, s, t in zip(ends["key"], ends["source"], ends["id"], strict=True):
        path = [t] if (s, t) in up else []
        while path and up[s, path[-1]] != NONE:
            path.append(up[s, path[-1]])
        out.append((key, path[::-1] if path else None))
    return pd.DataFrame(out, columns=["key", "path"])


def paths_up(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """(key, path from the source to the end) for ``ends(key, source, id)`` in a search's result.

    A task holds searches of about ``GROUP_EDGES`` vertices in all; a single
    search of more vertices climbs by joins.
    """
    scratch = Scratch(tree.sparkSession, "paths")
    ends = scratch.write(ends.select("key", "source", "id"), "ends")
    sizes = tree.groupBy("source").agg(F.count("*").alias("n"))
    large = scratch.write(sizes.filter(F.col("n") > GROUP_EDGES).select("source"), "large")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    group = F.pmod(F.xxhash64("source"), F.lit(max(1, -(-total // max(1, GROUP_EDGES))))).alias("group")
    small = tree.join(large, "source", "left_anti").select(group, "source", "id", F.coalesce("parent", F.lit(NONE)).alias("up"))
    right = ends.join(large, "source", "left_anti").select(group, "key", "source", "id")
    out = small.groupBy("group").cogroup(right.groupBy("group")).applyInPandas(_paths_group, "key long, path array<long>")
    if not large.isEmpty():
        steps = climb(tree.join(large, "source", "left_semi"), ends.join(large, "source", "left_semi").join(tree.select("source", "id"), ["source", "id"], "left_semi"), scratch)
        way = steps.groupBy("key").agg(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("step", "id")))), lambda x: x["id"]).alias("path"))
        out = out.unionByName(ends.join(large, "source", "left_semi").select("key").join(way, "key", "left"))
    return out


def shortest_paths(g: Graph, pairs: DataFrame) -> DataFrame:
    """``pairs(pair_id, u, v)`` with ``path`` (both ends included) and its ``length`` in edges.

    Null where v can't be reached or an end is unknown; [u] where u = v.
    """
    tree = search(g, pairs.select(F.col("u").alias("id")))
    found = paths_up(tree, pairs.select(F.col("pair_id").alias("key"), F.col("u").alias("source"), F.col("v").alias("id")))
    out = pairs.join(found.withColumnRenamed("key", "pair_id"), "pair_id", "left")
    return out.select("pair_id", "u", "v", (F.size("path") - 1).cast("long").alias("length"), "path").withColumn("length", F.when(F.col("path").isNotNull(), F.col("length")))


def spanning_forest(g: Graph) -> DataFrame:
    """(root, id, depth, parent): breadth-first trees from the smallest id of each component with an edge."""
    roots = component_labels(g.edges.sparkSession, g.edges).select(F.col("comp").alias("id")).distinct()
    tree = search(g, roots)
    return tree.select(F.col("source").alias("root"), "id", F.col("dist").alias("depth"), "parent")


def subtree_sizes(forest: DataFrame) -> DataFrame:
    """(root, id, size) of a spanning forest: how many vertices stand at or below each one."""
    scratch = Scratch(forest.sparkSession, "subtrees")
    tree = scratch.write(forest.select(F.col("root").alias("source"), "id", "parent"), "tree")
    ways = paths_up(tree, tree.select(F.xxhash64("source", "id").alias("key"), "source", "id"))
    return ways.select(F.col("path")[0].alias("root"), F.explode("path").alias("id")).groupBy("root", "id").agg(F.count("*").alias("size"))


def centroids(sizes: DataFrame) -> DataFrame:
    """(root, centroid): the lowest vertex of each tree with more than half of its vertices at or below it."""
    whole = sizes.groupBy("root").agg(F.max("size").alias("n"))
    return sizes.join(whole, "root").filter(F.col("size") * 2 > F.col("n")).groupBy("root").agg(F.min_by("id", "size").alias("centroid"))
