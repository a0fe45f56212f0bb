"""Connected components of an undirected edge table.

``component_labels`` labels every vertex that has an edge with the smallest
vertex id of its component.  Small edge sets (their number is counted first)
are solved by one union-find task; larger ones by alternating large-star and
small-star rounds, whose state is written to the shared folder each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.plans.scratch import Scratch

#: Up to so many contracted edges one task solves the rest: 16 MB of ids.
ONE_TASK_EDGES = 1_000_000
#: Edges contracted together inside a scan task.
CHUNK_EDGES = 500_000
MAX_ROUNDS = 64


def min_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges (u, v) and the smallest id of each one's component."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(ids))
    while len(a):
        la, lb = label[a], label[b]
        keep = la != lb
        a, b, la, lb = a[keep], b[keep], la[keep], lb[keep]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return ids, ids[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    us, vs, n = [], [], 0

    def solved() -> pa.RecordBatch:
        u, v = np.concatenate(us), np.concatenate(vs)
        ids, label = min_labels(u, v)
        keep = (ids != label) | np.isin(ids, u[u == v])
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(label[keep])], names=["src", "dst"])

    for batch in batches:
        us.append(batch.column(0).to_numpy(zero_copy_only=False))
        vs.append(batch.column(1).to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n >= CHUNK_EDGES:
            yield solved()
            us, vs, n = [], [], 0
    if n:
        yield solved()


def _solve_group(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, label = min_labels(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
    return pd.DataFrame({"id": ids, "comp": label})


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
    return row["n"], row["x"]


def star_rounds(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Alternate large-star and small-star until the edges are stars; (id, comp)."""
    current, before = edges, None
    for _ in range(MAX_ROUNDS):
        both = current.union(current.select("dst", "src"))
        low = both.groupBy("src").agg(F.least("src", F.min("dst")).alias("m"))
        large = both.join(low, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = scratch.write(large.filter("src <> dst").distinct(), "large")
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(low, "src").select(F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("m").alias("d")), F.struct(F.col("dst").alias("s"), F.col("m").alias("d")))).alias("e"))
        small = small.select(F.col("e.s").alias("src"), F.col("e.d").alias("dst")).filter("src <> dst").distinct()
        current_new = scratch.write(small, "small")
        scratch.drop(large)
        if before is not None:
            scratch.drop(current)
        current = current_new
        now = _fingerprint(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = current.groupBy("src").agg(F.min("dst").alias("comp")).withColumnRenamed("src", "id")
    roots = leaves.select(F.col("comp").alias("id"), "comp").distinct()
    return leaves.unionByName(roots)


def component_labels(spark: SparkSession, edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES, scratch: Scratch | None = None) -> DataFrame:
    """(id, comp) for each endpoint of ``edges`` (its first two columns, longs).

    Self-loops give a component of one; null endpoints are ignored.
    """
    scratch = scratch or Scratch(spark, "components")
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")).dropna()
    forest = scratch.write(pairs.mapInArrow(_contract, "src long, dst long"), "forest")
    n = forest.count()
    if n <= one_task_edges:
        solved = forest.groupBy((F.col("src") * 0).alias("all")).applyInPandas(_solve_group, "id long, comp long")
    else:
        solved = star_rounds(forest.filter("src <> dst").distinct(), scratch)
        alone = forest.filter("src = dst").select(F.col("src").alias("id")).distinct().join(solved, "id", "left_anti")
        solved = solved.unionByName(alone.select("id", F.col("id").alias("comp")))
    solved = scratch.write(solved, "labels")
    scratch.drop(forest)
    return solved
