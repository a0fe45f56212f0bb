"""Near-duplicate vectors by lattice hashing.

Each hash table projects the unit vectors onto 16 random orthonormal directions
and decodes both halves to the nearest point of the E8 lattice; the two points
and the label are the cell.  A vector is stored in its own cell and looks up
that cell and the neighbouring cells that lie nearest to it; pairs that meet
are verified by their cosine in double precision.  Equal vectors of one label
are merged before and counted, so a very common vector costs one row.

With 6 tables and 16 neighbours, the tests measure the recall of pairs of cosine
0.93 to 0.97 alone, which are the hard ones, in 64 dimensions: above 0.98.

Defined cases: vectors that are null, zero or hold null or non-finite parts,
and rows with a null label or a null id, link with nothing and are a component
of their own; vectors of different length never link; rows that repeat an id
with an equal vector count as copies of each other; equal cosines need no rule,
as all links count; an empty table gives no rows; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import table
from linkweave.llm.vectors import is_finite, matrices
from linkweave.operators.components import component_labels
from linkweave.plans.scratch import Scratch

THRESHOLD = 0.93
TABLES = 6
NEIGHBOURS = 16
#: Two lattice points a cell; the projection is stretched by this much.
BLOCKS = 2
STRETCH = 2.0
SEED = 20


@cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    near = np.round(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    at = np.abs(rest[odd]).argmax(axis=1)
    near[odd, at] += np.where(rest[odd, at] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 = D8 + (D8 + 1/2) for each row of 8 numbers."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def lattice_cells(x: np.ndarray, number: int, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Cell codes of unit rows in one table: their own, then the nearest neighbours'."""
    dim, width = x.shape[1], 8 * BLOCKS
    rng = np.random.default_rng([SEED, number, dim])
    direct = rng.normal(size=(dim, width))
    if dim >= width:
        direct = np.linalg.qr(direct)[0] * np.sqrt(dim / width)
    y = x @ direct * STRETCH + rng.uniform(0, 1, width)
    step = rng.integers(1, 2**62, width, dtype=np.int64) | 1
    points = np.concatenate([nearest_e8(y[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)], axis=1)
    rest, short = y - points, minimal_vectors()
    with np.errstate(over="ignore"):
        own = ((2 * points).astype(np.int64) * step).sum(axis=1)
        moves = np.concatenate([((2 * short).astype(np.int64) * step[8 * b : 8 * b + 8]).sum(axis=1) for b in range(BLOCKS)])
        gain = np.concatenate([rest[:, 8 * b : 8 * b + 8] @ short.T for b in range(BLOCKS)], axis=1)
        best = np.argsort(-gain, axis=1, kind="stable")[:, :neighbours]
        return np.concatenate([own[:, None], own[:, None] + moves[best]], axis=1)


def _hashing(tables: int, neighbours: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, x in matrices(batch.column(1)):
                x = unit(x)
                for t in range(tables):
                    cells = lattice_cells(x, t, neighbours)
                    n, k = cells.shape
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], k)), pa.array(np.full(n * k, t, dtype=np.int32)), pa.array(cells.ravel()), pa.array(np.tile(np.arange(k) == 0, n))], names=["rep", "t", "cell", "own"])

    return run


def _cosines(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            right, size = batch.column(3), np.diff(batch.column(3).offsets.to_numpy())
            for at, x in matrices(batch.column(2)):
                at_same = size[at] == x.shape[1]
                at, x = at[at_same], x[at_same]
                if len(at):
                    y = right.values.to_numpy(zero_copy_only=False)[right.offsets.to_numpy()[at][:, None] + np.arange(x.shape[1])]
                    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                    keep[at] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= threshold
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    return run


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, neighbours: int = NEIGHBOURS) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding, label)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    x = F.col("embedding").cast("array<double>")
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite(x) & F.exists(x, lambda v: v != 0)
    # A row that takes no part has no ``part`` to be found by: nulls leave no trace in a hash.
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("embedding"), F.when(takes_part, F.xxhash64(x)).alias("part"))
    usable = rows.filter("part IS NOT NULL")
    reps = usable.groupBy("label", "part", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    # One id may come with several vectors, so that the smallest id alone names no representative.
    reps = scratch.write(reps.withColumn("rep_key", F.xxhash64("rep", "label", "part")), "reps")
    cells = scratch.write(reps.select("rep_key", "embedding").mapInArrow(_hashing(tables, neighbours), "rep long, t int, cell long, own boolean"), "cells")
    labelled = reps.select(F.col("rep_key").alias("rep"), "label")
    cells = cells.join(labelled, "rep")
    stored = cells.filter("own").select(F.col("rep").alias("b"), "t", "cell", "label")
    looked = cells.select(F.col("rep").alias("a"), "t", "cell", "label")
    met = looked.join(stored, ["t", "cell", "label"]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = reps.select(F.col("rep_key").alias("a"), F.col("embedding").alias("x"))
    right = reps.select(F.col("rep_key").alias("b"), F.col("embedding").alias("y"))
    pairs = met.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_cosines(threshold), "a long, b long")
    pairs = scratch.write(pairs, "pairs")
    ids = reps.select(F.col("rep_key").alias("a"), "rep", "n")
    both = pairs.union(pairs.select("b", "a")).join(reps.select(F.col("rep_key").alias("b"), F.col("n").alias("n_b")), "b")
    linked = both.groupBy("a").agg(F.sum("n_b").alias("far"))
    labels = component_labels(spark, pairs, scratch=scratch).withColumnRenamed("id", "a")
    found = ids.join(linked, "a", "left").join(labels, "a", "left").withColumn("c", F.coalesce("comp", "a"))
    lowest = found.groupBy("c").agg(F.min("rep").alias("component_id"))
    found = found.join(lowest, "c").select("a", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), "component_id")
    found = reps.select(F.col("rep_key").alias("a"), "label", "part").join(found, "a").select("label", "part", "n_links", "component_id")
    # A representative is found again by its label and 64 bits of hash.
    out = rows.select("vec_id", "label", "part")
    out = out.join(found, ["label", "part"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS s, b.vec_id AS t FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
c(v, k) USING KEY (v) AS (
  SELECT DISTINCT s, s FROM l
  UNION (SELECT l.t, min(u.k) FROM c u JOIN l ON u.v = l.s JOIN recurring.c o ON o.v = l.t WHERE u.k < o.k GROUP BY l.t))
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(k, vec_id) AS component_id, coalesce(k, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT s, count(*) AS n FROM l GROUP BY s) ON s = vec_id LEFT JOIN c ON v = vec_id
"""
