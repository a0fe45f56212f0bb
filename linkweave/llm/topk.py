"""Exact top-k by inner product with a pivot-distance index.

Vectors are quantised to integers.  Lifting each vector x to
(x, sqrt(M - |x|^2)), with M the largest squared norm, turns the largest inner
product into the smallest Euclidean distance, so that the triangle inequality
holds.  The index keys every vector by its nearest pivot and its distance to
it; sorted by that key, consecutive rows form annuli of at most ``ANNULUS``
rows with their distance bounds.

A query's k-th best score so far bounds the radius in which better rows can
lie.  Three steps shrink that radius: a bounded sample of rows gives a first
value; the annuli of the query's own pivot that hold its distance give a
better one; then all annuli that the ball still touches are read, and the rest
is ruled out by the triangle inequality.  Blocks of queries meet annuli in one
matrix product; scores are exact integers.

Defined cases: vectors that are null, empty, or hold null or non-finite parts,
and rows with a null id, take no part; vectors of different length are never
compared, each length has an index of its own; rows with the query's id are the
query's own; repeated rows are candidates each; a table without vectors gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave.llm.common import table
from linkweave.llm.vectors import finite_vectors, matrices
from linkweave.plans.scratch import Scratch

K = 5
QUERY_STEP = 50
SCALE = 256
ANNULUS = 2_048
QUERY_BLOCK = 256
#: Rows of the sample that gives pivots and first bounds.
SAMPLE = 1_024
PIVOTS = (8, 128)
#: Below this squared norm, sums of products are exact in double precision.
EXACT = 2.0**52
SLACK = 1e-6


def quantise(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x.astype(np.float64))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as int64 (or Python integers if they are huge)."""
    if len(q) == 0 or len(x) == 0 or max((q * q).sum(axis=1).max(), (x * x).sum(axis=1).max()) < EXACT:
        return (q @ x.T).astype(np.int64)
    return np.array([[int(v) for v in row] for row in q], dtype=object) @ np.array([[int(v) for v in row] for row in x], dtype=object).T


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Indices of up to ``n`` rows, each farthest from those before it."""
    chosen, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of lifted rows to lifted pivots."""
    square = (x * x).sum(axis=1) + lift * lift
    cross = x @ pivots[:, :-1].T + lift[:, None] * pivots[:, -1]
    return np.sqrt(np.maximum(0, square[:, None] + (pivots * pivots).sum(axis=1) - 2 * cross))


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query row, id, score) of each row's k best; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    for i, row in enumerate(scores):
        at = np.flatnonzero(ids != own[i])
        values = row[at]
        if len(at) > 4 * k and values.dtype != object:
            at = at[values >= np.partition(values, len(values) - k)[len(values) - k]]
            values = row[at]
        for j in sorted(range(len(at)), key=lambda j: (-values[j], j))[:k]:
            yield i, int(ids[at[j]]), int(values[j])


def _index(pivots: np.ndarray, top: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                if x.shape[1] != pivots.shape[1] - 1:
                    continue
                x = quantise(x)
                d = distances(x, np.sqrt(np.maximum(0, top - (x * x).sum(axis=1))), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary())], names=["pivot", "dist", "vec_id", "vec"])

    return run


def _annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack sorted rows into annuli of one pivot each."""
    held: list[tuple] = []

    def packed() -> pa.RecordBatch:
        one = lambda v, t: pa.array([v], t)
        return pa.RecordBatch.from_arrays([one(held[0][0], pa.int32()), one(held[0][1], pa.float64()), one(held[-1][1], pa.float64()), one(np.array([h[2] for h in held], dtype=np.int64).tobytes(), pa.binary()), one(b"".join(h[3] for h in held), pa.binary())], names=["pivot", "lo", "hi", "ids", "vecs"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (held[0][0] != row[0] or len(held) >= ANNULUS):
                yield packed()
                held = []
            held.append(row)
    if held:
        yield packed()


def _blocks(pivots: np.ndarray, top: float, bounds: dict[int, tuple[float, float]], home_only: bool):
    """Blocks of queries for each pivot whose annuli they may touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(start, QUERY_BLOCK)
                ids, tau = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                q = np.stack([np.frombuffer(v.as_py()) for v in part.column(1)])
                norm = (q * q).sum(axis=1)
                d = distances(q, np.zeros(len(q)), pivots)
                reach = np.sqrt(np.maximum(0, norm + top - 2 * tau)) * (1 + SLACK) + SLACK
                lifted = distances(q, np.sqrt(np.maximum(0, top - norm)), pivots) if home_only else None
                for p, (lo, hi) in bounds.items():
                    touch = lifted.argmin(axis=1) == p if home_only else (d[:, p] - reach <= hi) & (d[:, p] + reach >= lo)
                    if touch.any():
                        one = lambda v: pa.array([v], pa.binary())
                        at = np.flatnonzero(touch)
                        own, far = d[at, p], reach[at]
                        if home_only:
                            own = lifted[at, p]
                            far = np.zeros(len(at))
                        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([(own - far).min()]), pa.array([(own + far).max()]), one(ids[at].tobytes()), one(q[at].tobytes()), one((own - far).tobytes()), one((own + far).tobytes())], names=["pivot", "from", "to", "q_ids", "q_vecs", "q_from", "q_to"])

    return run


def _meet(k: int):
    """Score each block of queries against an annulus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, vecs, q_ids, q_vecs, q_from, q_to in zip(*(batch.column(i) for i in range(8)), strict=True):
                lo, hi = lo.as_py(), hi.as_py()
                touch = (np.frombuffer(q_from.as_py()) <= hi + SLACK) & (np.frombuffer(q_to.as_py()) >= lo - SLACK)
                if not touch.any():
                    continue
                own = np.frombuffer(q_ids.as_py(), dtype=np.int64)
                q = np.frombuffer(q_vecs.as_py()).reshape(len(own), -1)[touch]
                ids = np.frombuffer(ids.as_py(), dtype=np.int64)
                own = own[touch]
                found = list(best(products(q, np.frombuffer(vecs.as_py()).reshape(len(ids), -1)), ids, own, k))
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i, _, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _one_length(rows: DataFrame, dim: int, k: int, step: int, scratch: Scratch) -> DataFrame:
    """(query_id, vec_id, score, rank) among the vectors of one length."""
    quantised = F.transform("embedding", lambda v: F.floor(v * SCALE).cast("double"))
    top = rows.agg(F.max(F.aggregate(quantised, F.lit(0.0), lambda a, v: a + v * v)).alias("top"), F.count("*").alias("n")).first()
    top, n = float(top["top"]), top["n"]
    sample = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    s_ids, s = np.array([r[0] for r in sample], dtype=np.int64), quantise(np.array([r[1] for r in sample]))
    lift = np.sqrt(np.maximum(0, top - (s * s).sum(axis=1)))
    s_lifted = np.concatenate([s, lift[:, None]], axis=1)
    pivots = s_lifted[farthest_first(s_lifted, min(PIVOTS[1], max(PIVOTS[0], int(n**0.5 / 8))))]
    spark = rows.sparkSession
    keyed = rows.select("vec_id", "embedding").mapInArrow(_index(pivots, top), "pivot int, dist double, vec_id long, vec binary")
    keyed = scratch.write(keyed, "keyed")
    annuli = keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    annuli = scratch.write(annuli.mapInArrow(_annuli, "pivot int, lo double, hi double, ids binary, vecs binary"), "annuli")
    bounds = {r["pivot"]: (r["lo"], r["hi"]) for r in annuli.groupBy("pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.stack([np.frombuffer(v.as_py()) for v in batch.column(1)]) if batch.num_rows else s[:0]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tau = []
            for own, row in zip(ids, products(q, s), strict=True):
                other = np.sort(row[s_ids != own].astype(np.float64))
                tau.append(other[-k] if len(other) >= k else -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tau, pa.float64())], names=["vec_id", "vec", "tau"])

    asked = scratch.write(keyed.filter(F.col("vec_id") % step == 0).sort("pivot", "dist").select("vec_id", "vec").mapInArrow(first, "vec_id long, vec binary, tau double"), "asked")
    block = "pivot int, from double, to double, q_ids binary, q_vecs binary, q_from binary, q_to binary"

    def visit(queries: DataFrame, home_only: bool) -> DataFrame:
        blocks = scratch.write(queries.mapInArrow(_blocks(pivots, top, bounds, home_only), block), "blocks")
        pairs = annuli.join(blocks, (annuli["pivot"] == blocks["pivot"]) & (blocks["from"] <= annuli["hi"] + SLACK) & (blocks["to"] >= annuli["lo"] - SLACK))
        return pairs.select("lo", "hi", "ids", "vecs", "q_ids", "q_vecs", "q_from", "q_to").mapInArrow(_meet(k), "query_id long, vec_id long, score long")

    home = _ranked(visit(asked, True), k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("better")).distinct()
    closer = asked.join(home, "vec_id", "left").select("vec_id", "vec", F.greatest("tau", F.coalesce("better", F.lit(float("-inf")))).alias("tau"))
    closer = scratch.write(closer, "closer")
    return _ranked(visit(closer, False), k)


def top_k(df: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each id divisible by ``step``."""
    scratch = Scratch(df.sparkSession, "topk")
    rows = finite_vectors(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL"))
    lengths = [r[0] for r in rows.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()]
    out = None
    for dim in lengths:
        found = _one_length(rows.filter(F.size("embedding") == dim), dim, k, step, scratch)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
