"""Logs of edge insertions, deletions and queries.

``ops(seq, op, u, v)`` with op 'insert', 'delete' or 'query'.  An operation is
invalid (-1) if it is a self-loop, has an unknown end, inserts an edge that is
there or deletes one that isn't; it changes nothing then.  So the edge's last
valid-looking operation alone tells whether it is there: no replay is needed
for snapshots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave.operators.components import component_labels


def known_ops(ops: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """The operations with canonical ends and ``ok``: no self-loop, both ends known."""
    rows = ops.select("seq", "op", "u", "v", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"))
    ok = F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    if vertices is not None:
        rows = rows.join(vertices.select(F.col("id").alias("u"), F.lit(True).alias("has_u")), "u", "left").join(vertices.select(F.col("id").alias("v"), F.lit(True).alias("has_v")), "v", "left")
        ok = ok & F.coalesce("has_u", F.lit(False)) & F.coalesce("has_v", F.lit(False))
    return rows.select("seq", "op", "u", "v", "src", "dst", F.coalesce(ok, F.lit(False)).alias("ok"))


def _with_initial(changes: DataFrame, initial: DataFrame | None) -> DataFrame:
    if initial is None:
        return changes
    first = initial.select(F.lit(None).cast("long").alias("seq"), F.lit("insert").alias("op"), "src", "dst")
    return changes.unionByName(first)


def op_validity(ops: DataFrame, initial: DataFrame | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """(seq, op, u, v, valid) of insertions and deletions."""
    rows = known_ops(ops, vertices).filter("op <> 'query'")
    every = _with_initial(rows.filter("ok").select("seq", "op", "src", "dst"), initial)
    by_edge = W.partitionBy("src", "dst").orderBy(F.col("seq").asc_nulls_first())
    before = F.coalesce(F.lag("op").over(by_edge), F.lit("delete"))
    judged = every.select("seq", (F.col("op") != before).alias("valid")).filter("seq IS NOT NULL")
    return rows.join(judged, "seq", "left").select("seq", "op", "u", "v", F.coalesce("valid", F.lit(False)).alias("valid"))


def live_edges(ops: DataFrame, until: int | None = None, initial: DataFrame | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """(src, dst) of the edges there after all operations with seq <= until."""
    rows = known_ops(ops, vertices).filter("ok AND op <> 'query'")
    if until is not None:
        rows = rows.filter(F.col("seq") <= until)
    every = _with_initial(rows.select("seq", "op", "src", "dst"), initial)
    # The last operation of an edge as an aggregate, so that maps combine it before the shuffle.
    last = every.groupBy("src", "dst").agg(F.max_by("op", F.coalesce("seq", F.lit(-(2**63)))).alias("op"))
    return last.filter("op = 'insert'").select("src", "dst")


def snapshots(ops: DataFrame, times: Sequence[int]) -> DataFrame:
    """(t, src, dst): the live edges at each time, from one pass over the log."""
    rows = known_ops(ops).filter("ok AND op <> 'query'")
    at = F.explode(F.filter(F.array(*[F.lit(int(t)).cast("long") for t in times]), lambda t: t >= F.col("seq")))
    last = rows.select(at.alias("t"), "seq", "op", "src", "dst").groupBy("t", "src", "dst").agg(F.max_by("op", "seq").alias("op"))
    return last.filter("op = 'insert'").select("t", "src", "dst")


def snapshot_components(ops: DataFrame, times: Sequence[int]) -> DataFrame:
    """(t, comp, size): components with an edge at each time, from one labelling of all times' edges.

    Vertex x of time number i is vertex x * times + i there, which keeps the
    order of a time's vertices; ids have to leave room for that.
    """
    every, n = sorted(set(times)), len(set(times))
    if not every:
        raise ValueError("no times")
    number = F.array_position(F.array(*[F.lit(int(t)).cast("long") for t in every]), F.col("t")) - 1
    room = (1 << 62) // n
    at = lambda c: F.when(F.abs(c) < room, F.col(c) * n + number).otherwise(F.raise_error(F.concat(F.lit("too large an id: "), F.col(c).cast("string")))).cast("long")
    edges = snapshots(ops, every).select(at("src").alias("src"), at("dst").alias("dst"))
    sizes = component_labels(ops.sparkSession, edges).groupBy("comp").agg(F.count("*").alias("size"))
    own = F.pmod("comp", F.lit(n))
    return sizes.select(F.element_at(F.array(*[F.lit(int(t)).cast("long") for t in every]), (own + 1).cast("int")).alias("t"), ((F.col("comp") - own) / n).cast("long").alias("comp"), "size")


def outcome_classes(codes: DataFrame) -> DataFrame:
    """Codes of a replay folded to what doesn't depend on the spanning tree.

    insert: -1 invalid, 0 inside a component, 1 merging two;
    delete: -1 invalid, 1 still connected, 2 split; query: 0 or 1.
    """
    folded = F.when((F.col("op") == "delete") & (F.col("code") == 0), 1).otherwise(F.col("code"))
    return codes.select("seq", "op", folded.cast("int").alias("code"))
