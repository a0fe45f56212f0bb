"""Ordered replay of operation logs, in batch and as a stream.

``Replayer`` keeps adjacency sets and one spanning forest as parent-free tree
adjacency.  Codes: insert -1 invalid, 0 inside a component, 1 merging two;
delete -1 invalid, 0 no tree edge, 1 tree edge that another edge replaces,
2 split; query 0 or 1.  Whether a deletion gives 0 or 1 depends on the forest
kept here; all else is a fact of the graph.

A log is sequential for each graph: parallel over ``graph_id``, one task holds
the state of one graph.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "graph_id long, seq long, op string, u long, v long, code int"


class Replayer:
    def __init__(self, known: set[int] | None = None):
        self.known = known
        self.edges: dict[int, set[int]] = defaultdict(set)
        self.tree: dict[int, set[int]] = defaultdict(set)

    def _side(self, u: int, v: int) -> tuple[set[int], bool]:
        """Search the forest from both ends in turn; the side that ends first and whether the ends met."""
        if u == v:
            return {u}, True
        seen = ({u}, {v})
        waiting = ([u], [v])
        while True:
            for i in (0, 1):
                if not waiting[i]:
                    return seen[i], False
                x = waiting[i].pop()
                for y in self.tree.get(x, ()):
                    if y in seen[1 - i]:
                        return seen[i], True
                    if y not in seen[i]:
                        seen[i].add(y)
                        waiting[i].append(y)

    def _bad(self, u, v) -> bool:
        return u is None or v is None or u == v or self.known is not None and not {u, v} <= self.known

    def insert(self, u: int, v: int) -> int:
        if self._bad(u, v) or v in self.edges.get(u, ()):
            return -1
        _, met = self._side(u, v)
        self.edges[u].add(v)
        self.edges[v].add(u)
        if met:
            return 0
        self.tree[u].add(v)
        self.tree[v].add(u)
        return 1

    def delete(self, u: int, v: int) -> int:
        if self._bad(u, v) or v not in self.edges.get(u, ()):
            return -1
        self.edges[u].discard(v)
        self.edges[v].discard(u)
        if v not in self.tree.get(u, ()):
            return 0
        self.tree[u].discard(v)
        self.tree[v].discard(u)
        side, _ = self._side(u, v)
        for x in sorted(side):
            for y in sorted(self.edges[x] - side):
                self.tree[x].add(y)
                self.tree[y].add(x)
                return 1
        return 2

    def query(self, u: int, v: int) -> int:
        if u is None or v is None or self.known is not None and not {u, v} <= self.known:
            return 0
        return int(self._side(u, v)[1])

    def run(self, op: str | None, u: int | None, v: int | None) -> int:
        """The code of one operation; an unknown one is invalid."""
        if op == "insert":
            return self.insert(u, v)
        if op == "delete":
            return self.delete(u, v)
        return self.query(u, v) if op == "query" else -1


def _replayed(group: pa.Table) -> pa.Table:
    """One graph's codes; its vertices and first edges stand in the log before everything else."""
    rows = group.sort_by([("part", "ascending"), ("seq", "ascending")])
    part = rows["part"].to_numpy()
    u, v = (rows[c].to_pylist() for c in ("u", "v"))
    own = Replayer({x for x, k in zip(u, part, strict=True) if k == 0} if rows["strict"][0].as_py() else None)
    for a, b, k in zip(u, v, part, strict=True):
        if k == 1:
            own.insert(a, b)
    asked = rows.filter(pa.array(part == 2))
    codes = [own.run(*x) for x in zip(*(asked[c].to_pylist() for c in ("op", "u", "v")), strict=True)]
    return asked.select(["graph_id", "seq", "op", "u", "v"]).append_column("code", pa.array(codes, pa.int32()))


def replay(ops: DataFrame, vertices: DataFrame | None = None, initial: DataFrame | None = None) -> DataFrame:
    """(graph_id, seq, op, u, v, code) of ``ops(graph_id, seq, op, u, v)``.

    With ``vertices(graph_id, id)`` operations on other ends are invalid;
    ``initial(graph_id, src, dst)`` has the edges that are there at first.
    """
    long = lambda c, name: F.col(c).cast("long").alias(name) if c else F.lit(None).cast("long").alias(name)

    def rows(df: DataFrame, part: int, op: str | None, u: str, v: str | None, seq: str | None) -> DataFrame:
        own = F.col(op) if op else F.lit(None).cast("string")
        return df.select("graph_id", long(seq, "seq"), own.alias("op"), long(u, "u"), long(v, "v"), F.lit(part).alias("part"), F.lit(vertices is not None).alias("strict"))

    every = rows(ops, 2, "op", "u", "v", "seq")
    if vertices is not None:
        every = every.union(rows(vertices, 0, None, "id", None, None))
    if initial is not None:
        every = every.union(rows(initial, 1, None, "src", "dst", None))
    return every.groupBy("graph_id").applyInArrow(_replayed, RESULT)


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    engine = pickle.loads(state.get[0]) if state.exists else Replayer()
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    ends = [[None if x is None else int(x) for x in rows[c]] for c in ("u", "v")]
    out = rows.assign(code=[engine.run(*x) for x in zip(rows["op"], *ends, strict=True)])
    state.update((pickle.dumps(engine),))
    yield out


def replay_stream(ops: DataFrame) -> DataFrame:
    """The same over a stream; each trigger's rows follow those before it in seq order."""
    # Ends travel as text: pandas would make a column of numbers with a null inexact.
    text = ops.select("graph_id", "seq", "op", F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"))
    schema = "graph_id long, seq long, op string, u string, v string, code int"
    out = text.groupBy("graph_id").applyInPandasWithState(_update, schema, "engine binary", "append", GroupStateTimeout.NoTimeout)
    return out.select("graph_id", "seq", "op", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "code")
