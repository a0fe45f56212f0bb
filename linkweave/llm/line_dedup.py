"""Delete later copies of repeated line runs with a suffix array.

Only lines that occur at least twice can be in a repeated run; they get dense
ids, and each document becomes its sequence of such ids, broken where another
line stands between.  Prefix doubling ranks the suffixes of these sequences:
round k sorts all positions by (rank of the first 2^k lines, rank of the next
2^k) over range partitions; partition sums make the ranks global.  Doubling ends
as soon as 2^(k+1) lines exceed every window below.

For each position the shortest window that starts there, and the shortest that
ends there, with at least ``min_words`` words is looked at.  Suffixes that share
a window form one interval of the suffix array in which neighbours have it as
a common prefix; such an interval is named by two overlapping ranks.  All of an
interval's windows but the first in document order are later copies.  Every run
of at least that many words that repeats an earlier one is the union of such
windows, so that their union deletes exactly the maximal repeated runs.

Sorting uses the position as the last key: equal keys spread over partitions,
and a line that is a third of the corpus is no heavier than any other.

Defined cases: a null text stays null, an empty one stays empty; blank lines
neither match nor break a run and are kept; a row that repeats another's id and
text is the same document and gets the same text; documents are ordered by id,
null ids last, then by a hash of the text, so that there are no ties; texts of
any length are read whole; an empty table gives no rows.  All columns of the
input return, whatever their names; n_chars, where there is one, is set to the
new length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import n_words, table, tidy
from linkweave.plans.scratch import Scratch

MIN_WORDS = 5

#: A document: whether its id is null, the id (else 0), a hash of its text.
DOC = ("no_id", "id", "hash")


def _local_ranks(keys: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, rank = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
            new = np.ones(len(own), dtype=bool)
            new[1:] = (own[1:] != own[:-1]).any(axis=1)
            new[0] = last is None or (own[0] != last).any()
            local = rank + np.cumsum(new)
            rank, last = int(local[-1]), own[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(new), pa.array(np.full(len(own), pid, dtype=np.int32))], names=[*names, "__local", "__new", "__pid"])

    return run


def ranked(df: DataFrame, keys: list[str], ties: list[str], scratch: Scratch) -> DataFrame:
    """``df`` (longs only) with the dense ``rank`` of its keys and whether a row is the ``first`` with them."""
    names = [*keys, *[c for c in df.columns if c not in keys]]
    rows = df.select(*[F.col(c).cast("long").alias(c) for c in names])
    rows = rows.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys, *ties)
    schema = ", ".join([*(f"`{c}` long" for c in names), "__local long, __new boolean, __pid int"])
    rows = scratch.write(rows.mapInArrow(tidy(_local_ranks(len(keys), names)), schema), "ranked")
    key = F.struct(*keys)
    parts = rows.groupBy("__pid").agg((F.max("__local") + 1).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy("__pid").collect()
    offsets, total, before = [], 0, None
    for p in parts:  # one row for each partition
        joined = p["low"] == before
        total -= joined
        offsets.append((p["__pid"], total, bool(joined)))
        total += p["n"]
        before = p["high"]
    at = df.sparkSession.createDataFrame(offsets, "__pid int, __offset long, __joined boolean")
    out = rows.join(F.broadcast(at), "__pid")
    first = F.col("__new") & ~(F.col("__joined") & (F.col("__local") == 0))
    return out.select(*names, (F.col("__local") + F.col("__offset")).alias("rank"), first.alias("first"))


def _windows_of(at: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths (in the sequence) of the shortest windows with enough words."""
    total = np.concatenate([[0], np.cumsum(words)])
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    begin = np.repeat(np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(at)]])))
    end = np.repeat(np.concatenate([cut, [len(at)]]), np.diff(np.concatenate([[0], cut, [len(at)]])))
    here = np.arange(len(at))
    stop = np.searchsorted(total, total[:-1] + least, side="left")
    ok = stop <= end
    fore = np.stack([here[ok], stop[ok] - here[ok]], axis=1)
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    ok = (start >= begin) & (total[1:] - total[np.maximum(start, 0)] >= least)
    back = np.stack([start[ok], here[ok] + 1 - start[ok]], axis=1)
    both = np.unique(np.concatenate([fore, back]), axis=0)
    return both[:, 0], both[:, 1]


def _pairs(k: int, least: int, names: list[str]):
    """From each document's ranks at level k: pairs to rank next, and windows that this level names."""
    step = 1 << k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc = [batch.column(j)[i].as_py() for j in range(3)]
                at, words, rank = (np.array(batch.column(j)[i].values, dtype=np.int64) for j in (3, 4, 5))
                starts, sizes = _windows_of(at, words, least)
                after = np.full(len(at), -1)
                follows = np.zeros(len(at), dtype=bool)
                follows[:-step] = at[step:] - at[:-step] == step
                after[:-step][follows[:-step]] = rank[step:][follows[:-step]]
                named = (sizes >= step) & (sizes < 2 * step)
                more = bool((sizes >= 2 * step).any())
                s, m = starts[named], sizes[named]
                cols = [np.concatenate(x) for x in ((at, at[s]), (np.zeros(len(at), dtype=np.int64), m), (rank, rank[s]), (after, rank[s + m - step]), (words, np.zeros(len(s), dtype=np.int64)))]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(cols[0]), d, dtype=np.int64)) for d in doc), *map(pa.array, cols), pa.array(np.full(len(cols[0]), more))], names=names)

    return run


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(no_id, id, hash, gone): the numbers of each document's lines that later copies hold."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    whole = whole.select(F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"), F.split("text", "\n", -1).alias("lines"))
    # ``n`` counts all lines of a document, ``at`` those that aren't blank.
    filled = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("n"), x.alias("line"), n_words(x).alias("words"))), lambda x: x["words"] > 0)
    lines = whole.select(*DOC, F.posexplode(filled).alias("at", "x")).select(*DOC, F.col("at").cast("long").alias("at"), F.col("x.n").cast("long").alias("n"), "x.words", F.xxhash64("x.line").alias("h1"), F.xxhash64("x.line", F.lit("#")).alias("h2"))
    lines = scratch.write(lines, "lines").distinct()
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").select("h1", "h2")
    often = scratch.write(ranked(often, ["h1", "h2"], [], scratch).select("h1", "h2", "rank"), "often")
    found = lines.join(often, ["h1", "h2"]).select(*DOC, "at", "n", "words", "rank")
    sequence = F.sort_array(F.collect_list(F.struct("at", "n", "words", "rank")))
    rows = found.groupBy(*DOC).agg(sequence.alias("s"))
    rows = scratch.write(rows.select(*DOC, F.col("s.at").alias("at"), F.col("s.words").alias("words"), F.col("s.rank").alias("rank"), F.col("s.n").alias("n")), "sequences")
    numbers = rows.select(*DOC, F.explode(F.arrays_zip("at", "n")).alias("z")).select(*DOC, "z.at", "z.n")
    rows = rows.drop("n")
    names = [*DOC, "at", "size", "a", "b", "words", "more"]
    schema = ", ".join([*(f"{c} long" for c in names[:-1]), "more boolean"])
    windows, k = None, 0
    while True:
        pairs = scratch.write(rows.mapInArrow(tidy(_pairs(k, min_words, names)), schema), "pairs")
        own = pairs.filter("size > 0").select(*DOC, "at", "size", "a", "b")
        windows = own if windows is None else windows.unionByName(own)
        todo = pairs.filter("size = 0 AND more")
        if todo.isEmpty():
            break
        # Documents without longer windows still take part in no later class: theirs are named already.
        after = ranked(todo.select("a", "b", *DOC, "at", "words"), ["a", "b"], [*DOC, "at"], scratch)
        sequence = F.sort_array(F.collect_list(F.struct("at", "words", "rank")))
        rows = after.groupBy(*DOC).agg(sequence.alias("s")).select(*DOC, F.col("s.at").alias("at"), F.col("s.words").alias("words"), F.col("s.rank").alias("rank"))
        k += 1
    later = ranked(windows, ["size", "a", "b"], [*DOC, "at"], scratch).filter("NOT first")
    gone = later.select(*DOC, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("at")).distinct()
    gone = gone.join(numbers, [*DOC, "at"])
    return gone.groupBy(*DOC).agg(F.sort_array(F.collect_list("n")).alias("gone"))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers, in ascending order: what stands between them."""
    whole = lambda lines: _let(F.concat(F.array(F.lit(-1)), gone.cast("array<int>"), F.array(F.size(lines))), lambda g: between(lines, g))
    between = lambda lines, g: F.flatten(F.transform(F.sequence(F.lit(0), F.size(g) - 2), lambda i: F.slice(lines, F.get(g, i) + 2, F.get(g, i + 1) - F.get(g, i) - 1)))
    return F.array_join(_let(F.split(text, "\n", -1), whole), "\n")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """``docs`` without later copies; with ``report`` also n_lines and gone (line numbers), instead of such columns of ``docs``."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = scratch.write(repeated_lines(docs, min_words, scratch), "gone")
    gone = gone.select(F.when(F.col("no_id") == 0, F.col("id")).alias("__id"), F.col("hash").alias("__hash"), F.col("gone").alias("__gone"))
    packed = docs.select(F.struct(*docs.columns).alias("__doc"))
    of = lambda c: F.col("__doc").getField(c)
    match = of("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(of("text")) == F.col("__hash"))
    cut = F.col("__gone").isNotNull()
    text = F.when(cut, _without(of("text"), F.col("__gone"))).otherwise(of("text"))
    out = packed.join(gone, match, "left").select("__doc", "__gone", text.alias("__text"))
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(of("n_chars"))
    more = [F.size(F.split(of("text"), "\n", -1)).alias("n_lines"), F.col("__gone").alias("gone")] if report else []
    return out.select(*[new.get(c, of(c)).alias(c) for c in docs.columns if not (report and c in ("n_lines", "gone"))], *more)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.array_join("gone", ",", "").alias("removed_lines"), "text")
