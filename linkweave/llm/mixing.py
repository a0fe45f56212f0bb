"""Mix sources to target weights, with DataFrame operations only.

Every row gets a pseudo-random key (MD5 of its document id and a seed).  Within
a source the rows are ordered by that key; the key's range is cut into equal
slices, so that a source with a third of all rows still spreads over many
tasks.  The sums of the slices give each slice the running total before it
(a distributed prefix sum), and the source's budget cuts the order at one
place.  A budget above the source's size repeats whole epochs first.

Defined cases: a null text has size 0; a null source is a source of its own and
comes last; a source without words has target 0; rows with a null id are ordered
by a hash of their text; repeated rows are rows of their own and equal in the
order; texts of any length are whole units; no document is taken more than
``MAX_EPOCHS`` times, an empty one included; an empty table gives an empty
result.  ``mix`` replaces input columns that are named like an output column;
``mix_documents`` returns the input's columns as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave.llm.common import n_words, table
from linkweave.plans.scratch import Scratch

#: Weights of the sources in the order of their names, repeated as needed.
WEIGHTS = (5, 2, 1)
#: A source's target never exceeds so many times its size.
MAX_EPOCHS = 3
SEED = "mix-1"
#: Rows of the largest source that one slice of the key range holds on average, and the most slices.
SLICE_ROWS = 500
MAX_SLICES = 1 << 22
#: Slices summed up together before their prefix sums.
RUN = 1_024
#: Sources up to which a table with one row for each is broadcast.
FEW_SOURCES = 100_000


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, rows, source_size, target) of a table of (source, size).

    Targets share the whole size by weight; where one would exceed the cap it
    stays there and the excess goes to the others by weight.  That fixed point
    is a common level: target = min(cap, level * weight).
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    per = per.withColumn("ratio", F.col("cap") / F.col("w"))
    up = W.orderBy("ratio", F.col("source").asc_nulls_last())
    below, above = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("k", F.row_number().over(up))
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("w").over(above))
    per = per.withColumn("common", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("k"))).over(whole))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("common"), F.lit(0.0)) * F.col("w"))
    return per.select("source", "rows", "source_size", target.alias("target"))


def sized_rows(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with the number of words and the key of the order."""
    return docs.withColumns({"size": n_words(F.col("text")), "__key": _key(seed), "__tie": F.xxhash64("text")})


def _key(seed: str) -> Column:
    """The key of the order: by the id, or by the text of a row without one."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return F.md5(F.concat(own, F.lit("|" + seed)).cast("binary"))


def _place(key: Column, tie: Column, size: Column) -> Column:
    """A row's place in its source's order, as a value to compare."""
    return F.struct(key.alias("key"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), size.alias("size"), tie.alias("tie"))


def mix(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Rows of ``sized_rows`` with source_size, target, copies and taken words."""
    out = _decided(sized.drop("source_size", "target", "taken", "copies"), weights, max_epochs)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _decided(sized: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """The same with whole epochs and whether a row is in the partial one after them."""
    targets = source_targets(sized, weights, max_epochs)
    most = targets.agg(F.max("rows")).first()[0] or 0
    slices = min(MAX_SLICES, max(1, -(-most // SLICE_ROWS)))
    part = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * slices / F.lit(float(2**32)))
    own = [F.col(c).alias(f"__{c}") for c in ("source", "source_size", "target")]
    sums = sized.groupBy("source", part.alias("__part")).agg(F.sum("size").alias("__sum")).withColumn("__run", F.floor(F.col("__part") / RUN))
    # The sum before a slice: that of the runs of slices before its own, and of the slices before it in the run.
    before = lambda key, order: F.coalesce(F.sum("__sum").over(W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy("source", "__run").agg(F.sum("__sum").alias("__sum")).select("source", "__run", before(["source"], "__run").alias("__before_run"))
    runs = runs.select(F.col("source").alias("__of"), F.col("__run").alias("__number"), "__before_run")
    sums = sums.withColumn("__in_run", before(["source", "__run"], "__part"))
    sums = sums.join(runs, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__run") == F.col("__number")))
    cuts = sums.join(targets.select(*own), F.col("source").eqNullSafe(F.col("__source"))).select("__source", "__source_size", "__target", F.col("__part").alias("__slice"), (F.col("__in_run") + F.col("__before_run")).alias("__before"))
    rows = sized.withColumn("__part", part)
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__slice")))
    order = W.partitionBy("__source", "__slice").orderBy("__key", F.col("doc_id").isNull(), F.col("doc_id").cast("string"), "size", "__tie").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("__before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    epochs = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0)
    rows = rows.withColumn("__epochs", epochs).withColumn("__rest", F.col("__target") - F.col("__epochs") * F.col("__source_size")).withColumn("__at", at)
    partial = (F.col("__rest") > 0) & (F.col("__at") + F.col("size") / 2 <= F.col("__rest"))
    out = rows.withColumns({"__partial": partial, "copies": (F.col("__epochs") + partial.cast("int")).cast("int"), "source_size": F.col("__source_size"), "target": F.col("__target")})
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each as often as it is taken; same columns.

    The mix is decided over narrow rows.  In each source's order the documents of
    the partial epoch come before one place, so that a row per source tells
    every document its copies and the texts stay where they are.  Of equal rows
    at that place some may belong to the epoch: so many copies of one are added.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    names = docs.columns
    sized = scratch.write(sized_rows(docs.select("doc_id", "source", "text")).drop("text"), "sized")
    mixed = _decided(sized, WEIGHTS, MAX_EPOCHS).select("source", "__partial", "__epochs", _place(F.col("__key"), F.col("__tie"), F.col("size")).alias("__place"))
    mixed = scratch.write(mixed, "mixed")
    cuts = mixed.groupBy(F.col("source").alias("__source")).agg(F.max("__epochs").alias("__epochs"), F.max(F.when(F.col("__partial"), F.col("__place"))).alias("__cut"))
    cuts = scratch.write(cuts, "cuts")
    small = F.broadcast if cuts.count() <= FEW_SOURCES else lambda df: df
    same = F.col("source").eqNullSafe(F.col("__source"))
    key = _key(SEED)
    place = _place(key, F.xxhash64("text"), n_words(F.col("text")))
    at_key = F.coalesce(key == F.col("__cut.key"), F.lit(False))
    # Sizes are counted only where the key is that of the cut.
    before = F.when(at_key, place < F.col("__cut")).otherwise(F.coalesce(key < F.col("__cut.key"), F.lit(False)))
    rows = docs.select("doc_id", "source", "text", F.struct(*names).alias("__doc")).join(small(cuts), same)
    times = lambda n: F.explode(F.array_repeat(F.lit(1), n.cast("int"))).alias("__n")
    every = rows.select("__doc", times(F.col("__epochs") + before.cast("int")))
    more = mixed.filter("__partial").join(small(cuts.select("__source", "__cut")), same).filter(F.col("__place") == F.col("__cut"))
    more = more.groupBy(F.col("source").alias("__of")).agg(F.count("*").alias("__more"))
    one = rows.filter(F.when(at_key, place == F.col("__cut")).otherwise(F.lit(False))).groupBy("__source").agg(F.first("__doc").alias("__doc"))
    added = one.join(small(more), F.col("__source").eqNullSafe(F.col("__of"))).select("__doc", times(F.col("__more")))
    return every.unionByName(added).select(*[F.col("__doc").getField(c).alias(c) for c in names])


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sized_rows(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "__key", "__tie")
    rows = Scratch(spark, "mix").write(rows, "sized")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, ''))) || '|{SEED}') AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM s),
r AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / w AS ratio FROM w),
l AS (SELECT *, row_number() OVER o AS k,
        CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(w) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM r WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST)),
c AS (SELECT coalesce(min_by(level, k), 0.0) AS common FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), common * w) AS target FROM l, c),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, CAST(d.doc_id AS VARCHAR) ASC NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN source_size > 0 AND gone + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m
"""
