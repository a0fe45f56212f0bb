"""Readers of graph formats into edge tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave.operators.graph import canonical
from linkweave.plans.scratch import Scratch


def matrix_market_lines(lines: DataFrame) -> DataFrame:
    """Edges of MatrixMarket coordinate text given as rows (n, value): line number and line.

    Comment and blank lines are left out, and so is the first line after them,
    which holds the dimensions; further fields of a line are ignored.  Indices
    count from 1 in the file and from 0 in the result.
    """
    data = lines.select("n", F.trim("value").alias("line")).filter("line <> '' AND NOT startswith(line, '%')")
    # The dimensions are the data line with the smallest number: one row, found by an aggregate.
    first = data.agg(F.min("n").alias("first"))
    data = data.join(F.broadcast(first), F.col("n") > F.col("first"))
    field = F.split("line", r"\s+")
    return canonical(data.select((field[0].cast("long") - 1).alias("src"), (field[1].cast("long") - 1).alias("dst")))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Edges (src, dst) of a MatrixMarket file."""
    # Rows of one text file come in order within its splits, and splits come in order.
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    return matrix_market_lines(lines)


def _starts(rows: DataFrame) -> DataFrame:
    """``rows(id, degree)`` with the sum of all degrees before each id.

    Ids are dealt into ranges; each range's sum, one row for each partition, is
    added to the sums within it.
    """
    scratch = Scratch(rows.sparkSession, "csr")
    dealt = rows.select("id", F.col("degree").cast("long").alias("degree")).repartitionByRange("id").select("id", "degree", F.spark_partition_id().alias("range"))
    dealt = scratch.write(dealt, "ranges")
    before = lambda key, order, c: F.coalesce(F.sum(c).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("range").agg(F.sum("degree").alias("sum")).select("range", before(F.lit(0), "range", "sum").alias("before"))
    return dealt.withColumn("start", before("range", "id", "degree")).join(F.broadcast(ranges), "range").select("id", "degree", (F.col("start") + F.col("before")).alias("start"))


def csr_pairs(rows: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(src, dst) of compressed rows: ``rows(id, degree)`` and ``neighbors(pos, neighbor)``."""
    spans = _starts(rows).filter("degree > 0")
    own = spans.select(F.col("id").alias("src"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("degree") - 1)).alias("pos"))
    return own.join(neighbors, "pos").select("src", F.col("neighbor").alias("dst"))


def to_csr(adjacency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``adjacency(id, neighbors)`` as (id, degree) and (pos, neighbor)."""
    rows = adjacency.select("id", F.size("neighbors").alias("degree"))
    flat = adjacency.select("id", F.posexplode("neighbors").alias("i", "neighbor")).join(_starts(rows), "id")
    return rows, flat.select((F.col("start") + F.col("i")).alias("pos"), "neighbor")


def _binary(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for content in rows["content"]:
        x = np.frombuffer(content, dtype="<i4").astype(np.int64)
        n = int(x[0])
        degree = x[1 : n + 1]
        to = x[n + 1 : n + 1 + degree.sum()]
        out.append(pd.DataFrame({"src": np.repeat(np.arange(n), degree), "dst": to}))
    return pd.concat(out) if out else pd.DataFrame({"src": [], "dst": []}, dtype="int64")


def read_binary_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a binary file of 32-bit integers: n, n degrees, then the neighbours in turn."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return canonical(files.mapInPandas(lambda it: (_binary(x) for x in it), "src long, dst long"))
