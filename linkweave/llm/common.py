"""What several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A word: no space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def tidy(run):
    """A function over batches that gives freed memory back when it ends: workers live on for other tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Rows of an Arrow batch where texts go to Python.
TEXT_ROWS = 500
#: Ids up to which a table of them is broadcast (about 100 bytes each in memory).
FEW_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without those with the given ids (one column); few ids are broadcast, so that texts stay where they are."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone_id"))
    gone = F.broadcast(gone) if gone.count() <= FEW_IDS else gone
    rows = docs.select(F.struct(*docs.columns).alias("__doc"))
    kept = rows.join(gone, F.col("__doc.doc_id").cast("long") == F.col("__gone_id"), "left_anti")
    return kept.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])
