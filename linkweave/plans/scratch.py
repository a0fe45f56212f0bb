"""Intermediate tables in the folder that the whole cluster shares.

Iterative jobs have to cut their lineage.  They do so by writing Parquet under
``spark.checkpoint.dir``, which survives the loss of any executor, keeps the
statistics of the relation honest and keeps the plan short.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="linkweave-")
    return _OWN[app]


class Scratch:
    """A folder of written tables that belongs to one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[str] = []
        atexit.register(self.clear)

    @contextlib.contextmanager
    def _batches(self, rows: int | None) -> Iterator[None]:
        """Meanwhile Arrow batches hold so many rows at most: long texts need few."""
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        if rows is not None:
            self.spark.conf.set(key, str(rows))
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def write(self, df: DataFrame, name: str = "t", batch: int | None = None) -> DataFrame:
        """Write ``df`` and return the written table; ``batch`` bounds the rows of an Arrow batch."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        with self._batches(batch):
            df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def write_bucketed(self, df: DataFrame, keys: list[str], name: str = "t", batch: int | None = None) -> DataFrame:
        """Write ``df`` in buckets of some columns, so that joins on them don't move these rows again."""
        self.count += 1
        path, own = f"{self.root}/{self.count:03d}-{name}", f"{name}_{uuid.uuid4().hex}"
        buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        with self._batches(batch):
            df.write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(own)
        self.tables.append(own)
        out = self.spark.table(own)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def sweep(self) -> None:
        """Let the cluster delete shuffle files of finished steps now: it does when the driver has collected its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended already
            for own in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {own}")
        self.tables = []
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the session may have ended already
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
