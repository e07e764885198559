"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+` as a Java character class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the session names; makes a local one only where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


#: Bytes of an Arrow batch of texts on its way to Python, where the session sets no bound of its own.
BATCH = 4 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """df; sees to it that no Arrow batch holds much more than BATCH bytes, however long the texts."""
    conf = df.sparkSession.conf
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in conf.getAll:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df


def keep(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def drop(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of a shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def blank_null(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about `limit` bytes of text, one row at least."""
    for batch in batches:
        size = max(1, batch.num_rows * limit // max(limit, batch.column(batch.schema.get_field_index(text)).nbytes))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def give_back() -> None:
    """Memory that Python and Arrow have freed goes back to the system, where the allocator can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, in a worker that keeps no freed memory when a task ends: it may wait for long, or for other stages' tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """As tidy, for applyInArrow."""

    def tidied(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            give_back()

    return tidied
