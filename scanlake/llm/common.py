"""What the corpus operators share: the scratch folder, written intermediate tables, Arrow passes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes of one Arrow batch at most: texts can be long, so batches are kept short to bound memory.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Bytes read for each partition of a written table at least.
PART_BYTES = 32 << 20
#: The words of the corpus contracts are runs of other characters than these six.
SPACES = " \t\n\x0b\x0c\r"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='scanlake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/scanlake/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def fewer_parts(df: DataFrame) -> DataFrame:
    """df in a partition for each PART_BYTES of what it reads at most, without a shuffle; six for each core stay in any case.

    Many small files cost each executor more than their rows: Hadoop's local file system starts a process for each."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df.coalesce(min(max(6 * df.sparkSession.sparkContext.defaultParallelism, read // PART_BYTES), (1 << 31) - 1))


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    fewer_parts(df).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path := scratch_path(spark, tag))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def removed(*tables: DataFrame) -> None:
    """Deletes tables as written() gave them. Nothing that is still to run may read them."""
    for t in tables:
        _delete(t.sparkSession, t._scratch)
        _written.remove((t.sparkSession, t._scratch))


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run herein leaves no shuffle files; else they stay until the driver's JVM happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is scratch space
            return


def short_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session (a smaller bound of rows stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def arrow_map(df: DataFrame, row_batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    short_batches(df.sparkSession)
    return df.mapInArrow(row_batches, schema)


def signed(h: int) -> int:
    """An unsigned 64-bit number as the long with the same bits."""
    return h - (1 << 64) if h >> 63 else h


def row_key(*cols: str | Column) -> Column:
    """A 64-bit digest of the named columns; equal rows have equal keys."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
