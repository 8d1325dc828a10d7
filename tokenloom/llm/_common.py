"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch, unless the session names a number of its own: the JVM and Python hold a batch of texts several times.
BATCH_ROWS = "1000"
_written: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows where they are Spark's usual 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tokenloom-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset a single JVM takes one of its own, a cluster can't."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir()
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tokenloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tokenloom_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for frames that nothing reads any more."""
    for df in frames:
        path = df._tokenloom_path
        _delete(df.sparkSession, path)
        _written.remove((df.sparkSession, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # its session may have ended; others may not
            continue


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(batch: pa.RecordBatch, column: int = 1, rows: int = 500, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows whose texts in a column hold about ``size`` bytes, or one row."""
    texts = batch.column(column)
    width = 8 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else 4
    if not batch.num_rows:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if width == 8 else np.int32, count=batch.num_rows + 1, offset=texts.offset * width)
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, int(np.searchsorted(offsets, int(offsets[at]) + size, side="right")) - 1, batch.num_rows)
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def fold(doc_id: int, parts: int) -> int:
    """crc32 of the id as text, modulo parts."""
    return zlib.crc32(str(doc_id).encode()) % parts


def fold_column(doc_id, parts: int):
    return (F.crc32(doc_id.cast("string").cast("binary")) % parts).cast("int")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
