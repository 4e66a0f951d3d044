"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without: there it is a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share ({master} has machines of its own)")
        folder = f"file:///tmp/checkpoints/tessera-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so a lost executor costs one file, not the job."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a stored() frame that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch; it gets slices of bounded bytes, however wide the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from fn(part)
                release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task holds none of the last one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of one slice handed to a batch function; one longer row is a slice of its own.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about limit bytes each."""
    if batch.num_rows == 0:
        return
    n = max(1, min(batch.num_rows, -(-batch.nbytes // limit)))
    step = -(-batch.num_rows // n)
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        if part.nbytes > 2 * limit and part.num_rows > 1:
            yield from slices(part, limit)
        else:
            yield part


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def below(df: DataFrame, hash_col: str, rows: int) -> DataFrame:
    """About so many rows of df, those with the least 64-bit hashes; all if there are no more. Nothing is sorted, and rows of equal hash stay together."""
    total = df.count()
    return df if total <= rows else df.filter(F.col(hash_col) < F.lit(-(1 << 63) + (1 << 64) * rows // total))


def hashed(column: str):
    """64-bit key of a column; null has its own."""
    return F.xxhash64(F.col(column), F.col(column).isNull())
