"""Copies of a table: data first, then deletes, then the log, and last the references, so that a reader never sees a commit whose files are missing."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from tessera.operators.store import Store, lineage
from tessera.schema import TesseraError

PHASES = ("data", "deletes", "_log", "_refs")
PARALLEL = 8


def _files(spark: SparkSession, root: str, folder: str) -> list[str]:
    """Paths of the files below a folder, relative to the root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out, each, top = [], fs.listFiles(path, True), fs.makeQualified(path).toString()
    while each.hasNext():
        out.append(f"{folder}{each.next().getPath().toString()[len(top):]}")
    return sorted(out)


def copy_table(spark: SparkSession, source: str, target: str) -> int:
    """Bring a table to another place of any file system, or bring it up to date there; the number of files that were copied.

    Files are immutable, so one that is there is not copied again. A target that has other commits is refused.
    """
    source, target = source.rstrip("/"), target.rstrip("/")
    state = lineage([e["snapshot_id"] for e in Store(spark, target).log()], [e["snapshot_id"] for e in Store(spark, source).log()])
    if state in ("ahead", "diverged"):
        raise TesseraError(f"{target} is {state} of {source}: nothing was copied")
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    copied = 0
    for phase in PHASES:
        there = set(_files(spark, target, phase))
        todo = [f for f in _files(spark, source, phase) if f not in there]

        def one(name: str) -> None:
            a, b = hadoop.Path(f"{source}/{name}"), hadoop.Path(f"{target}/{name}")
            if not hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, False, conf):
                raise TesseraError(f"{name} could not be copied")

        with ThreadPoolExecutor(PARALLEL) as pool:
            list(pool.map(one, todo))
        copied += len(todo)
    return copied
