"""Tables in the folder that driver and executors share, where a plan's lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else what the
    context already uses, else (local masters only) a temporary folder of this machine, which
    goes when the process ends. Tables in a given folder stay for its owner to clear."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lodestack-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether a finished execution's shuffle files go at once, not when its plan is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions inside are not followed by others that need their shuffles."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def write(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Write a table as Parquet; the shuffles behind it are not needed after that."""
    with shuffles_removed(spark):
        writer.parquet(path)


#: Tables cut inside open blocks of :func:`temporary`, innermost last.
_blocks: list[list[DataFrame]] = []


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """The tables that :func:`cut` writes inside."""
    _blocks.append([])
    try:
        yield _blocks[-1]
    finally:
        _blocks.pop()


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that :func:`cut` writes inside are deleted at the end; results that read them must
    have been written by then."""
    with noted() as tables:
        try:
            yield
        finally:
            for df in tables:
                discard(df)


def in_block() -> bool:
    return bool(_blocks)


def discard_unread(tables: list[DataFrame], df: DataFrame) -> list[DataFrame]:
    """Deletes those of the cut tables that ``df`` does not read; the others."""
    files = df.inputFiles() if tables else []
    kept = [t for t in tables if any(f"/{t._lodestack_path.rsplit('/', 1)[1]}/" in f for f in files)]
    for t in tables:
        if t not in kept:
            discard(t)
    return kept


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here,
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write(df.write, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestack_path = path
    if _blocks:
        _blocks[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`cut`; later reads of it fail."""
    path = getattr(df, "_lodestack_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dealt(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores, dealt over the cores: a small table of
    one row group would otherwise be one task's work. Larger scans stay as they are; rows do not
    change."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
