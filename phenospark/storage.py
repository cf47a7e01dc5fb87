"""The shared folder and the tables that operators write to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_written: list[tuple[SparkSession, str]] = []


#: A table has so many files for each core of the cluster, or one for so many bytes that its plan scans, if these are more.
FILES_PER_CORE = 8
FILE_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named by ``spark.checkpoint.dir``, or else the one given to ``setCheckpointDir``.
    Only on one machine (a local master) a temporary folder takes its place; a cluster that names
    no folder is an error, as files of one executor would be missing on the others.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"name a folder that driver and executors share in spark.checkpoint.dir; the master is {master}")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="phenospark-"))
    return _own_dir[0]


def tables_dir(spark: SparkSession) -> str:
    """Of this application, so what a killed driver leaves can be told apart."""
    return f"{shared_dir(spark)}/phenospark/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with what operators wrote."""
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _most_files(df: DataFrame, files_per_core: int) -> int:
    """Files by cores or, where that is more, by the bytes of the tables that ``df`` is made from.

    The second keeps the stage that writes as wide as its input asks for: splits of a large table
    (128 MB by default) are never put together, however few cores the cluster has at the moment.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    scanned = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(1, files_per_core * df.sparkSession.sparkContext.defaultParallelism, min(scanned // FILE_BYTES, 2**31 - 1))


def few_files(df: DataFrame, files_per_core: int = FILES_PER_CORE) -> DataFrame:
    """``df`` without small partitions: those beyond _most_files() go to the same tasks, one after the other."""
    return df.coalesce(_most_files(df, files_per_core))


def spread(df: DataFrame, key: str, source: DataFrame, files_per_core: int = 3) -> DataFrame:
    """``df`` dealt by ``key`` to as many tasks as a table made from ``source`` has files, for rows that soon become many.

    Left to itself, Spark puts small partitions together before it is known what they grow to. Where it
    doesn't know the size of ``source``, tasks go by cores alone.
    """
    n = _most_files(source, files_per_core)
    return df.repartition(n if n < 2**31 - 1 else files_per_core * df.sparkSession.sparkContext.defaultParallelism, key)


def materialize(df: DataFrame, name: str, files_per_core: int = FILES_PER_CORE) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: an executor that is lost later costs no recomputation of what stands
    above, and a result that is read several times is computed once. Small partitions are put
    together as in few_files(); a Python stage above sees several of them in one task.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    few_files(df, files_per_core).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing will read again."""
    names = {f.rsplit("/", 2)[-2] for df in tables for f in df.inputFiles()}
    for known in [x for x in _written if x[1].rsplit("/", 1)[-1] in names]:
        _delete(*known)
        _written.remove(known)


@contextmanager
def scope() -> Iterator[None]:
    """Deletes on leaving what operators wrote within. For long sessions: write or collect results inside."""
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            _delete(*_written.pop())


@atexit.register
def release() -> None:
    """Delete the tables that materialize() wrote; runs by itself when the driver ends."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
