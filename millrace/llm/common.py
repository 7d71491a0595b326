"""What the operators of this subpackage share: where intermediate rows go, and how they get there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A folder of this machine is made up only where the session names none and runs in
    one process, as tests do.
    """
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
    sc.setCheckpointDir(named)  # a new folder below it, for this application alone
    made = sc._jsc.sc().getCheckpointDir().get()
    _made_here(spark, made)
    return made


def files_for(spark: SparkSession, rows: int, each: int = 500_000, least: int = 0) -> int:
    """How many files are enough for a table of so many rows: one for ``each`` of them, and two a core at least, but no second one below ``least`` rows a file.

    A file costs more than its rows where these are few: without Hadoop's native library, Spark
    starts six processes for each Parquet file in a local folder and four for each of a checkpoint.
    """
    files = max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))
    return min(files, max(1, -(-rows // least))) if least else files


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """``df`` held in the shared folder; its lineage ends there, and losing an executor loses none of it.

    Where there are more partitions than ``files``, a task writes several of them to one file.
    """
    shared_dir(df.sparkSession)
    return (df.coalesce(files) if files else df).checkpoint(eager=True)


def small(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A few rows of the driver's as a table. They go as Arrow: from a list of tuples Spark would start Python on the executors."""
    return spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(columns.items())}))


_MADE: list[tuple] = []


def _made_here(spark: SparkSession, path: str) -> None:
    """What is in that folder goes when the driver's process ends."""
    if not _MADE:
        atexit.register(_clear)
    _MADE.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))


def new_path(spark: SparkSession, what: str) -> str:
    """A new folder's name in the shared folder; what is in it goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made_here(spark, path)
    return path


def _clear() -> None:
    for jvm, conf, path in _MADE:
        with contextlib.suppress(Exception):  # the process ends, and the JVM may have ended before it
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


_LOCK, _WRITING = threading.Lock(), []


@contextlib.contextmanager
def _cleaning(spark: SparkSession):
    """Shuffle files go with the query that made them, as long as any thread is inside; then the session's setting is as it was."""
    with _LOCK:
        if not _WRITING:
            _WRITING.append(spark.conf.get(CLEANUP))
            spark.conf.set(CLEANUP, "true")
        _WRITING.append(None)
    try:
        yield
    finally:
        with _LOCK:
            _WRITING.pop()
            if len(_WRITING) == 1:
                spark.conf.set(CLEANUP, _WRITING.pop())


def stash(df: DataFrame, what: str, files: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: for wide rows, of which later steps read some columns.

    ``files`` is as for ``cut``.
    """
    path = new_path(df.sparkSession, what)
    with _cleaning(df.sparkSession):  # once the rows are written, nothing needs the shuffle files that led to them
        (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str):
    """The column of that name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def remainder(column: str, n: int):
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def mixed(h: np.ndarray) -> np.ndarray:
    """A hash of unsigned 64-bit numbers whose order is as good as random (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
