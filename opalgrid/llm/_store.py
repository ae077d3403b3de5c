"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
BROADCAST_ROWS = 200_000  # rows of a few numbers or short strings that may be sent to every task
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set (tests, local mode) a temporary one."""
    named = spark.conf.get(CHECKPOINT, None)
    if named:
        return named.rstrip("/")
    if "dir" not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT} must name a folder shared by the driver and the executors")
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="opalgrid-")
    return _OWN["dir"]


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/opalgrid-{uuid.uuid4().hex}/{name}"
    atexit.register(remove, spark, path)
    return path


def write(df: DataFrame, path: str) -> None:
    """Writes df as Parquet; Spark drops the shuffle files of the write when it has finished."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(FREE_SHUFFLES, before)


_OPEN: list[list[str]] = []


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Tables that are stored inside go at its end; what is read from them must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and reads it back: cuts lineage, and lets the shuffle files before it go."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for paths in _OPEN[-1:]:
        paths.append(path)
    return out


def drop(df: DataFrame) -> None:
    """Removes a stored table that nothing will read again."""
    remove(df.sparkSession, df.stored_at)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for sending to every task if it holds at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
