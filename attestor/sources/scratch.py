"""Scratch tables in the shared folder that the cluster names, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, a local session gets one of its own; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own[:] = _own or [tempfile.mkdtemp(prefix="checkpoints-")]
        root = _own[0]
    return root.rstrip("/")


def files(spark: SparkSession, path: str):
    """Hadoop's file system that holds ``path``, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = files(spark, path)
    fs.delete(p, True)


#: Whether shuffle files go at the end of the query that wrote them.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the scratches around this place, of this thread alone.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes in here are deleted at the end, but for those written with ``keep``."""
    own: list[str] = []
    before = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(before)
        for path in own:
            delete(spark, path)
            name = path.rpartition("/")[2]
            if "-" not in name:  # of ``dealt``
                spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What a query in here has shuffled is deleted as soon as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def materialise(df: DataFrame, name: str, keep: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    It cuts the lineage: what follows reads files, so a lost executor costs a re-read, not a recomputation. The table goes at
    the end of the surrounding ``scratch``, unless it is to ``keep``, and at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/attestor/{name}-{uuid.uuid4().hex}"
    if _open.get() and not keep:
        _open.get()[-1].append(path)
    df.write.parquet(path, partitionBy=list(by) or None)
    fs, p = files(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, by: str, parts: int, keep: bool = True, lies: bool = False) -> DataFrame:
    """Write ``df`` to a table in the shared folder that is dealt to ``parts`` by a hash of ``by``, and read it back.

    Spark knows how the table lies, so what groups or joins by ``by`` and other columns shuffles no row of it. The table stays until the driver ends;
    without ``keep`` it goes at the end of the surrounding ``scratch``. ``lies``: a shuffled join by ``by`` made ``df``, so it lies that way already.
    """
    spark = df.sparkSession
    told = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{checkpoint_root(spark)}/attestor/{told}"
    if _open.get() and not keep:
        _open.get()[-1].append(path)
    (df if lies else df.repartition(parts, by)).write.bucketBy(parts, by).option("path", path).saveAsTable(told)
    fs, p = files(spark, path)
    fs.deleteOnExit(p)
    return spark.table(told)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


#: Bytes of rows, as they lie in a hash table, up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row of two or three numbers takes there.
ROW_BYTES = 96


def small(df: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``df`` (written already), marked for a broadcast if its counted rows are within BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
