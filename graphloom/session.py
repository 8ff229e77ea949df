"""Session and scratch-folder helpers shared by the whole package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of a table for each partition of an exchange, at most.
ROWS = 500_000
#: Bytes of a table's files and of an exchange that one task takes, at most about. Packed rows of two ids and a
#: weight take ten times as much in a hash table; by Spark's own 128 and 64 MB, tasks of small tables stay far below these and grow with them.
SETTINGS = {"spark.sql.files.maxPartitionBytes": "16MB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB"}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Spark's reader is the only thing that opens inputs."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df``, a table as it is read, with exchanges from now on of a partition for each ``ROWS`` of its rows at least.

    A task's share so stays the same as tables grow. The session keeps the number, which only rises; adaptive
    execution joins partitions that turn out small, but not beyond ``SETTINGS``, which the session keeps as well.
    """
    conf = df.sparkSession.conf
    for key, value in SETTINGS.items():
        conf.set(key, value)
    needed = -(-df.count() // ROWS)
    if needed > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set("spark.sql.shuffle.partitions", needed)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is absent (local tests) a temporary folder is made and set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, once: bool = False, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    ``once``: nothing else is computed from ``df``, so its shuffle files go when it is written.
    """
    return _stored(df, f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}", "error", once, codec)


def appended(df: DataFrame, to: DataFrame | None) -> DataFrame:
    """The ``written`` table ``to`` (None: a new one) with the rows of ``df``, from which nothing else is computed."""
    path = to._graphloom_path if to is not None else f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    return _stored(df, path, "append", True, "snappy")


def _stored(df: DataFrame, path: str, mode: str, once: bool, codec: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    try:
        conf.set(SHUFFLE_CLEANUP, "true" if once else before)
        df.write.mode(mode).parquet(path, compression=codec)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete ``written`` tables (None is passed over) that nothing reads any more."""
    for df in tables:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._graphloom_path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shipped(spark: SparkSession) -> None:
    """Give the executors this package, once for each context; they need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "graphloom.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(here.rglob("*.py")):
            out.write(f, f.relative_to(here.parent).as_posix())
    context.addPyFile(str(path))
    context._graphloom_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    shipped(df.sparkSession)
    return df.mapInArrow(function, schema)
