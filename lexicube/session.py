"""Session helpers: table loading, lineage cuts in the shared folder, sizes."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexicube")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lexicube-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a session of one process (``local[…]``) gets a folder of its
    own; on a cluster it is an error, since executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexicube-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it lives."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # the session may be gone; leftovers lie in the scratch folder
        logging.getLogger(__name__).debug("%s is left behind: %s", path, e)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path, none if it doesn't exist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/lexicube-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path))
    return path


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        delete(spark, path.rsplit("/", 1)[0])


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This ends the lineage: a lost executor costs only the stage that runs, and
    what is used twice is computed once. Parquet keeps it columnar, so later
    reads still prune columns, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexicube_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Free a table made by :func:`cut` that nothing will read any more."""
    path = getattr(df, "_lexicube_path", None)
    if path:
        delete(df.sparkSession, path.rsplit("/", 1)[0])


def slots(spark: SparkSession) -> int:
    """Tasks that run at the same time, as far as the session knows."""
    return max(1, spark.sparkContext.defaultParallelism)


def partitions_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Number of tasks for ``rows`` so that each has at most ``rows_per_task``."""
    return max(min(slots(spark), max(1, rows)), -(-rows // max(1, rows_per_task)))
