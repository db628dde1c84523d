"""Session helpers: table access and the shared folder for lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.worker.reuse", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers: on a cluster as an archive that Spark hands out, in one
    machine by its path."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        paths = [p for p in (sc.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
        if home not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join([home, *paths])
    elif _SHIPPED.get("to") != sc.applicationId:
        # made on the driver, read there by Spark's file server
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="kinweave-"), "kinweave"), "zip", home, "kinweave"))
        _SHIPPED["to"] = sc.applicationId


_SHIPPED: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = got.get() if got.isDefined() else None
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="kinweave-cp-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written to the shared folder and read again.

    The files outlive any executor, and, unlike an RDD checkpoint, stay columnar, so a
    later reader still prunes columns. Used where a result is read more than once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/kinweave/{os.getpid()}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reclaim(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/kinweave/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
