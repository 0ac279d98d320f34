"""Session settings, and tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "turnwright", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session for one machine; on a cluster the submitter's settings win because nothing is set there."""
    b = SparkSession.builder.appName(app)
    if master is None and "SPARK_MASTER" not in os.environ:
        master = f"local[{cores}]"
    if master:
        b = (
            b.master(master)
            .config("spark.driver.memory", "8g")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests, one machine) a temporary one is made and set."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    there = "file://" + tempfile.mkdtemp(prefix="turnwright-")
    spark.conf.set("spark.checkpoint.dir", there)
    return there


_made: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; then the cluster's own cleaning removes the folder
            pass


atexit.register(_clean)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: cuts the lineage and outlives a lost executor.

    Unlike a checkpointed RDD it is columnar and compressed, keeps sizes for the planner, and lets a later read prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Remove the files of a stage that is no longer read (rounds of an iteration)."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = f.rsplit("/", 1)[0]
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
