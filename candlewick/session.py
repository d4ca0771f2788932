"""Session helpers: time zone, durable staging, local test sessions."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """All event-time arithmetic is UTC, whatever the cluster default is."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``.  Where nothing is named, a temporary folder serves
    a session whose executors are threads of this machine; elsewhere that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _fallback[app]


def stage(df: DataFrame) -> DataFrame:
    """Materialise a frame that is read more than once.

    Written to the shared folder, which survives lost executors and cuts the lineage.  The files go when the
    session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cores: str | int = "*", app: str = "candlewick", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CANDLEWICK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
