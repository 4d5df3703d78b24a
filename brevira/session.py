"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it lies in a folder they can see.

    On a cluster without such a folder, submit the package with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if x]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "8g", app: str = "brevira") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only in local mode, as in tests, a folder of this machine is made where none is named.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_brevira_shared", None)
        if base is None:
            base = spark._brevira_shared = "file://" + tempfile.mkdtemp(prefix="brevira-")
    return base.rstrip("/")


def staged(df: DataFrame, tag: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage and its plan; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folders(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession) -> list[str]:
    """Folders that ``staged`` has written in this session and that are still there."""
    if not hasattr(spark, "_brevira_folders"):
        spark._brevira_folders = []
    return spark._brevira_folders


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of staged tables that no later plan reads; all of ``folders(spark)`` once every result is written."""
    for path in list(paths):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if path in folders(spark):
            folders(spark).remove(path)
