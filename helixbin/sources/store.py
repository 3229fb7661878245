"""Stage store: tables written once to storage that driver and executors share, and skipped when they are there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and the session is local."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    found = tempfile.mkdtemp(prefix="helixbin-")
    atexit.register(shutil.rmtree, found, True)
    sc.setCheckpointDir(f"file://{found}")
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage has been completed there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(conf).exists(marker)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], resume: bool = False) -> DataFrame:
    """The table at path, made first unless resume finds it complete."""
    if not (resume and exists(spark, path)):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
