"""Intermediate tables in the folder that all executors share.

Every multi-stage operator cuts its lineage here: a lost executor costs the tasks that it ran, and a
stage that reads a scratch table never goes back to the stages before it.
"""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, in local mode only."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_ROOT:
        _LOCAL_ROOT[context.applicationId] = tempfile.mkdtemp(prefix="chalkline-")
        atexit.register(shutil.rmtree, _LOCAL_ROOT[context.applicationId], ignore_errors=True)
    return f"file://{_LOCAL_ROOT[context.applicationId]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of this application for ``name``."""
    return f"{scratch_root(spark)}/chalkline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors open by its path; an error where the shared folder isn't mounted."""
    path = scratch_path(spark, name)
    if "://" in path and not path.startswith("file://"):
        raise RuntimeError("spark.checkpoint.dir must be a mounted folder for this")
    path = path.removeprefix("file://")
    os.makedirs(path)
    return path


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once as Parquet and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; DataFrames that read them can't be used any more.

    For the end of a job: the tables live as long as DataFrames may read them, so no operator can drop its own.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/chalkline/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
