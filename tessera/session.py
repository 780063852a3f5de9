"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FACTOR = "spark.sql.sources.fileCompressionFactor"


def ship_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the checkout beside the driver's; on a cluster without a shared checkout,
    pass the package with --py-files instead."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, root])
    return spark


def honest_sizes(spark: SparkSession) -> SparkSession:
    """Makes Spark count a file as the size of its rows in memory, not of its compressed bytes, when it plans joins: catalogs repeat themselves, and
    a Parquet file of 10 MB of them made a broadcast of 671 MB by way of the driver. Sides that are small are still broadcast, once a
    shuffle has shown their size. A value that the session has is kept."""
    if spark.conf.get(FACTOR, None) in (None, "1.0"):
        spark.conf.set(FACTOR, "100")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets one of
    its own; a cluster has no folder that is known to be shared, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tessera-shared")
    return folder.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share; `clean_up` deletes it."""
    return f"{checkpoint_folder(spark)}/tessera-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Deletes all that the library has written for itself; results not yet written or collected are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: later plans start from files that outlive any executor."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder, where `clean_up` finds it (Spark's own checkpoints lie beside that folder and stay)."""
    return materialise(df)
