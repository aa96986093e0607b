"""Session helpers: a default session, the shared folder, and written intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_SETTING = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A session with the settings the engine expects (UTC, AQE with skew handling, Arrow)."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | settings
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is set, but only in local mode: on a
    cluster a machine-local folder would lose data together with its machine.
    """
    context = spark.sparkContext
    found = context.getConf().get(SHARED_DIR_SETTING) or spark.conf.get(SHARED_DIR_SETTING, None)
    if found:
        return found
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SHARED_DIR_SETTING} to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="tidepane-")
    spark.conf.set(SHARED_DIR_SETTING, found)
    context.setCheckpointDir(found)
    import atexit

    atexit.register(shutil.rmtree, found, True)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_dir(spark), f"tidepane-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables this session wrote; results that were not collected or saved are lost with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), f"tidepane-{spark.sparkContext.applicationId}"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage, pins what must not differ between two reads (partition
    numbers, sampled range bounds), and survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
