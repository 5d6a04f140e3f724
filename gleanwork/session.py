"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitted settings are used instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleanwork")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers import the package from where the driver did; on a cluster without it, pass it by --py-files
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one of a local session where that is unset (tests).

    On a cluster the setting is needed, as no other machine reads a folder of this one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-gleanwork-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list[str] = []


def clear_written(spark: SparkSession) -> int:
    """Deletes the tables that `written` made in this session and gives their number; results read from them must have been stored.

    A pipeline calls it when its results are written, so that the shared folder does not grow with each query.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in _written:
        p = hadoop.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    n = len(_written)
    _written.clear()
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table into the shared folder and reads it again.

    A lost executor then costs the running tasks only, as the files are shared. Columns are
    kept compressed, which takes less disk than a checkpoint of rows. clear_written removes it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as cores, for maps in Python that outweigh moving a small input.

    A scan of many splits is left as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df
