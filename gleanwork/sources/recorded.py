"""Recorded answers of sources in a folder all executors reach: one file for each answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def recorded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """(task_id, payload): whole files of folder, task_id being the file's name without its ending."""
    read = spark.read.text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return read.select(F.try_url_decode(F.regexp_replace(name, r"\.[^.]*$", "")).alias("task_id"), F.col("value").alias("payload"))
