"""The page cache fed by a stream of puts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.operators.cache import latest


def first_deliveries(hits: DataFrame, event_time: str = "found_at", late: str = "7 days") -> DataFrame:
    """A stream of hits without rows delivered again within the watermark (same question, url, module and time)."""
    return hits.withWatermark(event_time, late).dropDuplicates(["question_id", "url", "module", event_time])


def hourly_counts(hits: DataFrame, event_time: str = "found_at", late: str = "7 days", every: str = "1 hour") -> DataFrame:
    """(start, module, hits): hits of each module by windows of event time; late rows count until the watermark passes."""
    windowed = hits.withWatermark(event_time, late).groupBy(F.window(event_time, every), "module").agg(F.count("*").alias("hits"))
    return windowed.select(F.col("window.start").alias("start"), "module", "hits")


def upsert_stream(puts: DataFrame, path: str, checkpoint: str):
    """Writes a stream of cache puts to path, a folder for each batch; read_cache gives the row put last of each url.

    A batch that is run again overwrites its own folder, so the table is the same after a failure.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()  # latest reads it twice
        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return puts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def read_cache(spark, path: str) -> DataFrame:
    """The row put last of each url, over all batches."""
    return latest(spark.read.parquet(path).drop("batch"))


def compacted(spark, path: str, target: str) -> int:
    """Writes the cache at path as one batch into target, a new folder, and gives the number of rows kept.

    The batch has the highest number in path, so a stream that goes on into target overwrites none of its own. path
    stays as it is until its readers are done.
    """
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    read_cache(spark, path).write.mode("overwrite").parquet(f"{target}/batch={last}")
    return spark.read.parquet(target).count()
