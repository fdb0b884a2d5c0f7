"""Incremental ingestion: each key's content is stored once, in the state of its last attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.streaming import keyed_store

ATTEMPTS, FIRST_DELAY, LONGEST_DELAY = 4, 1.0, 60.0


def keyed(docs: DataFrame, content: str = "text") -> DataFrame:
    """Adds the idempotency key: the content's digest."""
    return docs.withColumn("sha256", F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256))


def first_of_each(docs: DataFrame, key: str = "sha256", order: str = "doc_id") -> DataFrame:
    return keyed_store.first_row(docs, key, order)


def retry_delay(attempt: Column) -> Column:
    """Seconds before the next attempt: doubling, capped; null after the last one."""
    return F.when(attempt < ATTEMPTS, F.least(F.lit(LONGEST_DELAY), FIRST_DELAY * F.pow(F.lit(2.0), attempt - 1)))


def ingest_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, content: str = "text"):
    """Starts a query over the Parquet files that arrive in ``source``; runs what is there."""
    arriving = spark.readStream.schema(schema).parquet(source)
    order = "doc_id" if "doc_id" in arriving.columns else None
    return keyed(arriving, content).writeStream.foreachBatch(keyed_store.sink(target, order=order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: later generations supersede earlier ones."""
    columns = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")
