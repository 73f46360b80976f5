"""Incremental ingest: landed files into keyed tables, then only the affected tail of indicators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark import schemas as S
from tidemark.operators.upsert import month_of, newest, upsert_table, write_partitioned
from tidemark.plans.analysis import INDICATORS, indicators
from tidemark.session import stage, staging
from tidemark.sources import landed as L

KEYS = ["ticker", "date"]


def create_table(df: DataFrame, path: str, date: str = "date") -> None:
    """First load of a table partitioned by month."""
    write_partitioned(df.withColumn("month", month_of(date)), path, "month")


def landing_stream(spark: SparkSession, landing: str, schema: StructType,
                   files_per_batch: int = 1000) -> DataFrame:
    """Files of a landing folder as a stream; each row knows when its file arrived."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(landing)
            .select("*", F.col("_metadata.file_modification_time").alias("_landed"),
                    F.col("_metadata.file_path").alias("_file")))


def increment(batch: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows of a micro-batch, the last landed one per key."""
    return newest(batch, keys, ["_landed", "_file"]).drop("_landed", "_file")


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None],
                  checkpoint: str) -> StreamingQuery:
    """Process what has landed and stop. A repeated batch is harmless: ``apply`` merges by key."""
    query = (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def ingest_bars(spark: SparkSession, landing: str, table: str, checkpoint: str,
                files_per_batch: int = 1000) -> None:
    """Upsert landed bars; late corrections replace earlier values whatever their date."""
    def apply(batch: DataFrame, _: int) -> None:
        upsert_table(spark, table, L.landed_bars(increment(batch)), KEYS)
    run_available(landing_stream(spark, landing, S.BARS, files_per_batch), apply, checkpoint)


def refresh_from(spark: SparkSession, bars: DataFrame, tickers: DataFrame, table: str, since: dt.date) -> None:
    """Recompute every day from ``since`` on of the given tickers and store it.

    A changed bar moves all later indicators, so the stored table equals one computed anew. Whole
    history is read for the touched tickers alone: running values have no last row that matters.
    """
    context = bars.join(tickers, "ticker", "left_semi").drop("month")
    fresh = indicators(context).where(F.col("date") >= F.lit(since)).select("ticker", "date", *INDICATORS)
    upsert_table(spark, table, fresh, KEYS)


def ingest_and_refresh(spark: SparkSession, landing: str, bars_table: str, indicator_table: str,
                       checkpoint: str, files_per_batch: int = 1000) -> None:
    """Upsert landed bars, then refresh the indicators of the touched tickers."""
    def apply(batch: DataFrame, _: int) -> None:
        with staging(spark):
            delta = stage(L.landed_bars(increment(batch)), "delta")
            upsert_table(spark, bars_table, delta, KEYS)
            since = delta.agg(F.min("date")).first()[0]
            if since is not None:
                refresh_from(spark, spark.read.parquet(bars_table), delta.select("ticker").distinct(), indicator_table, since)
    run_available(landing_stream(spark, landing, S.BARS, files_per_batch), apply, checkpoint)
