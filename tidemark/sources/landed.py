"""Landed vendor files to engine tables, and the sets the jobs run over."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import constants as C, schemas as S
from tidemark.functions import indicators as I
from tidemark.operators.upsert import insert_absent

VENDOR_NAMES = {
    "Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close",
    "Adj Close": "adj_close", "Volume": "volume",
}


def read_table(spark: SparkSession, path: str, schema=None, fmt: str = "parquet",
               **options: str) -> DataFrame:
    """Read a landed table; with a schema no file is scanned to infer one."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def vendor_columns(df: DataFrame) -> DataFrame:
    """Flatten headers such as ``('Close', 'XYZ')`` and apply the engine's names."""
    names = []
    for raw in df.columns:
        flat = raw.strip("()").split(",")[0].strip(" '\"") if raw.startswith("(") else raw
        names.append(VENDOR_NAMES.get(flat, flat))
    return df.toDF(*names)


def landed_bars(raw: DataFrame) -> DataFrame:
    """Stock bars: prices are adjusted already, so adj_close is close; rows need a close."""
    bars = vendor_columns(raw)
    bars = S.conform(bars.drop("adj_close").withColumn("adj_close", F.col("close")), S.BARS)
    return bars.where(F.col("close").isNotNull())


def landed_index(raw: DataFrame) -> DataFrame:
    """Index bars: adj_close falls back to close."""
    bars = S.conform(vendor_columns(raw), S.INDEX_BARS)
    return bars.withColumn("adj_close", F.coalesce("adj_close", "close"))


def landed_etf(raw: DataFrame) -> DataFrame:
    """Fund bars; closed days arrive as missing or zero prices and are dropped."""
    bars = S.conform(vendor_columns(raw), S.ETF_BARS)
    return bars.withColumn("adj_close", F.coalesce("adj_close", "close")).where("adj_close > 0")


def landed_fx(raw: DataFrame) -> DataFrame:
    """Units of a currency for one euro."""
    rates = vendor_columns(raw).withColumnRenamed("close", "rate_per_eur")
    return S.conform(rates, S.FX_RATES).where(F.col("rate_per_eur").isNotNull())


def landed_instruments(raw: DataFrame, as_of: dt.date | Column) -> DataFrame:
    renamed = raw.withColumnsRenamed({
        "longName": "name", "marketCap": "market_cap", "trailingPE": "pe_ratio"})
    stamp = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return S.conform(
        renamed.withColumn("sector", F.nullif(F.initcap("sector"), F.lit("")))
        .withColumn("updated", stamp), S.INSTRUMENTS)


def with_seed_funds(funds: DataFrame) -> DataFrame:
    """Sector funds with those of the seed list that are not there yet."""
    seeds = funds.sparkSession.createDataFrame([(*row, True) for row in C.SEED_SECTOR_ETFS], S.SECTOR_ETF)
    return insert_absent(funds, seeds, ["ticker_etf"])


def universe(instruments: DataFrame, bars: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Declared and already collected tickers, or the given ones."""
    if only:
        spark = instruments.sparkSession
        return spark.createDataFrame([(t,) for t in sorted(set(only))], "ticker string")
    return instruments.select("ticker").union(bars.select("ticker")).distinct()


def fx_universe(instruments: DataFrame) -> DataFrame:
    return instruments.select("currency").where("currency IS NOT NULL AND currency <> 'EUR'").distinct()


def valid_bars(bars: DataFrame) -> DataFrame:
    """Bars with a usable adjusted price."""
    return bars.where("adj_close IS NOT NULL AND NOT isnan(adj_close) AND adj_close > 0")


def with_adjusted(bars: DataFrame) -> DataFrame:
    """adj_close falls back to close; rows without either are dropped."""
    return bars.withColumn("adj_close", F.coalesce("adj_close", "close")) \
        .where("adj_close IS NOT NULL")


def tickers_with_history(bars: DataFrame, min_rows: int = C.MIN_HISTORY) -> DataFrame:
    return valid_bars(bars).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars")) \
        .where(F.col("n_bars") >= min_rows)


def bars_with_history(bars: DataFrame, min_rows: int = C.MIN_HISTORY,
                      tickers: DataFrame | None = None) -> DataFrame:
    """Valid bars of tickers with enough rows, in the shuffle the indicators use anyway."""
    kept = valid_bars(bars)
    if tickers is not None:
        kept = kept.join(tickers.select("ticker"), "ticker", "left_semi")
    return kept.withColumn("_n", F.count(F.lit(1)).over(I.whole_ticker())) \
        .where(F.col("_n") >= min_rows).drop("_n")


def since(rows: DataFrame, day: dt.date) -> DataFrame:
    """Rows from a day on; of a table partitioned by month, earlier months are not listed at all."""
    if "month" in rows.columns:
        rows = rows.where(F.col("month") >= day.year * 100 + day.month)
    return rows.where(F.col("date") >= F.lit(day))


def incremental_slice(bars: DataFrame, as_of: dt.date, lookback: int = C.LOOKBACK_DAYS) -> DataFrame:
    """History needed to recompute the newest rows."""
    return since(bars, as_of - dt.timedelta(days=lookback))


def rows_to_save(rows: DataFrame, as_of: dt.date, days: int = C.SAVE_DAYS) -> DataFrame:
    return since(rows, as_of - dt.timedelta(days=days))
