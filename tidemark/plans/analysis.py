"""Nightly indicators per bar, for all tickers in one plan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import constants as C
from tidemark.functions import indicators as I
from tidemark.operators.upsert import update_from, write_partitioned
from tidemark.session import stage, staging
from tidemark.sources import landed as L

INDICATORS = ["rsi_14", "sma_200", "sma_50", "bb_lower", "bb_position", "vol_avg_20", "rsi_slope",
              "vol_ratio", "dist_sma200", "atr_14", "regime"]


def indicators(bars: DataFrame) -> DataFrame:
    """Bars with the analysis indicators; tickers below 50 rows get none."""
    price, volume = F.col("adj_close"), F.col("volume")
    row = F.col("_row")
    gain, loss = I.gain_loss(price)
    low_band, band_position = I.bollinger(price, row)
    b = L.with_adjusted(bars).withColumns({
        "_row": I.row_number(), "_n": F.count(F.lit(1)).over(I.whole_ticker()),
        "_gain": gain, "_loss": loss,
        "_tr": I.true_range(F.col("high"), F.col("low"), price,
                            I.has_high_low(F.col("high"), F.col("low"))),
    })
    b = b.withColumns({
        "rsi_14": I.rsi_of(F.col("_gain"), F.col("_loss"), row),
        "sma_200": I.rolling_mean(price, 200, 1), "sma_50": I.rolling_mean(price, 50, 1),
        "bb_lower": low_band, "bb_position": band_position,
        "vol_avg_20": I.rolling_mean(volume, C.VOLUME_WINDOW),
        "atr_14": I.rolling_mean(F.col("_tr"), C.ATR_WINDOW, 1),
    })
    b = b.withColumns({
        "rsi_slope": I.change(F.col("rsi_14"), 3),
        "vol_ratio": volume / (F.col("vol_avg_20") + C.EPSILON),
        "dist_sma200": (price - F.col("sma_200")) / (F.col("sma_200") + C.EPSILON),
        "regime": I.regime(price, F.col("sma_50")),
    })
    enough = F.col("_n") >= C.ANALYSIS_MIN_ROWS
    return b.select(*bars.columns, *[F.when(enough, F.col(c)).alias(c) for c in INDICATORS])


def analysis(bars: DataFrame, instruments: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Indicators with instrument facts; with ``as_of`` only the newest days, from a bounded
    history, else everything."""
    source = bars if as_of is None else L.incremental_slice(bars, as_of)
    rows = indicators(source)
    if as_of is not None:
        rows = L.rows_to_save(rows, as_of)
    facts = instruments.select("ticker", "sector", "market_cap", "pe_ratio")
    return rows.join(facts, "ticker", "left")


def write_back(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored indicator rows updated from fresh ones by (ticker, date)."""
    return update_from(stored, fresh, ["ticker", "date"],
                       [c for c in INDICATORS if c in stored.columns])


def nightly(spark: SparkSession, bars_table: str, indicator_table: str, as_of: dt.date) -> None:
    """Recompute the newest days from a bounded slice and write them back, in one job over two or so months.

    Both tables are partitioned by month; the months read and rewritten follow from ``as_of``, so neither table is scanned.
    Rows that the indicator table does not hold are not added.
    """
    bars = L.incremental_slice(spark.read.parquet(bars_table), as_of)
    fresh = L.rows_to_save(indicators(bars), as_of).select("ticker", "date", *INDICATORS)
    first = as_of - dt.timedelta(days=C.SAVE_DAYS)
    stored = spark.read.parquet(indicator_table).where(F.col("month") >= first.year * 100 + first.month)
    with staging(spark):
        write_partitioned(stage(write_back(stored, fresh), "nightly"), indicator_table, "month")
