"""Data-quality reports and the decision log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F


def _day(as_of: dt.date | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def stale_tickers(bars: DataFrame, as_of: dt.date | Column, days: int = 3) -> DataFrame:
    """Tickers whose newest bar is more than ``days`` old, oldest first."""
    return bars.groupBy("ticker").agg(F.max("date").alias("last_date")) \
        .where(F.col("last_date") < F.date_sub(_day(as_of), days)).orderBy("last_date", "ticker")


def missing_tickers(universe: DataFrame, landed: DataFrame) -> DataFrame:
    """Requested tickers that delivered no row."""
    return universe.join(landed.select("ticker"), "ticker", "left_anti")


def profile(df: DataFrame, table: str) -> DataFrame:
    """Rows, nulls and share of nulls per column, from one pass over the table."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    types = dict(df.dtypes)
    entries = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                                 F.lit(types[c]).alias("type"), F.col(c).alias("n_null"))
                        for i, c in enumerate(df.columns, 1)])
    return counts.select("_rows", F.explode(entries).alias("e")).select(
        F.lit(table).alias("table"), "e.position", "e.column", "e.type",
        F.col("_rows").alias("n_rows"), "e.n_null",
        (F.col("e.n_null") / F.nullif("_rows", F.lit(0)) * 100).alias("null_pct"))


def update_results(log: DataFrame, bars: DataFrame, as_of: dt.date | Column, days: int = 10) -> DataFrame:
    """Fill price and result of signals whose day plus ``days`` has a bar; others stay open."""
    later = bars.select("ticker", F.date_sub("date", days).alias("date"),
                        F.col("adj_close").alias("_later"))
    joined = log.join(later, ["ticker", "date"], "left")
    due = F.col("_later").isNotNull() & F.col("price_j10").isNull() & F.col("price_j0").isNotNull() \
        & (F.col("date") <= F.date_sub(_day(as_of), days))
    pct = F.round((F.col("_later") - F.col("price_j0")) / F.nullif("price_j0", F.lit(0.0)) * 100, 2)
    return joined.withColumns({
        "result_pct": F.when(due, pct).otherwise(F.col("result_pct")),
        "price_j10": F.when(due, F.col("_later")).otherwise(F.col("price_j10"))}).select(*log.columns)


def system_health(log: DataFrame, as_of: dt.date | Column, days: int = 30) -> DataFrame:
    """Decisions of the trailing days and the share of suggestions that gained 5% or more."""
    decision = F.col("decision")
    suggested = decision == "SUGGESTION"
    won = F.count_if(suggested & (F.col("result_pct") >= 5))
    judged = F.count_if(suggested & F.col("result_pct").isNotNull())
    return log.where(F.col("date") >= F.date_sub(_day(as_of), days)).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_distinct("date").alias("n_days"), F.count(F.lit(1)).alias("n_analyses"),
        F.count_if("signal").alias("n_signals"), F.count_if(suggested).alias("n_suggestions"),
        F.count_if(decision == "REJETÉ_ML").alias("n_rejected_ml"),
        F.count_if(decision == "REJETÉ_NLP").alias("n_rejected_nlp"),
        F.round(F.lit(100.0) * won / F.nullif(judged, F.lit(0)), 2).alias("success_pct"))
