"""Performance measures of equity curves and trade lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import constants as C


def drawdown(equity: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Deepest fall from a running peak, in percent."""
    order = Window.partitionBy(*keys).orderBy("date") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peaks = equity.withColumn("_peak", F.max(value).over(order))
    fall = (F.col("_peak") - F.col(value)) / F.col("_peak") * 100
    return peaks.groupBy(*keys).agg(F.greatest(F.max(fall), F.lit(0.0)).alias("max_drawdown_pct"))


def returns(equity: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("date")
    before = F.lag(value).over(order)
    return equity.withColumn("ret", (F.col(value) - before) / before)


def sharpe(equity: DataFrame, keys: list[str], periods: float = 52, value: str = "value") -> DataFrame:
    """Annualised mean over population deviation; 0 with two points or fewer."""
    r = returns(equity, keys, value)
    ratio = F.avg("ret") / (F.stddev_pop("ret") + C.EPSILON) * F.sqrt(F.lit(float(periods)))
    return r.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > 2, ratio).otherwise(0.0).alias("sharpe"))


def trade_measures(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, win rate, mean win and loss, profit factor and mean duration."""
    r, days = F.col("return_pct"), F.col("duration_days")
    win, loss = F.avg(F.when(r > 0, r)), F.avg(F.when(r <= 0, r))
    agg = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        (F.count_if(r > 0) / F.count(F.lit(1)) * 100).alias("win_rate_pct"),
        F.round(F.coalesce(win, F.lit(0.0)), 2).alias("avg_win_pct"),
        F.round(F.coalesce(loss, F.lit(0.0)), 2).alias("avg_loss_pct"),
        F.coalesce(F.avg(F.when(days > 0, days)), F.lit(0.0)).alias("avg_duration_days"))
    factor = F.when(F.col("avg_loss_pct") != 0, F.abs(F.col("avg_win_pct") / F.col("avg_loss_pct")))
    return agg.withColumn("profit_factor", F.coalesce(factor, F.lit(0.0)))


def exit_reasons(trades: DataFrame, keys: list[str]) -> DataFrame:
    r = F.col("return_pct")
    return trades.groupBy(*keys, "exit_reason").agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(r).alias("avg_return_pct"),
        (F.count_if(r > 0) / F.count(F.lit(1)) * 100).alias("win_rate_pct"))


def weeks_held(holdings: DataFrame, keys: list[str], top_n: int) -> DataFrame:
    """Tickers held for most weeks."""
    counts = holdings.groupBy(*keys, "ticker").agg(F.count(F.lit(1)).alias("weeks_held"))
    order = [F.col("weeks_held").desc(), F.col("ticker")]
    if not keys:
        return counts.orderBy(*order).limit(top_n)
    window = Window.partitionBy(*keys).orderBy(*order)
    return counts.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= top_n).drop("_r")


def hit_rate(column: Column) -> Column:
    return F.avg(column.cast("double"))
