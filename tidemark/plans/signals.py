"""Breakout signals per ticker and their trailing-stop backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import constants as C
from tidemark.functions import indicators as I, scalars as X
from tidemark.operators.exits import chain_trades, cool_down, first_exit
from tidemark.plans import context, measures
from tidemark.session import stage
from tidemark.sources import landed as L


def raw_signals(bars: DataFrame, instruments: DataFrame | None = None,
                force: DataFrame | None = None, order: str = "zone_priority") -> DataFrame:
    """Signal inputs per valid bar and the raw signal, before cool-down."""
    price = F.col("price")
    b = L.valid_bars(bars)
    if force is None:
        b = b.withColumn("force_rel", F.lit(True))
    else:
        b = context.carried_force(b, instruments, force, order)
    b = b.withColumns({
        "price": F.col("adj_close"), "_vol": F.coalesce("volume", F.lit(0.0)),
    }).withColumns({
        "seq": I.row_number() - 1, **I.log_price(price),
        "_signed": I.signed_volume(price, F.col("_vol")),
        "_tr": I.true_range(F.col("high"), F.col("low"), price,
                            I.has_high_low(F.col("high"), F.col("low"))),
        "_roc": I.rate_of_change(price, skip_last=True),
        "_sum": F.sum(price).over(I.running()),
    })
    b = b.withColumn("_changes", I.changes_so_far())
    ladder = I.price_ladder()
    kept = ["ticker", "date", "seq", "price", "volume", "force_rel"]
    b = ladder.build(b.select(*kept, "_vol", "_log", "_signed", "_tr", "_roc", "_sum", "_changes"))
    # The long mean covers what there is until the window is full.
    opening = F.col("_sum") / (F.col("seq") + 1)
    b = b.select(
        *kept, F.coalesce(ladder.total("p", 200) / 200.0, opening).alias("sma_200"),
        "_roc", *[c.alias(n) for n, c in I.trend_sums(ladder).items()],
        (price >= F.max(price).over(I.trailing(C.BREAKOUT_WINDOW))).alias("breakout"),
        (F.col("_vol") / (I.rolling_mean(F.col("_vol"), C.VOLUME_WINDOW, 1) + C.EPSILON)).alias("rvol"),
        F.sum("_signed").over(I.running()).alias("_obv"),
        I.rolling_mean(F.col("_tr"), C.ATR_WINDOW, 1).alias("atr_14"))
    b = b.withColumns({
        "mom_r2": F.col("_roc") * I.trend_fit(), "trend_ok": price > F.col("sma_200"),
        "rvol_high": F.col("rvol") > C.RVOL_THRESHOLD,
        "obv_rising": X.is_true(I.change(F.col("_obv"), C.OBV_SLOPE_WINDOW) > 0),
    })
    signal = F.col("trend_ok") & F.col("force_rel") & X.is_true(F.col("mom_r2") > 0) \
        & F.col("breakout") & F.col("rvol_high") & F.col("obv_rising")
    return b.select("ticker", "date", "seq", "price", "volume", "sma_200", "trend_ok", "force_rel",
                    "mom_r2", "breakout", "rvol", "rvol_high", "obv_rising", "atr_14",
                    signal.alias("signal_raw"))


def signals(bars: DataFrame, instruments: DataFrame | None = None,
            force: DataFrame | None = None, order: str = "zone_priority") -> DataFrame:
    """``raw_signals`` with the cooled signal next to the raw one."""
    rows = stage(raw_signals(bars, instruments, force, order), "signals")
    kept = cool_down(rows.where("signal_raw").select("ticker", "seq")) \
        .withColumn("_kept", F.lit(True))
    return rows.join(kept, ["ticker", "seq"], "left").withColumn(
        "signal", F.coalesce("_kept", F.lit(False))).select(*rows.columns, "signal")


def admitted(rows: DataFrame, min_rows: int = C.BACKTEST_WARMUP) -> DataFrame:
    """Per ticker: its number of rows and whether they suffice for a backtest."""
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_days")).withColumn("admitted", F.col("n_days") >= min_rows)


def long_enough(rows: DataFrame, min_rows: int = C.BACKTEST_WARMUP) -> DataFrame:
    """Rows of tickers with enough history for a backtest."""
    return rows.join(admitted(rows, min_rows).where("admitted"), "ticker", "left_semi")


def backtest(rows: DataFrame, ks=C.K_SWEEP, min_rows: int = C.BACKTEST_WARMUP) -> DataFrame:
    """Sweep of the tickers with enough history; a refused ticker is one row that says so, without measures."""
    rows = stage(rows, "rows")
    enough = long_enough(rows, min_rows)
    trades = signal_trades(stage(exits_by_k(enough, ks), "exits"))
    refused = admitted(rows, min_rows).where("NOT admitted").select("ticker", "n_days", F.lit("REFUSED").alias("outcome"))
    measured = sweep_measures(enough, trades, ks).withColumn("outcome", F.lit("TESTED"))
    return measured.unionByName(refused, allowMissingColumns=True).drop("n_days")


def exits_by_k(rows: DataFrame, ks=C.K_SWEEP) -> DataFrame:
    """Chandelier exit of every cooled signal under every factor (null while still open)."""
    factors = F.array(*[F.lit(float(k)) for k in ks])
    entries = rows.where("signal").select(
        "ticker", "seq", F.explode(factors).alias("k"), F.col("date").alias("entry_date"),
        "price", F.col("atr_14").alias("atr"))
    path = rows.select("ticker", "seq", "date", "price", F.col("atr_14").alias("atr"))
    return first_exit(entries, path, ["ticker", "seq", "k"])


def signal_trades(exits: DataFrame) -> DataFrame:
    """Trades taken: a signal during a trade, its exit bar included, opens nothing."""
    return chain_trades(exits, ["ticker", "k"])


def daily_equity(rows: DataFrame, trades: DataFrame, ks=C.K_SWEEP) -> DataFrame:
    """Equity factor per day: all-in at the entry close, flat outside trades.

    A trade earns the daily change from the bar after its entry to its exit bar. Only the first
    and the last bar of a trade are joined; the days between are carried by a running balance.
    """
    grid = rows.select("ticker", "seq", "date", "price",
                       F.explode(F.array(*[F.lit(float(k)) for k in ks])).alias("k"))
    steps = trades.select("ticker", "k", (F.col("seq") + 1).alias("seq"), F.lit(1).alias("d")) \
        .unionByName(trades.where("exit_seq IS NOT NULL").select(
            "ticker", "k", (F.col("exit_seq") + 1).alias("seq"), F.lit(-1).alias("d"))) \
        .groupBy("ticker", "k", "seq").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("ticker", "k").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.coalesce(F.col("price") / F.lag("price").over(order) - 1, F.lit(0.0))
    held = grid.join(steps, ["ticker", "k", "seq"], "left").withColumns({
        "held": F.sum(F.coalesce("d", F.lit(0))).over(upto), "_change": change})
    held = held.withColumn("ret", F.when(F.col("held") > 0, F.col("_change")).otherwise(0.0))
    return held.withColumn("value", F.exp(F.sum(F.log1p("ret")).over(upto))) \
        .select("ticker", "k", "date", "seq", "ret", "value")


def sweep_measures(rows: DataFrame, trades: DataFrame, ks=C.K_SWEEP,
                   periods_per_year: float = 365) -> DataFrame:
    """Sharpe, return, drawdown and trade counts per ticker and factor.

    Sharpe uses daily returns and the sample deviation; the win rate covers closed trades.
    """
    with_signal = rows.join(rows.where("signal").select("ticker").distinct(), "ticker", "left_semi")
    equity = daily_equity(with_signal, trades, ks)
    upto = Window.partitionBy("ticker", "k").orderBy("seq") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deviation = F.stddev_samp("ret")
    curve = equity.withColumn("_peak", F.greatest(F.max("value").over(upto), F.lit(1.0)))
    by_curve = curve.groupBy("ticker", "k").agg(
        F.coalesce(F.avg("ret") / F.nullif(deviation, F.lit(0.0)) * F.sqrt(F.lit(float(periods_per_year))),
                   F.lit(0.0)).alias("sharpe"),
        ((F.max_by("value", "seq") - 1) * 100).alias("total_return_pct"),
        (F.max((F.col("_peak") - F.col("value")) / F.col("_peak")) * 100).alias("max_drawdown_pct"))
    ret = (F.col("exit_price") / F.col("price") - 1) * 100
    closed = F.col("exit_seq").isNotNull()
    by_trade = trades.groupBy("ticker", "k").agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.coalesce(F.count_if(closed & (ret > 0)) / F.nullif(F.count_if(closed), F.lit(0)) * 100,
                   F.lit(0.0)).alias("win_rate_pct"),
        F.coalesce(F.avg(F.when(closed & (ret > 0), ret)), F.lit(0.0)).alias("avg_win_pct"))
    out = by_curve.join(by_trade, ["ticker", "k"], "left").fillna(
        0, ["n_trades", "win_rate_pct", "avg_win_pct"])
    return out.withColumn("sharpe", F.round("sharpe", 3)).withColumn("ok", F.col("sharpe") >= 1.0)


def best_k(measures_by_k: DataFrame) -> DataFrame:
    """Factor of the greatest Sharpe per ticker, the smallest factor on a tie."""
    return measures_by_k.groupBy("ticker").agg(
        F.max_by(F.struct("k", "sharpe"), F.struct("sharpe", -F.col("k"))).alias("b")).select(
        "ticker", F.col("b.k").alias("best_k"), F.col("b.sharpe").alias("best_sharpe"))


def sweep_summary(measures_by_k: DataFrame) -> DataFrame:
    """Mean Sharpe per factor, the best factor and whether enough tickers pass with it."""
    by_k = measures_by_k.groupBy("k").agg(
        F.round(F.avg("sharpe"), 3).alias("sharpe_mean"), F.count_if("ok").alias("n_ok"),
        F.count(F.lit(1)).alias("n_tickers"))
    # As many rows as tested factors.
    best = by_k.agg(F.max_by(F.struct("k", "n_ok"), F.struct("sharpe_mean", -F.col("k"))).alias("b"))
    return by_k.join(best).select(
        "k", "sharpe_mean", "n_ok", "n_tickers", (F.col("k") == F.col("b.k")).alias("is_best"),
        (F.col("b.n_ok") >= 3).alias("validated"))


def signal_outcomes(rows: DataFrame, horizon: int = 30) -> DataFrame:
    """Return ``horizon`` bars after a signal, in and out of sector strength."""
    later = F.lead("price", horizon).over(I.by_ticker())
    ret = F.round((later - F.col("price")) / F.col("price") * 100, 2)
    out = rows.withColumn("_ret", ret).where(F.col("signal") & F.col("_ret").isNotNull())
    return out.groupBy("ticker", "force_rel").agg(
        F.count(F.lit(1)).alias("n_signals"), F.avg("_ret").alias("mean_return_pct"),
        (measures.hit_rate(F.col("_ret") > 0) * 100).alias("success_pct"))


def trade_detail(rows: DataFrame, exits: DataFrame, horizon: int = 30) -> DataFrame:
    """One row per cooled signal: a closed trade (WIN or LOSS), the OPEN one, or IGNORED because a
    trade was running."""
    taken = signal_trades(exits).select("ticker", "k", "seq", F.lit(True).alias("_taken"))
    shown = rows.withColumns({
        "price_later": F.lead("price", horizon).over(I.by_ticker()),
        "_last": F.last("price").over(
            I.by_ticker().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).where("signal")
    seen = shown.select("ticker", "seq", "price_later", "_last", "trend_ok", "force_rel", "mom_r2",
                        "breakout", "rvol", "obv_rising", "atr_14", "sma_200")
    joined = exits.join(taken, ["ticker", "k", "seq"], "left").join(seen, ["ticker", "seq"])
    closed = F.col("exit_seq").isNotNull()
    end = F.when(closed, F.col("exit_price")).otherwise(F.col("_last"))
    pct = F.round((end - F.col("price")) / F.col("price") * 100, 2)
    outcome = F.when(F.col("_taken").isNull(), "IGNORED").when(~closed, "OPEN") \
        .when(pct > 0, "WIN").otherwise("LOSS")
    kept = F.col("_taken").isNotNull()
    return joined.select(
        "ticker", "k", "entry_date",
        F.when(kept, F.col("exit_date")).alias("exit_date"),
        F.when(kept, F.datediff("exit_date", "entry_date")).alias("duration_days"),
        F.col("price").alias("entry_price"), F.when(kept, F.col("exit_price")).alias("exit_price"),
        F.when(kept, pct).alias("return_pct"), outcome.alias("outcome"), "price_later", "trend_ok",
        "force_rel", "mom_r2", "breakout", "rvol", "obv_rising", "atr_14", "sma_200")
