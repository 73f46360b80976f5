"""Weekly portfolio backtest: ranked entries, daily rule-based exits, one fold per configuration.

Scores depend on a configuration's screen only and exits not on the portfolio at all, so they are computed once per
screen, for all Mondays and all possible entries. Only slots and cash are sequential; that fold reads at most
``max_positions`` rows per Monday and configuration.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import constants as C
from tidemark.functions import scalars as X
from tidemark.functions.slots import FOLD_SCHEMA, fold_slots
from tidemark.operators.asof import asof_join, asof_priority
from tidemark.operators.exits import first_exit
from tidemark.operators.ranking import top_per_group
from tidemark.plans import context, measures, ranking
from tidemark.session import stage
from tidemark.shipping import ship_package

CONFIG_SCHEMA = "config_id string, max_positions int, sma_period int, min_mom_r2 double, " \
    "start date, end date"
_CONFIG_FIELDS = ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in CONFIG_SCHEMA.split(", ")))


@dataclass(frozen=True)
class Config:
    """One parameter set of the backtest."""

    config_id: str
    max_positions: int = C.DEFAULT_MAX_POSITIONS
    sma_period: int = 200
    min_mom_r2: float = 0.0
    start: dt.date | None = None
    end: dt.date | None = None

    def __post_init__(self) -> None:
        if self.sma_period not in (150, 200):
            raise ValueError(f"sma_period is 150 or 200, not {self.sma_period}")


@dataclass(frozen=True)
class Backtest:
    trades: DataFrame
    equity: DataFrame
    holdings: DataFrame
    weeks: DataFrame


def sma_compare(max_positions: int = 5, min_mom_r2: float = 0.0) -> list[Config]:
    return [Config(f"sma_{n}", max_positions, n, min_mom_r2) for n in (200, 150)]


def momentum_compare(max_positions: int = 5) -> list[Config]:
    return [Config(f"mom_r2>{t}", max_positions, 200, t) for t in (0.0, 0.01, 0.05)]


def each_config(df: DataFrame, configs: list[Config]) -> DataFrame:
    """One copy of each row per configuration, with the configuration's columns."""
    # One constant however many there are: a literal per field would swell the plan.
    items = F.from_json(F.lit(json.dumps([asdict(c) for c in configs], default=str)), f"array<struct<{_CONFIG_FIELDS}>>")
    return df.withColumn("_config", F.explode(items)).select(*df.columns, "_config.*")


def timeline(ind: DataFrame, configs: list[Config]) -> DataFrame:
    """Backtest days per configuration: within its bounds, warm-up dropped when long enough.

    At most one row per calendar day and configuration.
    """
    days = ind.select("date").distinct()
    inside = F.coalesce(F.col("date") >= F.col("start"), F.lit(True)) \
        & F.coalesce(F.col("date") <= F.col("end"), F.lit(True))
    own = each_config(days, configs).where(inside)
    order = Window.partitionBy("config_id").orderBy("date")
    numbered = own.withColumns({
        "_i": F.row_number().over(order),
        "_n": F.count(F.lit(1)).over(Window.partitionBy("config_id"))})
    kept = numbered.where((F.col("_n") <= C.BACKTEST_WARMUP) | (F.col("_i") > C.BACKTEST_WARMUP))
    return kept.select("config_id", "date", (F.weekday("date") == 0).alias("is_monday"))


def market_state(ind: DataFrame, instruments: DataFrame | None, force: DataFrame | None,
                 macro: DataFrame | None) -> DataFrame:
    """Indicators with the day's sector and macro state; all series pass where nothing is known."""
    rows = ranking.sector_passes(ranking.with_sector(ind, instruments), force, "date") \
        .withColumn("zone", X.home_zone(F.col("zone_priority")))
    if macro is None:
        return rows.withColumn("macro_ok", F.lit(True))
    return context.macro_at(rows, macro)


def exit_rule(sma: Column) -> Column:
    """First violated rule of a day after the trailing stop, or null."""
    return (
        F.when(F.col("bar_price") < sma, "TREND_BROKEN")
        .when(F.col("bar_mom_r2") < 0, "MOMENTUM_LOST")
        .when(~F.col("bar_sector_ok"), "SECTOR_WEAK")
        .when(~F.col("bar_macro_ok"), "MACRO_BEARISH")
    )


def exit_check(entries: DataFrame, state: DataFrame) -> DataFrame:
    """First exit of each entry (ticker, seq, sma_period) under the five rules.

    Precedence within a day: stop, trend, momentum, sector, macro.
    """
    path = state.select("ticker", "seq", "date", "price", F.col("atr_14").alias("atr"), "sma_150",
                        "sma_200", "mom_r2", "sector_ok", "macro_ok")
    rules = {n: exit_rule(F.col(f"bar_sma_{n}")) for n in (150, 200)}
    return first_exit(entries, path, ["ticker", "seq", "sma_period"], rules, by="sma_period")


def entry_terms(rows: DataFrame) -> DataFrame:
    """Entry range (2% of the price when unknown) and stop factor."""
    atr = F.coalesce("atr_14", F.col("price") * 0.02)
    return rows.withColumn("atr", atr).withColumn("k", X.adaptive_k(F.col("atr"), F.col("price")))


def screens(configs: list[Config]) -> list[tuple[int, float]]:
    """Distinct screens (mean period, least momentum) of the configurations: all that a score depends on."""
    return list(dict.fromkeys((c.sma_period, c.min_mom_r2) for c in configs))


def weekly_candidates(state: DataFrame, configs: list[Config], days: DataFrame) -> DataFrame:
    """Eligible tickers per screen and Monday of any configuration; rows grow with screens, not with configurations."""
    bars = state.withColumn("_next", F.lead("date").over(
        Window.partitionBy("ticker").orderBy("date")))
    limit = F.date_add("date", C.STALE_BAR_DAYS)
    last = F.least(limit, F.coalesce(F.date_sub("_next", 1), limit))
    # A bar covers at most six days, hence at most one Monday.
    monday = F.date_add(F.date_trunc("week", F.date_add("date", 6)).cast("date"), 0)
    bars = bars.withColumn("calc_date", monday).where(F.col("calc_date") <= last)
    passed = [F.when((F.col("price") > F.col(f"sma_{n}")) & (F.col("mom_r2") > least), F.struct(
        F.lit(i).alias("screen"), F.lit(n).alias("sma_period"))) for i, (n, least) in enumerate(screens(configs))]
    rows = bars.select("*", F.inline(F.array_compact(F.array(*passed))))
    own = days.where("is_monday").select(F.col("date").alias("calc_date")).distinct()
    return rows.join(own, "calc_date", "left_semi").select(
        "screen", "calc_date", "ticker", F.col("date").alias("row_date"), "seq", "price",
        "atr_14", "mom_r2", F.coalesce("rvol", F.lit(0.0)).alias("rvol"),
        F.coalesce("obv_slope", F.lit(0.0)).alias("obv_slope"), "sma_period",
        "sector", "zone_priority", "zone")


def hybrid_backtest(ind: DataFrame, configs: list[Config], instruments: DataFrame | None = None,
                    force: DataFrame | None = None, macro: DataFrame | None = None) -> Backtest:
    """Trades, weekly equity, weekly holdings and weekly log of every configuration."""
    spark = ind.sparkSession
    ship_package(spark)  # the fold runs in Python workers
    # One row per configuration, with the number of its screen.
    number = {screen: i for i, screen in enumerate(screens(configs))}
    grid = spark.createDataFrame([(c.config_id, number[c.sma_period, c.min_mom_r2], c.max_positions) for c in configs],
                                 "config_id string, screen int, max_positions int")
    # Read by several steps below: one row per sector, zone and day, and per zone and day.
    force = None if force is None else stage(force, "force")
    macro = None if macro is None else stage(macro, "macro")
    state = stage(market_state(ind, instruments, force, macro), "state")
    days = stage(timeline(state, configs), "days")
    rows = stage(weekly_candidates(state, configs, days), "weekly")
    # The ranking reads sector and macro state at the Monday, which may follow the row's own day.
    rows = ranking.sector_passes(rows, force, "calc_date").where("sector_ok").drop("sector_ok")
    rows = ranking.scored(rows, ["screen", "calc_date"])
    if macro is None:
        rows = rows.withColumn("macro_ok", F.lit(True))
    else:
        rows = context.macro_at(rows, macro, "calc_date")
    passing = stage(rows.where("macro_ok"), "passing")
    # Held tickers never exceed the used slots, so the first max_positions rows always suffice.
    most = max(c.max_positions for c in configs)
    best = top_per_group(passing, ["screen", "calc_date"], [F.col("score").desc(), F.col("ticker")], most, "place")
    best = stage(entry_terms(best.withColumn("has_bar", F.col("row_date") == F.col("calc_date"))),
                 "best")
    entries = best.where("has_bar").select("ticker", "seq", "sma_period", "price", "atr", "k").distinct()
    exits = stage(exit_check(entries, state), "found").select(
        "ticker", "seq", "sma_period", "exit_date", "exit_price", "exit_reason")
    # Days without a bar of the ticker cannot end a trade, nor days after the last Monday.
    bounds = days.groupBy("config_id").agg(
        F.max(F.when(F.col("is_monday"), F.col("date"))).alias("last_monday"),
        F.max("date").alias("last_date"))
    # Only now a row per configuration: the best of each of its Mondays.
    offered = best.join(exits, ["ticker", "seq", "sma_period"], "left") \
        .join(F.broadcast(grid.join(bounds, "config_id")), "screen").where(F.col("place") <= F.col("max_positions")) \
        .join(days.where("is_monday").select("config_id", F.col("date").alias("calc_date")), ["config_id", "calc_date"], "left_semi")
    in_time = F.col("exit_date") <= F.col("last_monday")
    offered = offered.select(
        "config_id", "max_positions", F.col("calc_date").alias("date"), "place", "ticker", "seq",
        "price", "k", "has_bar",
        *[F.when(in_time, F.col(c)).alias(c) for c in ("exit_date", "exit_price", "exit_reason")])
    mondays = days.where("is_monday").join(
        F.broadcast(grid.select("config_id", "max_positions")), "config_id") \
        .select("config_id", "max_positions", "date", F.lit(0).alias("place"))
    fold = stage(mondays.unionByName(offered, allowMissingColumns=True)
                 .groupBy("config_id").applyInPandas(fold_slots, FOLD_SCHEMA), "fold")
    closes = state.select("ticker", "date", "price")
    bought = fold.where("kind = 'trade'").join(F.broadcast(bounds), "config_id")
    ends = asof_join(bought, closes, ["ticker"], "last_date", "date", {"price": "last_price"})
    is_open = F.col("exit_date").isNull()
    end_price = F.when(is_open, F.col("last_price")).otherwise(F.col("exit_price"))
    end_date = F.when(is_open, F.col("last_date")).otherwise(F.col("exit_date"))
    trades = ends.select(
        "config_id", "ticker", F.col("date").alias("entry_date"), end_date.alias("exit_date"),
        F.coalesce("exit_reason", F.lit("END_OF_BACKTEST")).alias("exit_reason"),
        F.round("price", 2).alias("entry_price"), F.round(end_price, 2).alias("exit_price"),
        F.round("shares", 4).alias("shares"),
        F.round(F.col("shares") * (end_price - F.col("price")), 2).alias("pnl"),
        F.round((end_price - F.col("price")) / F.col("price") * 100, 2).alias("return_pct"),
        F.datediff(end_date, "date").alias("duration_days"), F.col("k").alias("k_used"))
    weeks = fold.where("kind = 'week'").select(
        "config_id", "date", "n_free", "n_bought", "n_positions", "cash")
    # One row per Monday a trade is held; a trade spans a bounded number of weeks.
    span = F.sequence("date", F.least(F.coalesce(F.date_sub("exit_date", 1), F.col("last_monday")),
                                      F.col("last_monday")), F.expr("INTERVAL 7 DAYS"))
    holdings = bought.withColumn("week", F.explode(span)).join(
        days.where("is_monday").select("config_id", F.col("date").alias("week")),
        ["config_id", "week"], "left_semi").select(
        "config_id", F.col("week").alias("date"), "ticker", "shares", F.col("date").alias("entry_date"))
    valued = asof_join(holdings, closes, ["ticker"], "date", "date", {"price": "price"})
    worth = valued.groupBy("config_id", "date").agg(F.sum(F.col("shares") * F.col("price")).alias("w"))
    equity = weeks.join(worth, ["config_id", "date"], "left").select(
        "config_id", "date", F.round(F.col("cash") + F.coalesce("w", F.lit(0.0)), 2).alias("value"),
        F.round("cash", 2).alias("cash"), "n_positions")
    # Eligible names at entry time: macro-passing ones less those held over from before.
    of_config = F.broadcast(grid.select("config_id", "screen"))
    size = passing.groupBy("screen", F.col("calc_date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    kept_over = holdings.where("entry_date < date").join(of_config, "config_id").join(
        passing.select("screen", F.col("calc_date").alias("date"), "ticker"),
        ["screen", "date", "ticker"], "left_semi") \
        .groupBy("config_id", "date").agg(F.count(F.lit(1)).alias("h"))
    log = weeks.join(of_config, "config_id").join(size, ["screen", "date"], "left").join(
        kept_over, ["config_id", "date"], "left").select(
        "config_id", "date",
        F.when(F.col("n_free") > 0, F.coalesce("n", F.lit(0)) - F.coalesce("h", F.lit(0)))
        .otherwise(0).alias("n_eligible"), "n_free", "n_bought")
    return Backtest(trades, equity, holdings, log)


def backtest_measures(result: Backtest) -> DataFrame:
    """All measures of every configuration in one row each."""
    last = result.equity.groupBy("config_id").agg(
        F.max_by("value", "date").alias("final_value"),
        F.avg("n_positions").alias("avg_positions_held"))
    frame = last.withColumn(
        "total_return_pct", (F.col("final_value") / C.CAPITAL - 1) * 100)
    for part in (measures.sharpe(result.equity, ["config_id"]),
                 measures.drawdown(result.equity, ["config_id"]),
                 measures.trade_measures(result.trades, ["config_id"])):
        frame = frame.join(part, "config_id", "left")
    frame = frame.fillna(0, ["n_trades", "win_rate_pct", "avg_win_pct", "avg_loss_pct",
                             "profit_factor", "avg_duration_days"])
    return frame.withColumns({
        "total_return_pct": F.round("total_return_pct", 2), "sharpe": F.round("sharpe", 3),
        "max_drawdown_pct": F.round("max_drawdown_pct", 2),
        "win_rate_pct": F.round("win_rate_pct", 1), "profit_factor": F.round("profit_factor", 2),
        "avg_duration_days": F.round("avg_duration_days", 1),
        "avg_positions_held": F.round("avg_positions_held", 1)})


def compare(measures_frame: DataFrame, configs: list[Config]) -> DataFrame:
    """Mark the configuration with the greatest Sharpe ratio, the first listed on a tie."""
    place = F.array_position(F.array(*[F.lit(c.config_id) for c in configs]), F.col("config_id"))
    best = measures_frame.agg(
        F.max_by("config_id", F.struct(F.col("sharpe"), -place)).alias("best"))
    return measures_frame.join(best).withColumn("is_best", F.col("config_id") == F.col("best")) \
        .drop("best")
