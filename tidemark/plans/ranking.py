"""Momentum ranking across the universe."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import constants as C
from tidemark.functions import indicators as I, scalars as X
from tidemark.operators.asof import asof_priority, latest_per_key
from tidemark.operators.ranking import min_max_scale, ranked_by_score, top_per_group
from tidemark.operators.upsert import replace_day
from tidemark.plans import context
from tidemark.session import stage
from tidemark.sources import landed as L

METRICS = list(C.SCORE_WEIGHTS)


def ranking_indicators(bars: DataFrame, min_history: int = C.MIN_HISTORY) -> DataFrame:
    """Trend, momentum, volume and range per bar of tickers with enough history."""
    price = F.col("price")
    b = L.bars_with_history(bars, min_history).withColumns({
        "price": F.col("adj_close"), "_vol": F.coalesce("volume", F.lit(0.0)),
    }).withColumns({
        "seq": I.row_number() - 1, **I.log_price(price),
        "_signed": I.signed_volume(price, F.col("_vol")),
        "_tr": I.true_range(F.col("high"), F.col("low"), price,
                            I.has_high_low(F.col("high"), F.col("low"))),
        "_roc": I.rate_of_change(price, skip_last=False),
    })
    b = b.withColumn("_changes", I.changes_so_far())
    ladder = I.price_ladder()
    b = ladder.build(b.select("ticker", "date", "seq", "price", "_vol", "_log", "_signed", "_tr", "_roc", "_changes"))
    b = b.select(
        "ticker", "date", "seq", "price",
        (ladder.total("p", 200) / 200.0).alias("sma_200"),
        (ladder.total("p", 150) / 150.0).alias("sma_150"),
        "_roc", *[c.alias(n) for n, c in I.trend_sums(ladder).items()],
        (F.col("_vol") / (I.rolling_mean(F.col("_vol"), C.VOLUME_WINDOW, 1) + C.EPSILON)).alias("rvol"),
        F.sum("_signed").over(I.running()).alias("_obv"),
        I.rolling_mean(F.col("_tr"), C.ATR_WINDOW, 1).alias("atr_14"))
    return b.select("ticker", "date", "seq", "price", "sma_200", "sma_150",
                    (F.col("_roc") * I.trend_fit()).alias("mom_r2"), "rvol",
                    I.change(F.col("_obv"), C.OBV_SLOPE_WINDOW).alias("obv_slope"), "atr_14")


def mondays(ind: DataFrame) -> DataFrame:
    """Trading Mondays of the universe."""
    return ind.select("date").where(F.weekday("date") == 0).distinct()


def eligible_rows(ind: DataFrame, dates: DataFrame | None, sma_period: int, min_mom_r2: float,
                  max_gap: int = C.STALE_BAR_DAYS) -> DataFrame:
    """Rows in an uptrend with momentum, once per ranking date they stand for.

    A bar stands for its own date and the following days up to the next bar, at most ``max_gap``
    days. That turns the as-of lookup into a plain equi-join on date: no pairs of dates and
    tickers are formed. ``dates=None`` means every bar's own date.
    """
    sma = F.col(f"sma_{sma_period}")
    rows = ind
    if dates is not None:
        rows = rows.withColumn("_next", F.lead("date").over(I.by_ticker()))
    rows = rows.where((F.col("price") > sma) & (F.col("mom_r2") > min_mom_r2)) \
        .withColumn("sma_value", sma)
    if dates is None:
        rows = rows.withColumn("calc_date", F.col("date"))
    else:
        limit = F.date_add("date", max_gap)
        last = F.least(limit, F.coalesce(F.date_sub("_next", 1), limit))
        rows = rows.withColumn("calc_date", F.explode(F.sequence("date", last))) \
            .join(dates.select(F.col("date").alias("calc_date")), "calc_date", "left_semi")
    return rows.select(
        "calc_date", "ticker", F.col("date").alias("row_date"), "seq", "price", "sma_value",
        "mom_r2", F.coalesce("rvol", F.lit(0.0)).alias("rvol"),
        F.coalesce("obv_slope", F.lit(0.0)).alias("obv_slope"),
        F.coalesce("atr_14", F.lit(0.0)).alias("atr_14"))


def with_sector(rows: DataFrame, instruments: DataFrame | None) -> DataFrame:
    if instruments is None:
        return rows.withColumn("sector", F.lit(None).cast("string")) \
            .withColumn("zone_priority", F.lit(None).cast("array<string>"))
    facts = instruments.where("sector IS NOT NULL").select("ticker", "sector", "zone_priority")
    return rows.join(facts, "ticker", "left")


def sector_passes(rows: DataFrame, force: DataFrame | None, on: str) -> DataFrame:
    """Add ``sector_ok``: no sector, no series or no value yet passes."""
    if force is None:
        return rows.withColumn("sector_ok", F.lit(True))
    return asof_priority(rows, force, "sector", "zone_priority", on, "in_force", out="sector_ok")


def scored(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Composite score from metrics scaled within each group."""
    scaled = min_max_scale(rows, groups, METRICS)
    score = sum((F.col(f"{m}_norm") * w for m, w in C.SCORE_WEIGHTS.items()), F.lit(0.0))
    return scaled.withColumn("score", score).drop(*[f"{m}_norm" for m in METRICS])


def candidates(ind: DataFrame, dates: DataFrame | None = None,
               instruments: DataFrame | None = None, force: DataFrame | None = None,
               sma_period: int = 200, min_mom_r2: float = 0.0) -> DataFrame:
    """Eligible tickers per date with their score, not ranked."""
    rows = eligible_rows(ind, dates, sma_period, min_mom_r2)
    rows = stage(with_sector(rows, instruments), "eligible")
    if force is not None:
        rows = sector_passes(rows, force, "calc_date").where("sector_ok").drop("sector_ok")
        rows = stage(rows, "passing")
    return scored(rows, ["calc_date"])


def score_candidates(ind: DataFrame, dates: DataFrame | None = None,
                     instruments: DataFrame | None = None, force: DataFrame | None = None,
                     sma_period: int = 200, min_mom_r2: float = 0.0,
                     top_n: int | None = None) -> DataFrame:
    """Ranked candidates for every date at once; ``top_n`` keeps the best per date."""
    rows = candidates(ind, dates, instruments, force, sma_period, min_mom_r2)
    if top_n is not None:
        return top_per_group(rows, ["calc_date"], [F.col("score").desc(), F.col("ticker")], top_n)
    return ranked_by_score(rows, ["calc_date"], "score", "ticker")


def daily_ranking(bars: DataFrame, instruments: DataFrame, force: DataFrame,
                  macro: DataFrame, calc_date: dt.date, top_n: int = 20) -> DataFrame:
    """Ranking at the newest bar date, in the layout it is stored in."""
    ind, macro = stage(ranking_indicators(bars), "ranking"), stage(macro, "macro")
    newest = ind.agg(F.max("date").alias("date"))
    rows = candidates(ind, newest, instruments, force)
    totals = rows.agg(F.count(F.lit(1)).cast("int").alias("n_eligible"))
    n_total = ind.select("ticker").distinct().agg(F.count(F.lit(1)).cast("int").alias("n_total"))
    best = top_per_group(rows, ["calc_date"], [F.col("score").desc(), F.col("ticker")], top_n)
    # One row per zone at the newest date, folded into a map; a handful of zones.
    zones = macro.select("zone").distinct().join(newest)
    regime = context.macro_at(zones, macro).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone", "macro_ok")))).alias("macro"))
    k = X.entry_k(F.col("atr_14"), F.col("price"))
    one_row = totals.join(n_total).join(regime)
    return best.join(one_row).select(
        F.lit(calc_date).alias("calc_date"), "rank", "ticker", F.round("score", 4).alias("score"),
        F.round("mom_r2", 4).alias("mom_r2"), F.round("rvol", 2).alias("rvol"),
        F.round("obv_slope", 2).alias("obv_slope"), F.round("price", 2).alias("price"),
        F.round("sma_value", 2).alias("sma_value"), F.round("atr_14", 2).alias("atr_14"),
        k.alias("k"), X.home_zone(F.col("zone_priority")).alias("zone"),
        F.coalesce("sector", F.lit("—")).alias("sector"), "macro", "n_eligible", "n_total",
        F.col("calc_date").alias("data_date"))


#: Layout of a stored daily ranking; its day is the folder's name.
STORED = ("rank int, ticker string, score double, mom_r2 double, rvol double, obv_slope double, price double, sma_value double, atr_14 double, "
          "k double, zone string, sector string, macro map<string,boolean>, n_eligible int, n_total int, data_date date, calc_date date")


def store_ranking(rows: DataFrame, path: str) -> None:
    """Replace the stored rankings of the days in ``rows``."""
    replace_day(rows, path, "calc_date")


def newest_stored(spark: SparkSession, path: str, top_n: int = 20) -> DataFrame:
    """Best rows of the newest stored day, which the folder's listing tells: one small folder is read, nothing is scanned.

    An empty table, or one that does not exist, has no rows.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = files.listStatus(folder) if files.exists(folder) else []
    days = [name for x in listed if (name := x.getPath().getName()).startswith("calc_date=")]
    if not days:
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).option("basePath", path).parquet(f"{path}/{max(days)}")
    return rows.orderBy("rank").limit(top_n)


def latest_ranking(rankings: DataFrame, top_n: int = 20) -> DataFrame:
    """Best rows of the newest stored ranking day."""
    newest = rankings.agg(F.max("calc_date").alias("calc_date"))
    return rankings.join(newest, "calc_date", "left_semi").orderBy("rank").limit(top_n)


def ticker_snapshot(bars: DataFrame, instruments: DataFrame, rankings: DataFrame | None = None,
                    tickers: DataFrame | None = None) -> DataFrame:
    """Last indicators, zone, sector, stop factor and current rank for any set of tickers."""
    rows = bars if tickers is None else bars.join(tickers.select("ticker"), "ticker", "left_semi")
    last = latest_per_key(ranking_indicators(rows), ["ticker"])
    facts = with_sector(last, instruments)
    if rankings is None:
        facts = facts.withColumn("rank", F.lit(None).cast("int"))
    else:
        newest = rankings.agg(F.max("calc_date").alias("calc_date"))
        current = rankings.join(newest, "calc_date", "left_semi").select("ticker", "rank")
        facts = facts.join(current, "ticker", "left")
    return facts.select(
        "ticker", "date", F.round("mom_r2", 4).alias("mom_r2"), F.round("rvol", 2).alias("rvol"),
        F.round("obv_slope", 2).alias("obv_slope"), F.round("price", 2).alias("price"),
        F.round("sma_200", 2).alias("sma_200"), F.round("atr_14", 2).alias("atr_14"),
        X.entry_k(F.col("atr_14"), F.col("price")).alias("k"),
        X.home_zone(F.col("zone_priority")).alias("zone"),
        F.coalesce("sector", F.lit("—")).alias("sector"), "rank")
