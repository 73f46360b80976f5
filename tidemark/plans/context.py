"""Market context: macro regime per zone, relative strength of sectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark import constants as C
from tidemark.functions import indicators as I
from tidemark.operators.asof import join_daily, latest_per_key, one_per_key


def series_of(key: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy("date")


def zone_prices(index_bars: DataFrame, zones: dict[str, str] | None = None) -> DataFrame:
    """Index bars of the zones' reference indices, with their zone."""
    zones = zones or C.ZONE_INDEX
    by_index = F.create_map(*[F.lit(x) for z, i in zones.items() for x in (i, z)])
    return index_bars.where(F.col("index_ticker").isin(*zones.values())) \
        .withColumn("zone", by_index[F.col("index_ticker")])


def macro_series(zone_bars: DataFrame, strict: bool = False) -> DataFrame:
    """(zone, date, price, sma_200, bull): index above its 200-day mean.

    During warm-up ``bull`` is false, or null when ``strict``.
    """
    known = zone_bars.where("adj_close IS NOT NULL").withColumn("row", I.row_number(series_of("zone")))
    series = known.select(
        "zone", "index_ticker", "date", F.col("adj_close").alias("price"),
        I.rolling_mean(F.col("adj_close"), 200, 200, F.col("row"), series_of("zone")).alias("sma_200"))
    above = F.col("price") > F.col("sma_200")
    return series.withColumn("bull", above if strict else F.coalesce(above, F.lit(False)))


def macro_status(zone_bars: DataFrame) -> DataFrame:
    """Newest state per zone with the distance to the mean in percent."""
    return latest_per_key(macro_series(zone_bars, strict=True), ["zone"]).withColumn(
        "pct_vs_sma", (F.col("price") - F.col("sma_200")) / F.nullif("sma_200", F.lit(0.0)) * 100)


def macro_at(points: DataFrame, series: DataFrame, on: str = "date") -> DataFrame:
    """``points`` (zone, ``on``, ...) with ``macro_ok``; a zone without a value yet passes."""
    return join_daily(points, series, ["zone"], on, {"bull": "macro_ok"}) \
        .withColumn("macro_ok", F.coalesce("macro_ok", F.lit(True)))


def join_index(etf_bars: DataFrame, sector_etf: DataFrame, index_bars: DataFrame) -> DataFrame:
    """Fund bars with their index's price on common dates."""
    funds = etf_bars.join(sector_etf.select("ticker_etf", "index_ticker"), "ticker_etf")
    prices = index_bars.select("index_ticker", "date", F.col("adj_close").alias("index_price"))
    return funds.join(prices, ["index_ticker", "date"])


def combine_history(history: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which an incoming row replaces the stored row of the same key."""
    tagged = history.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return one_per_key(tagged, keys, ["_new"]).drop("_new")


def sector_strength(etf_bars: DataFrame, sector_etf: DataFrame, index_bars: DataFrame,
                    incoming: DataFrame | None = None) -> DataFrame:
    """Fund against index, rebased at the first common date, and against its own 50-day mean.

    With ``incoming`` the means still cover the whole history and only the incoming dates return.
    """
    if incoming is None:
        bars = etf_bars
    else:
        fresh = incoming.select("ticker_etf", "date", F.lit(True).alias("_fresh"))
        bars = combine_history(etf_bars, incoming, ["ticker_etf", "date"]) \
            .join(fresh, ["ticker_etf", "date"], "left")
    joined = join_index(bars.where("adj_close > 0"), sector_etf, index_bars)
    first = I.running(series_of("ticker_etf"))
    rebased = joined.withColumn("row", I.row_number(series_of("ticker_etf"))).withColumn(
        "ratio",
        (F.col("adj_close") / F.first("adj_close").over(first))
        / (F.col("index_price") / F.first("index_price").over(first)))
    n = C.STRENGTH_WINDOW
    scored = rebased.withColumn("_ma", I.rolling_mean(F.col("ratio"), n, n, F.col("row"), series_of("ticker_etf"))) \
        .where("_ma IS NOT NULL").withColumn("ratio_vs_ma50", F.col("ratio") / F.col("_ma")) \
        .withColumn("in_force", F.col("ratio_vs_ma50") > 1.0)
    if incoming is not None:
        scored = scored.where("_fresh")
    return scored.select("ticker_etf", "date", "close", "adj_close", "volume", "index_price",
                         "ratio", "ratio_vs_ma50", "in_force")


def valid_strength(strength: DataFrame) -> DataFrame:
    """Rows with a real price and a real ratio."""
    def real(name: str) -> Column:
        return F.col(name).isNotNull() & ~F.isnan(name)
    return strength.where(real("adj_close") & real("ratio_vs_ma50"))


def force_series(strength: DataFrame, sector_etf: DataFrame, guard: bool = True) -> DataFrame:
    """(sector, zone, date, in_force); of several funds the first by ticker speaks."""
    rows = valid_strength(strength) if guard else strength
    active = rows.join(sector_etf.where("active").select("ticker_etf", "sector", "zone"), "ticker_etf")
    return active.groupBy("sector", "zone", "date").agg(
        F.min_by("in_force", "ticker_etf").alias("in_force"))


def chosen_zone(instruments: DataFrame, force: DataFrame, order: str = "zone_priority") -> DataFrame:
    """First zone of an instrument's list for which its sector has any value at all."""
    present = force.select("sector", "zone").distinct()
    return (
        instruments.select("ticker", "sector", F.posexplode(order).alias("pos", "zone"))
        .join(present, ["sector", "zone"])
        .groupBy("ticker").agg(F.min_by(F.struct("sector", "zone"), "pos").alias("c"))
        .select("ticker", "c.sector", "c.zone")
    )


def carried_force(bars: DataFrame, instruments: DataFrame, force: DataFrame,
                  order: str = "zone_priority") -> DataFrame:
    """Add ``force_rel`` to bars: the chosen zone's last value, false before its first one, true
    for tickers without any series."""
    zone = chosen_zone(instruments, force, order)
    tagged = bars.join(zone, "ticker", "left")
    found = join_daily(tagged, force, ["sector", "zone"], "date", {"in_force": "_force"})
    return found.withColumn(
        "force_rel",
        F.when(F.col("zone").isNull(), True).otherwise(F.coalesce("_force", F.lit(False)))
    ).select(*bars.columns, "force_rel")


def sectors_in_force(strength: DataFrame, sector_etf: DataFrame) -> DataFrame:
    """Active funds in force at their newest date."""
    newest = latest_per_key(strength, ["ticker_etf"])
    return newest.where("in_force").join(sector_etf.where("active"), "ticker_etf").select(
        "sector", "zone", "ticker_etf", "index_ticker", "date", "ratio", "ratio_vs_ma50", "in_force")


def sectors_dashboard(strength: DataFrame, sector_etf: DataFrame) -> DataFrame:
    """Every active fund with its newest state."""
    newest = latest_per_key(strength, ["ticker_etf"])
    return (
        sector_etf.where("active").join(newest, "ticker_etf", "left")
        .select("zone", "sector", "ticker_etf", "name", "date",
                F.round("ratio", 6).alias("ratio"), F.round("ratio_vs_ma50", 4).alias("ratio_vs_ma50"),
                "in_force",
                F.when(F.col("in_force"), "✅ En force").otherwise("❌ Hors force").alias("status"))
        .orderBy("zone", F.col("in_force").desc_nulls_first(),
                 F.col("ratio_vs_ma50").desc_nulls_first(), "ticker_etf")
    )


def sectors_by_zone(strength: DataFrame, sector_etf: DataFrame) -> DataFrame:
    return sectors_in_force(strength, sector_etf).groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_sectors"))
