"""Registered queries: each runs one operator or pipeline over the whole test tables.

Outputs show dates and lists as text and put derived numbers on a fixed grid, so that two engines
that add in another order agree.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark import constants as C
from tidemark.functions import indicators as I, scalars as X, text as TX
from tidemark.operators import asof, exits, ranking as R, upsert as U
from tidemark.plans import (analysis as A, context as K, learning as ML, measures as M,
                            opinions as O, portfolio as P, positions as POS, quality as Q,
                            ranking as RK, signals as SG)
from tidemark.session import new_path, stage
from tidemark.sources import landed as L, order_tables as V
from tidemark.streaming import ingest as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(fn(spark, sf_dir))
    QUERIES[fn.__name__] = run
    return run


def shown(df: DataFrame) -> DataFrame:
    """Dates as text, arrays joined, decimals as doubles."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd" if isinstance(f.dataType, T.DateType)
                              else "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def grid(column, digits: int = 6) -> Column:
    """Value cut to a decimal grid, with an offset that keeps exact halves off the boundary."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c * 10.0**digits + 0.37).cast("double") / 10.0**digits


def on_grid(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    out = []
    for f in df.schema.fields:
        wanted = f.name in only if only is not None else isinstance(f.dataType, T.DoubleType)
        out.append(grid(f.name, digits).alias(f.name) if wanted else F.col(f.name))
    return df.select(*out)


def last_day(spark: SparkSession, d: str) -> dt.date:
    return V.table(spark, d, "lineitem").agg(F.max(F.to_date("l_shipdate"))).first()[0]


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"price": F.col("adj_close"), "row": I.row_number()})


def strength(spark, d) -> DataFrame:
    return K.sector_strength(V.etf_bars(spark, d), V.sector_etf(spark, d), V.index_bars(spark, d))


def force(spark, d) -> DataFrame:
    return stage(K.force_series(strength(spark, d), V.sector_etf(spark, d)), "force")


def macro(spark, d) -> DataFrame:
    return K.macro_series(V.zone_index(spark, d))


def ind(spark, d) -> DataFrame:
    return RK.ranking_indicators(V.bars(spark, d))


def stored_ind(spark, d) -> DataFrame:
    """Indicators written once, for pipelines that read them several times."""
    return stage(ind(spark, d), "ind")


# ---- sources --------------------------------------------------------------------------------

@query
def landed_bars(spark, d):
    b = V.bars(spark, d)
    raw = b.select("ticker", F.col("date").cast("timestamp").alias("Date"), F.col("open").alias("Open"),
                   F.col("high").alias("High"), F.col("low").alias("Low"),
                   F.when(F.col("volume") % 7 != 0, F.col("close")).alias("('Close', 'X')"),
                   F.col("volume").alias("Volume"))
    return L.landed_bars(raw)


@query
def landed_index(spark, d):
    raw = V.index_bars(spark, d).withColumn(
        "adj_close", F.when(F.day("date") % 3 != 0, F.col("close") + 1))
    return L.landed_index(raw.withColumnRenamed("date", "Date"))


@query
def landed_etf(spark, d):
    day = F.day("date")
    raw = V.etf_bars(spark, d).withColumn("adj_close", F.when(day % 5 == 0, 0.0)
                                          .when(day % 7 == 0, -1.0).otherwise(F.col("close")))
    return L.landed_etf(raw)


@query
def landed_fx(spark, d):
    day = F.day("date")
    raw = V.fx_rates(spark, d).select("currency", F.col("date").alias("Date"), F.when(
        day % 4 == 0, None).when(day % 9 == 0, float("nan")).otherwise(F.col("rate_per_eur")).alias("Close"))
    return L.landed_fx(raw)


@query
def landed_instruments(spark, d):
    raw = V.instruments(spark, d).select(
        "ticker", F.col("name").alias("longName"),
        F.when(F.col("market_cap") % 3000 == 0, "").otherwise(F.lower("sector")).alias("sector"),
        "industry", "country", "currency", F.col("market_cap").alias("marketCap"),
        F.col("pe_ratio").alias("trailingPE"))
    return L.landed_instruments(raw, dt.date(2001, 1, 1))


@query
def universe(spark, d):
    return L.universe(V.instruments(spark, d), V.supplier_bars(spark, d))


@query
def fx_universe(spark, d):
    return L.fx_universe(V.instruments(spark, d))


@query
def tickers_with_history(spark, d):
    return L.tickers_with_history(V.supplier_bars(spark, d), 500)


@query
def valid_history_bars(spark, d):
    b = V.supplier_bars(spark, d).withColumn("adj_close", F.when(F.col("volume") % 5 == 0, None)
                                             .when(F.col("volume") % 7 == 0, 0.0)
                                             .when(F.col("volume") % 11 == 0, float("nan"))
                                             .otherwise(F.col("adj_close")))
    return L.bars_with_history(b, 320).select("ticker", "date", "adj_close")


@query
def incremental_slice(spark, d):
    path = new_path(spark, "bars")
    ST.create_table(V.bars(spark, d), path)
    # Of the stored table, months before the slice are pruned.
    return L.incremental_slice(spark.read.parquet(path), last_day(spark, d)).select("ticker", "date", "close")


@query
def landed_files(spark, d):
    """Bars that arrive as CSV under the vendor's headers, and as JSON: both become the engine's table."""
    vendor = V.bars(spark, d).select(F.col("ticker"), *[F.col(a).alias(b) for a, b in (
        ("date", "Date"), ("open", "Open"), ("high", "High"), ("low", "Low"), ("close", "Close"), ("volume", "Volume"))])
    csv, json = new_path(spark, "landed-csv"), new_path(spark, "landed-json")
    even = F.day("Date") % 2 == 0
    vendor.where(even).write.option("header", True).csv(csv)
    vendor.where(~even).write.json(json)
    layout = "ticker string, Date date, Open double, High double, Low double, Close double, Volume double"
    rows = L.landed_bars(L.read_table(spark, csv, layout, "csv", header="true"))
    return rows.unionByName(L.landed_bars(L.read_table(spark, json, layout, "json")))


# ---- sinks ----------------------------------------------------------------------------------

def split_months(spark, d) -> tuple[DataFrame, DataFrame]:
    """Stored bars without the last three months; an increment of the last four with the overlap
    corrected upwards."""
    b = V.bars(spark, d)
    end = last_day(spark, d).replace(day=1)
    cut = F.add_months(F.lit(end), -2)
    delta = b.where(F.col("date") >= F.add_months(F.lit(end), -3))
    bump = F.when(F.col("date") < cut, 1.0).otherwise(0.0)
    return b.where(F.col("date") < cut), delta.withColumns(
        {"close": F.col("close") + bump, "adj_close": F.col("adj_close") + bump})


@query
def upsert_bars(spark, d):
    base, delta = split_months(spark, d)
    return U.merge(base, delta, ["ticker", "date"]).select("ticker", "date", "close", "volume")


@query
def upsert_policy(spark, d):
    base = V.instruments(spark, d).drop("zone_priority")
    n = F.col("market_cap") / 1000
    same = base.where(n % 2 == 0).withColumns({
        "pe_ratio": F.col("pe_ratio") + 1, "market_cap": F.col("market_cap") + 5,
        "currency": F.lit("GBP"), "name": F.lit("renamed")})
    new = base.withColumns({"ticker": F.concat(F.lit("New"), "ticker"), "currency": F.lit("JPY")})
    delta = same.unionByName(new).withColumn("updated", F.lit(dt.date(2001, 1, 1)))
    policy = {"pe_ratio": "new", "market_cap": "new", "currency": "old_else_new", "updated": "new",
              "name": "insert_only", "sector": "insert_only", "industry": "insert_only",
              "country": "insert_only"}
    base = base.withColumn("currency", F.when(n % 3 != 0, F.col("currency")))
    return U.merge_with_policy(base, delta, ["ticker"], policy)


@query
def update_from(spark, d):
    b = V.bars(spark, d).select("ticker", "date", "open", "close", "volume")
    staged = b.where(F.day("date") % 2 == 0).select(
        "ticker", "date", F.lit(None).cast("double").alias("open"), (F.col("volume") * 2).alias("volume"))
    ghost = staged.withColumn("ticker", F.concat(F.lit("X"), "ticker"))
    return U.update_from(b, staged.unionByName(ghost), ["ticker", "date"])


@query
def insert_absent(spark, d):
    base = V.sector_etf(spark, d)
    rows = base.withColumn("name", F.lit("again")).unionByName(
        base.withColumns({"ticker_etf": F.concat(F.lit("N"), "ticker_etf"), "name": F.lit("new")}))
    return U.insert_absent(base, rows, ["ticker_etf"])


@query
def replace_day(spark, d):
    """Month-end reports of the five dearest tickers; the last year's are replaced by two."""
    b = V.bars(spark, d).select(F.col("date").alias("calc_date"), "ticker", "close")
    ends = b.groupBy(U.month_of("calc_date").alias("m")).agg(F.max("calc_date").alias("calc_date"))
    b = b.join(ends.select("calc_date"), "calc_date", "left_semi")
    top = stage(R.top_per_group(b, ["calc_date"], [F.col("close").desc(), F.col("ticker")], 5), "days")
    path = new_path(spark, "daily")
    U.replace_day(top, path, "calc_date")
    U.replace_day(top.where((F.year("calc_date") == last_day(spark, d).year) & (F.col("rank") <= 2)),
                  path, "calc_date")
    return spark.read.schema(top.schema).parquet(path)


@query
def upsert_opinions(spark, d):
    stored = V.opinions(spark, d)
    fresh = stored.where("type = 'ranking' AND rank % 2 = 0").withColumns({
        "conviction": F.lit("FORT"), "text": F.concat(F.lit("a\u0000b"), "ticker"),
        "generated_at": F.lit(None).cast("timestamp")})
    merged = O.upsert_opinions(stored, fresh, F.lit(dt.datetime(2002, 1, 1)))
    return merged.select("week", "ticker", "type", "rank", "conviction", "text", "generated_at")


@query
def backfill_type(spark, d):
    untyped = V.opinions(spark, d).withColumns({
        "was": F.col("type"), "type": F.when(F.col("rank") % 3 == 0, F.col("type")),
        "source": F.when(F.col("rank") % 4 != 0, F.col("source"))})
    return O.backfill_type(untyped).select("week", "ticker", "was", "type", "rank")


@query
def fill_high_low(spark, d):
    b = V.bars(spark, d)
    bare = b.withColumns({c: F.when(F.day("date") % 2 == 0, F.col(c)) for c in ("open", "high", "low")})
    staged = b.where(F.day("date") % 3 != 0).select("ticker", "date", "open", "high", "low")
    return U.update_from(bare, staged.dropna(subset=["high", "low"]), ["ticker", "date"]) \
        .select("ticker", "date", "open", "high", "low", "close")


@query
def stream_upsert(spark, d):
    base, delta = split_months(spark, d)
    table, landing = new_path(spark, "bars"), new_path(spark, "landing")
    ST.create_table(base, table)
    delta.repartition(3, "ticker").write.parquet(landing)
    ST.ingest_bars(spark, landing, table, new_path(spark, "offsets"), files_per_batch=2)
    return spark.read.parquet(table).select("ticker", "date", "close", "volume")


@query
def stream_tail(spark, d):
    base, delta = split_months(spark, d)
    bars_table, ind_table = new_path(spark, "bars"), new_path(spark, "indicators")
    landing = new_path(spark, "landing")
    ST.create_table(base, bars_table)
    ST.create_table(A.indicators(base).select("ticker", "date", *A.INDICATORS), ind_table)
    delta.coalesce(1).write.parquet(landing)
    ST.ingest_and_refresh(spark, landing, bars_table, ind_table, new_path(spark, "offsets"))
    # The whole table after the increment equals one that is computed anew.
    rows = spark.read.parquet(ind_table)
    return rows.select("ticker", "date", grid("rsi_14").alias("rsi_14"), grid("sma_200", 4).alias("sma_200"),
                       grid("atr_14", 4).alias("atr_14"), "regime")


# ---- filters and lookups --------------------------------------------------------------------

@query
def instrument_search(spark, d):
    return POS.search_instruments(V.instruments(spark, d), "r 1")


@query
def instrument_search_indexed(spark, d):
    path = new_path(spark, "grams")
    POS.index_instruments(V.instruments(spark, d), path)
    return POS.search_indexed(spark, path, "r 1").unionByName(POS.search_indexed(spark, path, "brand#23"))


def ledger_columns(rows: DataFrame) -> DataFrame:
    return rows.select("id", "ticker", "portfolio_id", "buy_date", "sell_date", "invested", "result", "result_pct", "status")


@query
def positions_list_all(spark, d):
    return ledger_columns(POS.list_positions(V.positions(spark, d)))


@query
def positions_list_open(spark, d):
    return ledger_columns(POS.list_positions(V.positions(spark, d), "open"))


@query
def positions_of_portfolio(spark, d):
    return ledger_columns(POS.list_positions(V.positions(spark, d), "closed", 7))


@query
def positions_list(spark, d):
    return POS.list_positions(V.positions(spark, d), "closed").select(
        "id", "ticker", "buy_date", "sell_date", "invested", "result", "result_pct", "sell_reason")


@query
def position_counts(spark, d):
    return POS.position_counts(V.positions(spark, d))


@query
def opinions_all(spark, d):
    return O.select_opinions(V.opinions(spark, d), everything=True).select(
        "week", "ticker", "type", "rank", "conviction")


@query
def opinions_latest_week(spark, d):
    return O.select_opinions(V.opinions(spark, d), kind="ranking").select(
        "week", "ticker", "type", "rank", "conviction")


@query
def opinion_of_ticker(spark, d):
    o = V.opinions(spark, d).withColumn("ticker", F.upper("ticker"))
    return O.select_opinions(o, ticker="brand#7").select("week", "ticker", "type", "conviction")


def middle_week(spark, d) -> dt.date:
    """Week half-way through the opinions, by its place among the weeks."""
    weeks = V.opinions(spark, d).select("week").distinct()
    place = weeks.withColumn("_p", F.percent_rank().over(Window.orderBy("week")))
    return place.where("_p >= 0.5").agg(F.min("week")).first()[0]


@query
def opinions_of_week(spark, d):
    return O.select_opinions(V.opinions(spark, d), week=middle_week(spark, d)).select("week", "ticker", "type", "rank", "conviction")


@query
def opinions_of_week_ticker(spark, d):
    o = V.opinions(spark, d).withColumn("ticker", F.upper("ticker"))
    return O.select_opinions(o, week=middle_week(spark, d), ticker="brand#7").select("week", "ticker", "type", "rank", "conviction")


@query
def opinion_latest7d(spark, d):
    o = V.opinions(spark, d)
    end = o.agg(F.max(F.to_date("generated_at"))).first()[0]
    return O.recent_opinions(o, end).select("week", "ticker", "conviction", "rank")


@query
def opinion_detail(spark, d):
    rows = forward(spark, d)
    return on_grid(O.opinion_detail(rows, "ranking", versions=["v0", "v1", "—"], models=["m0"],
                                    need_return=True))


@query
def instrument_zones(spark, d):
    n = F.col("p_partkey") % 6
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("", ".KS", ".KQ", ".DE", ".ST", ".TO")]),
                          (n + 1).cast("int"))
    country = F.element_at(F.array(*[F.lit(s) for s in ("Ireland", "Belgium", "France", "Canada")]),
                           (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = V.table(spark, d, "part").select(
        F.concat(F.lit("P"), "p_partkey", suffix).alias("ticker"), country.alias("country"),
        F.when(F.col("p_size") % 5 == 0, "USD").alias("currency"))
    pri = X.zone_priority(F.col("ticker"), F.col("country"))
    return rows.select(
        "ticker", pri.alias("zones"), X.home_zone(pri).alias("zone"),
        X.zone_priority(F.col("ticker"), F.col("country"), by_country_only=True).alias("zones_by_country"),
        X.quote_currency(F.col("ticker"), F.col("currency")).alias("quote"))


@query
def strength_valid(spark, d):
    s = strength(spark, d).withColumns({
        "adj_close": F.when(F.day("date") % 6 == 0, float("nan")).otherwise(F.col("adj_close")),
        "ratio_vs_ma50": F.when(F.day("date") % 8 == 0, None).otherwise(F.col("ratio_vs_ma50"))})
    return K.valid_strength(s).select("ticker_etf", "date", "adj_close", "in_force")


@query
def event_validation(spark, d):
    e = POS.check_events(V.position_events(spark, d), V.positions(spark, d), V.portfolios(spark, d),
                         upper_instruments(spark, d), upper_bars(spark, d))
    return e.select("event_id", "kind", "reject_reasons")


def upper_instruments(spark, d):
    """Instruments under the spelling position events use."""
    return V.instruments(spark, d).withColumn("ticker", F.concat(
        F.lit("BRAND-"), F.substring("ticker", 7, 10)))


def upper_bars(spark, d):
    return V.bars(spark, d).withColumn("ticker", F.concat(F.lit("BRAND-"), F.substring("ticker", 7, 10)))


# ---- joins ----------------------------------------------------------------------------------

@query
def etf_index_join(spark, d):
    return K.join_index(V.etf_bars(spark, d), V.sector_etf(spark, d), V.index_bars(spark, d)).select(
        "ticker_etf", "index_ticker", "date", "adj_close", "index_price")


@query
def latest_bar(spark, d):
    return asof.latest_per_key(V.supplier_bars(spark, d), ["ticker"]).select(
        "ticker", "date", "close", "volume")


@query
def asof_fx(spark, d):
    p = V.positions(spark, d).select("id", F.col("quote_currency").alias("currency"), "buy_date")
    return asof.join_daily(p, V.fx_rates(spark, d).withColumn("rate_date", F.col("date")),
                           ["currency"], "buy_date", {"rate_per_eur": "rate", "rate_date": "rate_date"})


@query
def asof_tolerance(spark, d):
    o = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).cast("string").alias("ticker"),
        F.to_date("o_orderdate").alias("day"))
    b = V.supplier_bars(spark, d).select("ticker", "date", "close", F.col("date").alias("bar_date"))
    return asof.asof_join(o, b, ["ticker"], "day", "date", {"close": "close", "bar_date": "bar_date"},
                          tolerance_days=C.STALE_BAR_DAYS)


@query
def monday_rows(spark, d):
    i = stored_ind(spark, d)
    return RK.eligible_rows(i, RK.mondays(i), 200, 0.0).select(
        "calc_date", "ticker", "row_date", "price")


@query
def sector_ffill(spark, d):
    return K.carried_force(V.bars(spark, d).select("ticker", "date", "close"), V.instruments(spark, d),
                           force(spark, d))


@query
def sector_zone_choice(spark, d):
    return K.chosen_zone(V.instruments(spark, d), force(spark, d))


@query
def sector_force_priority(spark, d):
    rows = V.bars(spark, d).select("ticker", "date").join(
        V.instruments(spark, d).select("ticker", "sector", "zone_priority"), "ticker", "left")
    return asof.asof_priority(rows, force(spark, d), "sector", "zone_priority", "date", "in_force") \
        .select("ticker", "date", "in_force")


@query
def signal_result_j10(spark, d):
    return Q.update_results(V.signal_log(spark, d), V.bars(spark, d), last_day(spark, d)).select(
        "id", "ticker", "date", "price_j0", "price_j10", grid("result_pct", 1).alias("result_pct"))


@query
def portfolio_counts(spark, d):
    return POS.portfolio_counts(V.portfolios(spark, d), V.positions(spark, d))


def state(spark, d) -> DataFrame:
    return P.market_state(stored_ind(spark, d), V.instruments(spark, d), force(spark, d), macro(spark, d))


@query
def exit_check(spark, d):
    s = stage(state(spark, d), "state")
    every = None
    for period in (200, 150):  # every eligible ticker of every Monday, whatever its rank
        rows = RK.eligible_rows(s, RK.mondays(s), period, 0.0).where("row_date = calc_date")
        rows = P.entry_terms(rows).select("ticker", "seq", F.lit(period).alias("sma_period"), "price", "atr", "k").distinct()
        every = rows if every is None else every.unionByName(rows)
    return P.exit_check(every, s).select(
        "ticker", "seq", "sma_period", grid("k", 2).alias("k"), "exit_seq", "exit_date", "exit_price", "exit_reason")


# ---- aggregates -----------------------------------------------------------------------------

@query
def stale_tickers(spark, d):
    return Q.stale_tickers(V.supplier_bars(spark, d), last_day(spark, d))


@query
def missing_tickers(spark, d):
    wanted = V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("ticker"))
    return Q.missing_tickers(wanted, V.supplier_bars(spark, d))


@query
def profile(spark, d):
    log = Q.update_results(V.signal_log(spark, d), V.bars(spark, d), last_day(spark, d))
    return Q.profile(log, "signal_log").unionByName(
        Q.profile(V.table(spark, d, "lineitem"), "lineitem")).select(
        "table", "position", "column", "n_rows", "n_null", grid("null_pct", 4).alias("null_pct"))


@query
def system_health(spark, d):
    log = Q.update_results(V.signal_log(spark, d), V.bars(spark, d), last_day(spark, d))
    end = log.agg(F.max("date")).first()[0]
    return Q.system_health(log, end, 30)


@query
def label_share(spark, d):
    return ML.label_share(ML.label(V.bars(spark, d)))


@query
def lot_concentration(spark, d):
    o = V.opinions(spark, d).where("type = 'ranking'").select(F.col("week").alias("lot"), "ticker")
    i = V.instruments(spark, d).withColumn("sector", F.when(F.col("market_cap") % 4000 != 0, F.col("sector")))
    return O.lot_concentration(o.join(i.select("ticker", "sector"), "ticker", "left"))


def forward(spark, d, types=("ranking",)) -> DataFrame:
    return O.forward_returns(V.opinions(spark, d), V.bars(spark, d), last_day(spark, d), types)


@query
def forward_returns(spark, d):
    return on_grid(forward(spark, d).select("week", "ticker", "type", *[
        f"{k}_{h}" for k in ("price", "return") for h in C.HORIZON_DAYS]))


@query
def opinion_perf(spark, d):
    return on_grid(O.performance_by_conviction(forward(spark, d)))


@query
def opinion_perf_version(spark, d):
    return on_grid(O.performance_by_version(forward(spark, d)))


@query
def opinion_perf_position(spark, d):
    return on_grid(O.position_performance(forward(spark, d, ("ranking", "position"))))


@query
def opinion_coverage(spark, d):
    return O.coverage(forward(spark, d))


@query
def closed_summary(spark, d):
    return POS.closed_summary(V.positions(spark, d))


def closed_trades(spark, d) -> DataFrame:
    """Closed positions in the layout of backtest trades."""
    rows = POS.with_amounts(V.positions(spark, d)).where(F.col("status") == C.CLOSED)
    return rows.select("portfolio_id", "ticker", F.col("sell_reason").alias("exit_reason"),
                       F.col("result_pct").cast("double").alias("return_pct"),
                       F.datediff("sell_date", "buy_date").alias("duration_days"))


@query
def exit_reason_stats(spark, d):
    return on_grid(M.exit_reasons(closed_trades(spark, d), ["portfolio_id"]), 5)


@query
def trade_measures(spark, d):
    return M.trade_measures(closed_trades(spark, d), ["ticker"]).select(
        "ticker", "n_trades", grid("win_rate_pct", 4).alias("win_rate_pct"), grid("avg_win_pct", 2).alias("avg_win_pct"),
        grid("avg_loss_pct", 2).alias("avg_loss_pct"), grid("profit_factor", 4).alias("profit_factor"),
        grid("avg_duration_days", 4).alias("avg_duration_days"))


def index_equity(spark, d) -> DataFrame:
    """Last index close of each week."""
    b = V.index_bars(spark, d)
    return b.groupBy("index_ticker", F.date_trunc("week", "date").cast("date").alias("week")).agg(
        F.max_by("close", "date").alias("value")).withColumnRenamed("week", "date")


@query
def sharpe_weekly(spark, d):
    return on_grid(M.sharpe(index_equity(spark, d), ["index_ticker"]))


@query
def drawdown(spark, d):
    return on_grid(M.drawdown(index_equity(spark, d), ["index_ticker"]))


@query
def weeks_held(spark, d):
    return M.weeks_held(hybrid(spark, d, [P.Config("base", 5)]).holdings, ["config_id"], 20)


@query
def conviction_counts(spark, d):
    o = V.opinions(spark, d)
    end = o.agg(F.max(F.to_date("generated_at"))).first()[0]
    return O.conviction_counts(O.recent_opinions(o, end))


@query
def sector_counts(spark, d):
    return K.sectors_by_zone(strength(spark, d), V.sector_etf(spark, d))


# ---- indicators -----------------------------------------------------------------------------

@query
def sma(spark, d):
    b = numbered(V.bars(spark, d))
    p, r = F.col("price"), F.col("row")
    return b.select("ticker", "date", *[
        grid(I.rolling_mean(p, n, n, r), 4).alias(f"sma_{n}") for n in (20, 50, 150, 200)],
        grid(I.rolling_mean(p, 200, 1), 4).alias("sma_200_open"))


@query
def rsi14(spark, d):
    g, l = I.gain_loss(F.col("price"))
    b = numbered(V.bars(spark, d)).withColumns({"g": g, "l": l})
    b = b.withColumn("rsi_14", I.rsi_of(F.col("g"), F.col("l"), F.col("row")))
    return on_grid(b.select("ticker", "date", "rsi_14", I.change(F.col("rsi_14"), 3).alias("rsi_slope")))


@query
def bollinger(spark, d):
    b = numbered(V.bars(spark, d))
    low, pos = I.bollinger(F.col("price"), F.col("row"))
    return b.select("ticker", "date", grid(low, 2).alias("bb_lower"), grid(pos).alias("bb_position"))


@query
def atr14(spark, d):
    b = numbered(V.bars(spark, d)).withColumns({c: F.when(F.substring("ticker", 7, 10).cast("int") % 5 != 0,
                                                          F.col(c)) for c in ("high", "low")})
    b = b.withColumn("tr", I.true_range(F.col("high"), F.col("low"), F.col("price"),
                                        I.has_high_low(F.col("high"), F.col("low"))))
    return b.select("ticker", "date", grid(I.rolling_mean(F.col("tr"), 14, 1), 3).alias("atr_14"))


@query
def rvol(spark, d):
    b = V.bars(spark, d).withColumn("volume", F.when(F.day("date") % 9 != 0, F.col("volume")))
    full = I.rolling_mean(F.col("volume"), 20)
    v = F.coalesce("volume", F.lit(0.0))
    return b.select("ticker", "date", grid(F.col("volume") / (full + C.EPSILON)).alias("vol_ratio"),
                    grid(v / (I.rolling_mean(v, 20, 1) + C.EPSILON)).alias("rvol"))


@query
def obv_slope(spark, d):
    b = V.bars(spark, d).withColumn("signed", I.signed_volume(F.col("adj_close"), F.col("volume")))
    b = b.withColumn("obv", F.sum("signed").over(I.running()))
    return b.select("ticker", "date", "obv", I.change(F.col("obv"), 10).alias("obv_slope"))


@query
def breakout50(spark, d):
    p = F.col("adj_close")
    return V.bars(spark, d).select("ticker", "date", (p >= F.max(p).over(I.trailing(50))).alias("breakout"))


@query
def regime(spark, d):
    b = V.bars(spark, d).withColumn("sma_50", I.rolling_mean(F.col("adj_close"), 50, 1))
    return b.select("ticker", "date", I.regime(F.col("adj_close"), F.col("sma_50")).alias("regime"))


@query
def momentum_r2(spark, d):
    return ind(spark, d).select("ticker", "date", grid("mom_r2").alias("mom_r2"))


@query
def momentum_r2_lagged(spark, d):
    return SG.raw_signals(V.bars(spark, d)).select("ticker", "date", grid("mom_r2").alias("mom_r2"))


@query
def label10(spark, d):
    return ML.label(V.bars(spark, d)).select("ticker", "date", "target")


@query
def macro_regime(spark, d):
    return macro(spark, d).select("zone", "date", "price", grid("sma_200", 4).alias("sma_200"), "bull")


@query
def macro_status(spark, d):
    return K.macro_status(V.zone_index(spark, d)).select(
        "zone", "date", "price", grid("sma_200", 4).alias("sma_200"), "bull",
        grid("pct_vs_sma").alias("pct_vs_sma"))


@query
def sector_strength(spark, d):
    return strength(spark, d).select("ticker_etf", "date", grid("ratio").alias("ratio"),
                                     grid("ratio_vs_ma50").alias("ratio_vs_ma50"), "in_force")


@query
def sector_strength_increment(spark, d):
    b = V.etf_bars(spark, d)
    newest = V.index_bars(spark, d).agg(F.max("date")).first()[0]
    cut = F.lit(newest.replace(day=1))
    stored, fresh = b.where(F.col("date") < cut), b.where(F.col("date") >= F.add_months(cut, -1)) \
        .withColumn("adj_close", F.col("adj_close") + 1)
    s = K.sector_strength(stored, V.sector_etf(spark, d), V.index_bars(spark, d), fresh)
    return s.select("ticker_etf", "date", "adj_close", grid("ratio_vs_ma50").alias("ratio_vs_ma50"), "in_force")


@query
def sectors_in_force(spark, d):
    return on_grid(K.sectors_in_force(strength(spark, d), V.sector_etf(spark, d)))


@query
def sectors_dashboard(spark, d):
    return K.sectors_dashboard(strength(spark, d), V.sector_etf(spark, d)).select(
        "zone", "sector", "ticker_etf", "name", "date", grid("ratio", 5).alias("ratio"), "in_force", "status")


# ---- analysis and ranking -------------------------------------------------------------------

def analysis_columns(rows: DataFrame) -> DataFrame:
    wide = {"sma_200": 4, "sma_50": 4, "bb_lower": 2, "vol_avg_20": 4, "atr_14": 3}
    return rows.select(
        "ticker", "date", *[grid(c, wide.get(c, 6)).alias(c) for c in A.INDICATORS if c != "regime"],
        "regime", "sector", "pe_ratio")


@query
def analysis_indicators(spark, d):
    return analysis_columns(A.analysis(V.bars(spark, d), V.instruments(spark, d)))


@query
def analysis_incremental(spark, d):
    return analysis_columns(A.analysis(V.bars(spark, d), V.instruments(spark, d), last_day(spark, d)))


@query
def nightly_analysis(spark, d):
    """Stored indicators, those of the last forty days missing; the nightly job fills in the newest days."""
    day = last_day(spark, d)
    bars_table, table = new_path(spark, "bars"), new_path(spark, "indicators")
    bars = V.bars(spark, d)
    ST.create_table(bars, bars_table)
    late = F.col("date") > F.lit(day - dt.timedelta(days=40))
    ST.create_table(A.indicators(bars).select("ticker", "date", *[F.when(~late, F.col(c)).alias(c) for c in A.INDICATORS]), table)
    A.nightly(spark, bars_table, table, day)
    return spark.read.parquet(table).select(
        "ticker", "date", grid("rsi_14").alias("rsi_14"), grid("sma_200", 4).alias("sma_200"),
        grid("vol_ratio").alias("vol_ratio"), grid("atr_14", 3).alias("atr_14"), "regime")


@query
def ranking_indicators(spark, d):
    return ind(spark, d).select(
        "ticker", "date", "seq", "price", grid("sma_200", 4).alias("sma_200"),
        grid("sma_150", 4).alias("sma_150"), grid("mom_r2").alias("mom_r2"), grid("rvol").alias("rvol"),
        "obv_slope", grid("atr_14", 3).alias("atr_14"))


@query
def adaptive_k(spark, d):
    return V.bars(spark, d).select("ticker", "date", grid(X.adaptive_k(
        F.col("high") - F.col("low"), F.col("close")), 2).alias("k"))


@query
def composite_ranking(spark, d):
    i = stored_ind(spark, d)
    rows = RK.score_candidates(i, RK.mondays(i), V.instruments(spark, d), force(spark, d))
    return rows.select("calc_date", "rank", "ticker", grid("score").alias("score"), "sector")


@query
def eligible_daily(spark, d):
    rows = RK.score_candidates(ind(spark, d), None, sma_period=150, min_mom_r2=0.01, top_n=10)
    return rows.select("calc_date", "rank", "ticker", grid("score").alias("score"))


def stored_ranking(spark, d) -> DataFrame:
    """Top three of every Monday with their day, as stored."""
    i = stored_ind(spark, d)
    return RK.score_candidates(i, RK.mondays(i), top_n=3)


@query
def daily_ranking(spark, d):
    out = RK.daily_ranking(V.bars(spark, d), V.instruments(spark, d), force(spark, d), macro(spark, d),
                           dt.date(2002, 1, 1))
    flat = F.array_join(F.transform(F.map_entries("macro"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select(
        "calc_date", "rank", "ticker", grid("score", 3).alias("score"), grid("mom_r2", 3).alias("mom_r2"),
        "zone", "sector", flat.alias("macro"), "n_eligible", "n_total", "data_date")


@query
def ranking_stored_latest(spark, d):
    """The day's ranking stored in place of an earlier run, beside an older day, and read back from the listing."""
    path = new_path(spark, "rankings")
    rows = stage(RK.daily_ranking(V.bars(spark, d), V.instruments(spark, d), force(spark, d), macro(spark, d),
                                  dt.date(2002, 1, 1)), "daily")
    RK.store_ranking(rows.withColumn("calc_date", F.lit(dt.date(2001, 12, 31))), path)
    RK.store_ranking(rows.withColumn("rank", F.col("rank") + 100), path)
    RK.store_ranking(rows, path)
    return RK.newest_stored(spark, path).select(
        "calc_date", "rank", "ticker", grid("score", 3).alias("score"), grid("mom_r2", 3).alias("mom_r2"),
        "zone", "sector", "n_eligible", "n_total", "data_date")


@query
def latest_ranking(spark, d):
    return RK.latest_ranking(stored_ranking(spark, d), 2).select(
        "calc_date", "rank", "ticker", grid("score").alias("score"))


@query
def ticker_snapshot(spark, d):
    out = RK.ticker_snapshot(V.bars(spark, d), V.instruments(spark, d), stored_ranking(spark, d))
    return out.select("ticker", "date", grid("mom_r2", 3).alias("mom_r2"), grid("rvol", 1).alias("rvol"),
                      "obv_slope", "price", grid("k", 1).alias("k"), "zone", "sector", "rank")


@query
def quant_diagnosis(spark, d):
    return O.quant_diagnosis(ind(spark, d)).select(
        "ticker", "date", grid("pct_vs_sma", 4).alias("pct_vs_sma"), "trend_light", "momentum_light",
        "volume_light", "accumulation_light", "has_momentum_data")


# ---- signals --------------------------------------------------------------------------------

def breakout_rows(spark, d, bars: DataFrame | None = None) -> DataFrame:
    """Indicators whose signal is a breakout with rising volume, so that trades are plenty."""
    rows = SG.raw_signals(V.bars(spark, d) if bars is None else bars, V.instruments(spark, d), force(spark, d))
    rows = stage(rows.withColumn("signal_raw", F.col("breakout") & F.col("rvol_high")), "signals")
    kept = exits.cool_down(rows.where("signal_raw").select("ticker", "seq")).withColumn("k_", F.lit(True))
    return rows.join(kept, ["ticker", "seq"], "left").withColumn(
        "signal", F.coalesce("k_", F.lit(False))).drop("k_")


@query
def signals_v35(spark, d):
    return SG.signals(V.bars(spark, d), V.instruments(spark, d), force(spark, d)).select(
        "ticker", "date", "trend_ok", "force_rel", "breakout", "rvol_high", "obv_rising", "signal_raw",
        "signal")


@query
def cooldown(spark, d):
    rows = SG.raw_signals(V.bars(spark, d))
    return exits.cool_down(rows.where("rvol_high").select("ticker", "seq"))


@query
def chandelier_exits(spark, d):
    return SG.exits_by_k(breakout_rows(spark, d)).select(
        "ticker", "seq", "k", "entry_date", "exit_seq", "exit_date", "exit_price")


@query
def signal_trades(spark, d):
    return SG.signal_trades(stage(SG.exits_by_k(breakout_rows(spark, d)), "exits")).select(
        "ticker", "k", "seq", "exit_seq", "exit_price")


@query
def trade_detail(spark, d):
    rows = breakout_rows(spark, d)
    ex = stage(SG.exits_by_k(rows, (2.0,)), "exits")
    return SG.trade_detail(rows, ex).select(
        "ticker", "k", "entry_date", "exit_date", "duration_days", "entry_price", "exit_price",
        grid("return_pct", 1).alias("return_pct"), "outcome", "price_later", "force_rel")


@query
def signal_outcomes(spark, d):
    return on_grid(SG.signal_outcomes(breakout_rows(spark, d)), 4)


def sweep(spark, d) -> DataFrame:
    return SG.backtest(breakout_rows(spark, d))


@query
def signal_backtest(spark, d):
    return sweep(spark, d).select(
        "ticker", "k", grid("sharpe", 2).alias("sharpe"), grid("total_return_pct", 4).alias("total_return_pct"),
        grid("max_drawdown_pct", 4).alias("max_drawdown_pct"), "n_trades",
        grid("win_rate_pct", 4).alias("win_rate_pct"), grid("avg_win_pct", 4).alias("avg_win_pct"), "ok", "outcome")


@query
def backtest_admission(spark, d):
    """Suppliers' histories of the last 1,400 days: those under 302 rows are refused."""
    recent = V.supplier_bars(spark, d).where(F.col("date") >= F.lit(last_day(spark, d) - dt.timedelta(days=1400)))
    return SG.admitted(L.valid_bars(recent))


@query
def best_k(spark, d):
    return SG.best_k(sweep(spark, d)).select("ticker", "best_k", grid("best_sharpe", 2).alias("best_sharpe"))


@query
def k_sweep(spark, d):
    return SG.sweep_summary(sweep(spark, d)).select(
        "k", grid("sharpe_mean", 2).alias("sharpe_mean"), "n_ok", "n_tickers", "is_best", "validated")


# ---- portfolio backtest ---------------------------------------------------------------------

def hybrid(spark, d, configs) -> P.Backtest:
    return P.hybrid_backtest(stored_ind(spark, d), configs, V.instruments(spark, d), force(spark, d),
                             macro(spark, d))


@query
def hybrid_trades(spark, d):
    return hybrid(spark, d, [P.Config("base", 5)]).trades


@query
def hybrid_equity(spark, d):
    return hybrid(spark, d, [P.Config("base", 5)]).equity


@query
def hybrid_weeks(spark, d):
    return hybrid(spark, d, [P.Config("base", 5)]).weeks


@query
def hybrid_metrics(spark, d):
    return P.backtest_measures(hybrid(spark, d, [P.Config("base", 5)]))


@query
def hybrid_exit_reasons(spark, d):
    return on_grid(M.exit_reasons(hybrid(spark, d, [P.Config("base", 5)]).trades, ["config_id"]))


@query
def config_compare(spark, d):
    configs = P.sma_compare() + P.momentum_compare()
    return P.compare(P.backtest_measures(hybrid(spark, d, configs)), configs)


# ---- positions ------------------------------------------------------------------------------

@query
def positions_computed(spark, d):
    return POS.with_amounts(V.positions(spark, d)).select("id", "invested", "result", "result_pct")


@query
def positions_open(spark, d):
    b = V.bars(spark, d)
    rsi = A.indicators(b).select("ticker", "date", "rsi_14")
    out = POS.open_positions(V.positions(spark, d), b, rsi, last_day(spark, d))
    return out.withColumn("rsi_14", grid("rsi_14"))


def evaluated(spark, d) -> DataFrame:
    fx = V.fx_rates(spark, d)
    return POS.evaluate_positions(V.positions(spark, d), stored_ind(spark, d),
                                  V.instruments(spark, d), force(spark, d), macro(spark, d), fx)


@query
def position_eval(spark, d):
    e = evaluated(spark, d)
    return e.select(
        "id", "ticker", "data_date", grid("k", 2).alias("k"), grid("stop", 2).alias("stop"), "max_price",
        grid("pnl_pct", 2).alias("pnl_pct"), grid("pnl_quote", 2).alias("pnl_quote"),
        grid("value_eur", 2).alias("value_eur"), grid("pnl_eur", 2).alias("pnl_eur"), "days_held",
        *[c for c in e.columns if c.startswith("c_")], "violated", "warnings", "alert")


@query
def evaluation_rollup(spark, d):
    return POS.evaluation_summary(evaluated(spark, d))


@query
def position_events(spark, d):
    out = POS.apply_position_events(
        V.positions(spark, d), V.position_events(spark, d), V.portfolios(spark, d),
        upper_instruments(spark, d), upper_bars(spark, d), V.fx_rates(spark, d))
    return out.select("id", "ticker", "buy_date", grid("buy_price", 3).alias("buy_price"), "quantity",
                      "status", "sell_date", grid("sell_price", 3).alias("sell_price"), "sell_reason",
                      "portfolio_id", "quote_currency", "txn_price", "txn_currency")


# ---- opinions -------------------------------------------------------------------------------

@query
def last_opinion(spark, d):
    rows = forward(spark, d).where("type = 'ranking'")
    return on_grid(O.last_opinion(rows).select(
        "week", "ticker", "conviction", "prev_week", "prev_conviction", "prev_return"))


@query
def extract_sections(spark, d):
    return O.extract_batch_opinions(V.opinion_batches(spark, d)).select(
        "batch_id", "ticker", "ai_rank", "conviction", "is_default", "event_risk", "summary",
        F.length("text").alias("n_chars"), "lot_reading", "order_line",
        F.substring("lot_reading", 1, TX.READING_LENGTH).alias("reading_shown"), F.substring("order_line", 1, TX.ORDER_LENGTH).alias("order_shown"))


@query
def parse_outcome(spark, d):
    return O.parse_outcome(V.opinion_batches(spark, d))


def opinion_texts(spark, d) -> DataFrame:
    """Whole documents behind a line that states conviction and risk in varying spellings."""
    i = F.col("doc_id")

    def pick(n: int, *options: str) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), (i % n + 1).cast("int"))
    return V.table(spark, d, "documents").select("doc_id", F.concat(
        pick(9, "", "CONVICTION : FORT\n", "conviction **modéré**\n", "CONVICTION — VENDRE\n",
             "CONVICTION: x FORT\n", "Conviction : 🟢 GARDER ; CONVICTION FAIBLE\n",
             "CONVICTION MODERE\n", "CONVICTION_RENFORCER\n", "CONVICTION : INSUFFISANT\n"),
        pick(5, "", "RISQUE ÉVÉNEMENTIEL : OUI\n", "risque  événementiel - non\n",
             "RISQUE ÉVÉNEMENTIEL EARNINGS NON TROUVÉ\n", "RISQUE ÉVÉNEMENTIEL: peut-être\n"),
        "text",
        pick(6, "", "\nRÉSUMÉ :\n\n  un deux \ntrois\nPOUR x", "\nRESUME: court", "\nRÉSUMÉ: **gras**",
             "\nRÉSUMÉ :POUR\nRESUME : repli", "\nRÉSUMÉ : fin\nCONCLUSION")).alias("text"))


@query
def extract_conviction(spark, d):
    t = F.col("text")
    docs = opinion_texts(spark, d).select("doc_id", TX.conviction_or_default(t).alias("conviction"),
                                          TX.conviction(t).isNull().alias("is_default"))
    return docs


@query
def extract_event_risk(spark, d):
    return opinion_texts(spark, d).select("doc_id", TX.event_risk(F.col("text")).alias("event_risk"))


@query
def extract_summary(spark, d):
    return opinion_texts(spark, d).select("doc_id", TX.summary(F.col("text")).alias("summary"),
                                          TX.summary(F.col("text"), TX.SUMMARY_LENGTH).alias("summary_shown"))


@query
def extract_conversations(spark, d):
    c = V.table(spark, d, "conversations")
    return O.extract_fields(c).select("conv_id", "turn", "conviction", "is_default", "event_risk", "summary")


# ---- learning -------------------------------------------------------------------------------

def learning_set(spark, d) -> DataFrame:
    b = stage(V.bars(spark, d), "bars")
    rows = stage(ML.training_rows(A.indicators(b), ML.label(b), breakout_rows(spark, d, b),
                                  V.instruments(spark, d)), "rows")
    return ML.dataset(rows, ML.known_sectors(rows))


def scoring_rows(spark, d) -> DataFrame:
    facts = V.instruments(spark, d).select("ticker", "sector", "market_cap", "pe_ratio")
    return L.rows_to_save(A.indicators(V.bars(spark, d)), last_day(spark, d)).join(facts, "ticker", "left")


@query
def ml_encoded(spark, d):
    """Category features as they enter the model at scoring."""
    sectors = ML.known_sectors(V.instruments(spark, d))
    columns = list(ML.one_hot(F.lit(""), "sector", [*sectors, ML.UNKNOWN_SECTOR])) + list(ML.one_hot(F.lit(""), "regime", list(ML.REGIMES)))
    return ML.encoded(scoring_rows(spark, d), columns, sectors).select("ticker", "date", *columns)


@query
def ml_dataset(spark, d):
    data = learning_set(spark, d)
    return data.select(
        "ticker", "date", "idx", grid("weight").alias("weight"), "target", "signal", "pe_ratio",
        grid("vol_ratio").alias("vol_ratio"), grid("bb_position").alias("bb_position"),
        *[c for c in data.columns if c.startswith(("sector_", "regime_"))])


@query
def ml_folds(spark, d):
    """Rows that each fold trains on and is tested on, and their newest and oldest days."""
    data = stage(learning_set(spark, d).select("idx", "n", "date"), "training")
    n = data.agg(F.max("n")).first()[0]
    folds = [F.when(F.col("idx") < start + size, F.struct(F.lit(fold).alias("fold"), F.lit(start).alias("n_train"), F.lit(size).alias("n_test")))
             for fold, start, size in ML.fold_bounds(n)]
    met = data.select("idx", "date", F.inline(F.array_compact(F.array(*folds))))
    early = F.col("idx") < F.col("n_train")
    return met.groupBy("fold", "n_train", "n_test").agg(
        F.count_if(early).alias("trained"), F.count_if(~early).alias("tested"),
        F.max(F.when(early, F.col("date"))).alias("train_until"), F.min(F.when(~early, F.col("date"))).alias("test_from"),
        F.max("date").alias("test_until"))


@query
def ml_published(spark, d):
    """Trained over time, published, loaded again and used: scores of all newest rows beside the version's precision and alarm."""
    path = new_path(spark, "models")
    sectors = ML.known_sectors(V.instruments(spark, d))
    ML.save(ML.train(learning_set(spark, d), sectors), path)
    model, columns, known = ML.load(path)
    current = ML.registry(path).select("version", "accuracy", "reliable", "alarm")
    return ML.score(scoring_rows(spark, d), model, columns, known).join(F.broadcast(current))


@query
def ml_cv(spark, d):
    return ML.cross_validate(stage(learning_set(spark, d), "training"))


@query
def ml_scores(spark, d):
    data = stage(learning_set(spark, d), "training")
    columns = ML.feature_columns(data)
    model = ML.fit(data, columns)
    return ML.score(scoring_rows(spark, d), model, columns, ML.known_sectors(V.instruments(spark, d)))
