"""Position ledger: bulk events, listings, valuation and exit conditions."""

from __future__ import annotations

import datetime as dt
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark import constants as C
from tidemark.functions import scalars as X
from tidemark.functions.envelope import LEVELS_SCHEMA, suffix_levels
from tidemark.operators.asof import asof_join, join_daily, last_known, latest_per_key
from tidemark.operators.upsert import write_partitioned
from tidemark.plans import context, ranking
from tidemark.session import stage
from tidemark.shipping import ship_package

TICKER_PATTERN = r"^[A-Z0-9.\-^]{1,15}$"
MONEY = "decimal(18,4)"


def search_instruments(instruments: DataFrame, query: str = "", limit: int | None = None) -> DataFrame:
    """Instruments whose ticker or name contains the query; exact and prefix matches first.

    ``limit`` is the caller's page size, all by default.
    """
    text = query.strip().upper()
    ticker, name = F.upper("ticker"), F.upper("name")
    place = F.when(ticker == text, 0).when(ticker.startswith(text), 1) \
        .when(name.startswith(text), 2).otherwise(3)
    rows = instruments.where(ticker.contains(text) | X.is_true(name.contains(text)))
    order = [place, F.col("ticker")] if text else [F.col("ticker")]
    rows = rows.orderBy(*order)
    return (rows if limit is None else rows.limit(limit)).select(
        "ticker", F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("sector", F.lit("—")).alias("sector"))


GRAM, GRAM_BUCKETS = 3, 64


def _grams(text: Column) -> Column:
    """Distinct runs of three characters."""
    return F.array_distinct(F.when(F.length(text) >= GRAM, F.transform(
        F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>")))


def _gram_bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(GRAM_BUCKETS)).cast("int")


def index_instruments(instruments: DataFrame, path: str) -> None:
    """Trigram index of tickers and names: a row per gram and instrument, with what a search shows, in buckets of grams."""
    rows = instruments.select("ticker", "name", "sector").where("ticker IS NOT NULL")
    texts = F.array_distinct(F.concat(_grams(F.upper("ticker")), _grams(F.upper(F.coalesce("name", F.lit(""))))))
    posted = rows.select(F.explode(texts).alias("gram"), "*")
    write_partitioned(posted.withColumn("bucket", _gram_bucket(F.col("gram"))), path, "bucket")


def search_indexed(spark: SparkSession, path: str, query: str, limit: int | None = None) -> DataFrame:
    """``search_instruments`` through the index: only the buckets of the query's grams are read.

    An instrument must be in the postings of all grams; its text then confirms the match. The query needs three characters.
    """
    text = query.strip().upper()
    if len(text) < GRAM:
        raise ValueError(f"a search by the index needs {GRAM} characters, got {text!r}")
    grams = list(dict.fromkeys(text[i : i + GRAM] for i in range(len(text) - GRAM + 1)))
    buckets = sorted({zlib.crc32(g.encode()) % GRAM_BUCKETS for g in grams})
    posted = spark.read.schema("gram string, ticker string, name string, sector string, bucket int").parquet(path) \
        .where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    both = posted.groupBy("ticker", "name", "sector").agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(grams))
    return search_instruments(both.drop("_n"), query, limit)


def with_amounts(positions: DataFrame) -> DataFrame:
    """Derived ledger columns: invested amount and realised result."""
    buy, sell, quantity = F.col("buy_price"), F.col("sell_price"), F.col("quantity")
    return positions.withColumns({
        "invested": X.invested(quantity, buy), "result": X.result_amount(buy, sell, quantity),
        "result_pct": X.result_pct(buy, sell)})


def list_positions(positions: DataFrame, status: str | None = None,
                   portfolio_id: int | None = None) -> DataFrame:
    """Positions, newest first; ``status`` is open, closed or None for all."""
    rows = with_amounts(positions)
    if status is not None:
        rows = rows.where(F.col("status") == {"open": C.OPEN, "closed": C.CLOSED}[status])
    if portfolio_id is not None:
        rows = rows.where(F.col("portfolio_id") == portfolio_id)
    return rows.orderBy(F.col("buy_date").desc(), F.col("id").desc())


def position_counts(positions: DataFrame) -> DataFrame:
    return positions.agg(
        F.count(F.lit(1)).alias("n_positions"), F.count_if(F.col("status") == C.OPEN).alias("n_open"),
        F.count_if(F.col("status") == C.CLOSED).alias("n_closed"))


def portfolio_counts(portfolios: DataFrame, positions: DataFrame, active_only: bool = True) -> DataFrame:
    """Open and closed positions per portfolio, counted before the join."""
    counts = positions.groupBy(F.col("portfolio_id").alias("id")).agg(
        F.count_if(F.col("status") == C.OPEN).alias("n_open"),
        F.count_if(F.col("status") == C.CLOSED).alias("n_closed"))
    wanted = portfolios.where("active") if active_only else portfolios
    return wanted.join(counts, "id", "left").fillna(0, ["n_open", "n_closed"]) \
        .select("id", "name", "active", "n_open", "n_closed").orderBy("id")


def closed_summary(positions: DataFrame) -> DataFrame:
    """Closed positions: wins, losses (an unknown result counts as 0) and total result."""
    pct = F.coalesce("result_pct", F.lit(0))
    return with_amounts(positions.where(F.col("status") == C.CLOSED)).agg(
        F.count(F.lit(1)).alias("n_closed"), F.count_if(pct > 0).alias("n_wins"),
        F.count_if(pct <= 0).alias("n_losses"),
        F.coalesce(F.sum("result"), F.lit(0)).alias("total_result"))


def open_positions(positions: DataFrame, bars: DataFrame, rsi: DataFrame, as_of: dt.date | Column
                   ) -> DataFrame:
    """Open positions with newest price, unrealised result, days held and RSI."""
    last = latest_per_key(
        bars.select("ticker", "date", "adj_close").join(
            rsi.select("ticker", "date", "rsi_14"), ["ticker", "date"], "left"), ["ticker"])
    rows = positions.where(F.col("status") == C.OPEN).join(last.drop("date"), "ticker", "left")
    price = F.col("adj_close").cast(MONEY)
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return rows.select(
        "id", "ticker", "buy_date", "buy_price",
        X.invested(F.col("quantity"), F.col("buy_price")).alias("invested"), "quantity",
        F.col("adj_close").alias("price"),
        X.result_amount(F.col("buy_price"), price, F.col("quantity")).alias("pl"),
        X.result_pct(F.col("buy_price"), price).alias("pl_pct"),
        F.datediff(today, "buy_date").alias("days_held"), "rsi_14")


def rate_on(rows: DataFrame, fx: DataFrame, currency: str, on: str, out: str) -> DataFrame:
    """Rate per euro known on a day; 1 for the euro and for no currency, null before the first rate."""
    rates = fx.withColumnRenamed("currency", currency)
    found = join_daily(rows, rates, [currency], on, {"rate_per_eur": out})
    home = F.col(currency).isNull() | (F.col(currency) == "EUR")
    return found.withColumn(out, F.when(home, 1.0).otherwise(F.col(out)))


def newest_rate(rows: DataFrame, fx: DataFrame, currency: str, out: str) -> DataFrame:
    last = latest_per_key(fx, ["currency"]).select(
        F.col("currency").alias(currency), F.col("rate_per_eur").alias(out))
    home = F.col(currency).isNull() | (F.col(currency) == "EUR")
    return rows.join(last, currency, "left").withColumn(
        out, F.when(home, 1.0).otherwise(F.col(out)))


def stop_levels(ind: DataFrame, wanted: DataFrame) -> DataFrame:
    """Highest price and trailing stop from any starting bar to the newest one.

    ``wanted``: distinct (ticker, k, first_bar). The stop of a purchase is the greatest of p0 - k * atr0,
    p0 - k * A(e) and the maximum over bars u from the first bar e on of p(u) - k * A(u), where
    A(u) is the least range from u to the end. These are lines in k; going back in time their slopes only rise, so
    one pass per ticker keeps their upper envelope and reads off every factor. A group holds the bars of one ticker
    from its first purchase on and at most one question per day and factor (two decimals between 2 and 4).
    """
    ship_package(ind.sparkSession)
    first = wanted.groupBy("ticker").agg(F.min("first_bar").alias("_from"))
    bars = ind.select("ticker", "date", "price", "atr_14").join(first, "ticker").where("date >= _from").drop("_from")
    return bars.groupBy("ticker").cogroup(wanted.groupBy("ticker")).applyInPandas(suffix_levels, LEVELS_SCHEMA)


def light(violated: Column, warning: Column, known: Column | None = None) -> Column:
    verdict = F.when(violated, "VIOLATED").when(warning, "WARNING").otherwise("OK")
    return verdict if known is None else F.when(known, verdict).otherwise("NO_DATA")


def evaluate_positions(positions: DataFrame, ind: DataFrame, instruments: DataFrame,
                       force: DataFrame, macro: DataFrame, fx: DataFrame,
                       portfolio_id: int | None = None) -> DataFrame:
    """Open positions with result in quote currency and euro, trailing stop and five conditions."""
    macro, fx = stage(macro, "macro"), stage(fx, "fx")
    rows = positions.where(F.col("status") == C.OPEN)
    if portfolio_id is not None:
        rows = rows.where(F.col("portfolio_id") == portfolio_id)
    rows = rows.select(
        "id", "ticker", "buy_date", F.col("buy_price").cast("double").alias("buy_price"),
        F.col("quantity").cast("double").alias("quantity"),
        X.invested(F.col("quantity"), F.col("buy_price")).cast("double").alias("invested"),
        F.col("invested_eur").cast("double").alias("invested_eur"),
        F.coalesce("quote_currency", F.lit("EUR")).alias("quote_currency"), "portfolio_id")
    last = latest_per_key(ind.select("ticker", "date", "price", "atr_14", "sma_200", "mom_r2"), ["ticker"])
    # Context per ticker at its newest bar, joined once per position afterwards.
    last = ranking.sector_passes(ranking.with_sector(last, instruments), force, "date") \
        .withColumn("zone", X.home_zone(F.col("zone_priority")))
    # Macro state at the earliest of the zones' newest dates.
    newest = macro.groupBy("zone").agg(F.max("date").alias("d")).agg(F.min("d").alias("at"))
    regime = context.macro_at(macro.select("zone").distinct().join(newest), macro, "at") \
        .select("zone", "macro_ok")
    last = last.join(regime, "zone", "left").withColumn(
        "macro_ok", F.coalesce("macro_ok", F.lit(True))).drop("zone_priority")
    rows = rows.join(last.withColumnsRenamed({"date": "data_date", "price": "now", "atr_14": "atr_now"}),
                     "ticker", "left")
    first = asof_join(rows, ind.withColumn("first_bar", F.col("date")), ["ticker"], "buy_date", "date",
                      {"first_bar": "first_bar", "atr_14": "atr_first"}, forward=True)
    atr_now = F.coalesce("atr_now", F.lit(0.0))
    first = first.withColumn("atr_entry", F.coalesce("atr_first", atr_now))
    has_first = F.col("first_bar").isNotNull()
    first = first.withColumn("k", F.when(
        has_first, X.entry_k(F.col("atr_entry"), F.col("buy_price"))).otherwise(C.K_FALLBACK))
    first = stage(first, "first")  # read by the levels as well
    levels = stop_levels(ind, first.where(has_first).select("ticker", "k", "first_bar").distinct())
    held = first.join(levels, ["ticker", "k", "first_bar"], "left")
    start = F.when(F.col("atr_entry") > 0, F.col("buy_price") - F.col("k") * F.col("atr_entry")) \
        .otherwise(0.0)
    stop = F.greatest(start, F.col("buy_price") - F.col("k") * F.col("least_range"), "stop_since")
    held = held.withColumns({"stop": stop, "max_price": F.greatest("buy_price", "high_since")})
    held = rate_on(newest_rate(held, fx, "quote_currency", "rate_now"), fx, "quote_currency",
                   "buy_date", "rate_buy")
    now, buy = F.col("now"), F.col("buy_price")
    held = held.withColumns({
        "pnl_pct": F.round((now - buy) / buy * 100, 2),
        "pnl_quote": F.round((now - buy) * F.col("quantity"), 2),
        "value_eur": F.round(now * F.col("quantity") / F.col("rate_now"), 2),
        "cost_eur": F.coalesce("invested_eur", F.round(F.col("invested") / F.col("rate_buy"), 2)),
        "stop_distance_pct": F.when(now > 0, F.round((now - F.col("stop")) / now * 100, 2)).otherwise(0.0),
        "sma_distance_pct": F.round((now - F.col("sma_200")) / F.col("sma_200") * 100, 2)})
    known = now.isNotNull()
    lights = {
        "trailing_stop": light(now <= F.col("stop"), F.col("stop_distance_pct") < 2.0),
        "trend_sma200": light(now < F.col("sma_200"), F.col("sma_distance_pct") < 3.0,
                              F.col("sma_200").isNotNull()),
        "momentum_r2": light(F.col("mom_r2") < 0, F.col("mom_r2") < 0.05, F.col("mom_r2").isNotNull()),
        "sector": light(~F.col("sector_ok"), F.lit(False)),
        "macro": light(~F.col("macro_ok"), F.lit(False)),
    }
    held = held.withColumns({f"c_{n}": F.when(known, c) for n, c in lights.items()})

    def names(state: str) -> Column:
        return F.array_compact(F.array(*[F.when(F.col(f"c_{n}") == state, F.lit(n)) for n in lights]))
    held = held.withColumns({"violated": names("VIOLATED"), "warnings": names("WARNING")})
    alert = F.when(~known, "INCONNU").when(F.size("violated") > 0, "SORTIE_RECOMMANDÉE") \
        .when(F.size("warnings") > 0, "VIGILANCE").otherwise("SAIN")
    return held.select(
        "id", "ticker", "portfolio_id", "buy_date", "buy_price", "quantity", "quote_currency",
        "data_date", F.round("now", 2).alias("price"), "pnl_pct", "pnl_quote",
        F.round(F.col("value_eur") - F.col("cost_eur"), 2).alias("pnl_eur"), "value_eur",
        F.datediff("data_date", "buy_date").alias("days_held"), "k",
        F.when(known, F.round("stop", 2)).alias("stop"), "stop_distance_pct",
        F.round("max_price", 2).alias("max_price"), "sma_distance_pct",
        *[f"c_{n}" for n in lights], "violated", "warnings", alert.alias("alert"))


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    alert = F.col("alert")
    return evaluated.agg(
        F.count(F.lit(1)).alias("n_positions"), F.count_if(alert == "SORTIE_RECOMMANDÉE").alias("n_exit"),
        F.count_if(alert == "VIGILANCE").alias("n_watch"), F.count_if(alert == "SAIN").alias("n_sound"))


def check_events(events: DataFrame, positions: DataFrame, portfolios: DataFrame,
                 instruments: DataFrame, bars: DataFrame) -> DataFrame:
    """Add ``reject_reasons`` to open, edit and close events, from their own fields and look-ups."""
    ticker = F.upper(F.trim(F.coalesce("ticker", F.lit(""))))
    known = instruments.select("ticker").union(bars.select("ticker")).distinct() \
        .withColumn("_known", F.lit(True))
    folder = portfolios.select(F.col("id").alias("portfolio_id"), F.col("active").alias("_active"))
    target = positions.select(F.col("id").alias("position_id"), F.col("status").alias("_status"),
                              F.col("quote_currency").alias("_quote"), F.col("buy_date").alias("_bought"))
    e = events.withColumn("ticker", F.when(F.col("kind") == "open", ticker)) \
        .join(known, "ticker", "left").join(folder, "portfolio_id", "left") \
        .join(target, "position_id", "left")
    is_open, is_edit, is_close = [F.col("kind") == k for k in ("open", "edit", "close")]
    has_change = F.coalesce(*[F.col(c).cast("string") for c in
                              ("price", "quantity", "event_date", "comment", "invested_eur")]).isNotNull()
    faults = {
        "BAD_SOURCE": is_open & ~X.is_true(F.col("source").isin(*C.SOURCES)),
        "NO_TICKER": is_open & (F.col("ticker") == ""),
        "BAD_TICKER": is_open & (F.col("ticker") != "") & ~F.col("ticker").rlike(TICKER_PATTERN),
        "UNKNOWN_TICKER": is_open & F.col("_known").isNull(),
        "NO_PORTFOLIO": is_open & F.col("_active").isNull(),
        "INACTIVE_PORTFOLIO": is_open & ~F.coalesce("_active", F.lit(True)),
        "BAD_REASON": is_close & ~X.is_true(F.col("reason").isin(*C.SELL_REASONS)),
        "NO_POSITION": ~is_open & F.col("_status").isNull(),
        "NOT_OPEN": ~is_open & X.is_true(F.col("_status") != C.OPEN),
        "NOTHING_TO_EDIT": is_edit & ~has_change,
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in faults.items()]))
    return e.withColumn("reject_reasons", reasons)


def apply_position_events(positions: DataFrame, events: DataFrame, portfolios: DataFrame,
                          instruments: DataFrame, bars: DataFrame, fx: DataFrame) -> DataFrame:
    """Ledger after a batch of events.

    Opens add rows with the event's id negated as id. Of several edits the newest value of each
    field wins; the first valid close of a position ends it and edits after it are ignored. A price
    entered in another currency is converted at the rates of its day and kept as entered; an event
    whose rate is missing changes nothing.
    """
    good = stage(check_events(events, positions, portfolios, instruments, bars)
                 .where(F.size("reject_reasons") == 0), "events")
    fx = stage(fx, "fx")
    declared = instruments.select("ticker", F.col("currency").alias("_declared"))

    def priced(rows: DataFrame, quote: str) -> DataFrame:
        """Add the price in quote currency and the day's rates."""
        both = rate_on(rate_on(rows, fx, "currency", "event_date", "_rate_in"), fx, quote,
                       "event_date", "_rate_quote")
        foreign = F.col("currency").isNotNull() & (F.col("currency") != F.col(quote))
        converted = F.round(F.col("price").cast("double") * F.col("_rate_quote") / F.col("_rate_in"), 4) \
            .cast(MONEY)
        return both.withColumns({
            "_foreign": foreign,
            "_quoted": F.when(foreign, converted).otherwise(F.col("price"))})

    opens = good.where("kind = 'open'").join(declared, "ticker", "left").withColumn(
        "_quote", X.quote_currency(F.col("ticker"), F.col("_declared")))
    opens = priced(opens, "_quote").where("_quoted IS NOT NULL")
    added = opens.select(
        (-F.col("event_id")).alias("id"), "ticker", F.col("event_date").alias("buy_date"),
        F.col("_quoted").alias("buy_price"), "quantity", F.lit(C.OPEN).alias("status"),
        F.lit(None).cast("date").alias("sell_date"), F.lit(None).cast(MONEY).alias("sell_price"),
        F.lit(None).cast("string").alias("sell_reason"), "source", "comment", "portfolio_id",
        F.col("_quote").alias("quote_currency"),
        F.when(F.col("_foreign"), F.col("price")).alias("txn_price"),
        F.when(F.col("_foreign"), F.col("currency")).alias("txn_currency"), "invested_eur")

    home = F.coalesce("_quote", F.lit("EUR"))
    place = F.struct("event_time", "event_id")
    closes = priced(good.where("kind = 'close'").withColumn("_quote", home), "_quote") \
        .where("_quoted IS NOT NULL")
    closing = stage(closes.groupBy("position_id").agg(F.min_by(
        F.struct(place.alias("at"), F.col("event_date").alias("sell_date"),
                 F.col("_quoted").alias("sell_price"), F.col("reason").alias("sell_reason")),
        place).alias("c")), "closing")
    edits = good.where("kind = 'edit'").join(closing.select("position_id", F.col("c.at").alias("_end")),
                                             "position_id", "left") \
        .withColumns({"_at": place, "_quote": home}) \
        .where(F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    # A new price is converted at the purchase date valid when it was entered, and a missing rate
    # voids its whole event. An event with a date of its own is judged by that date alone, so the
    # dated ones come first and give the others their date.
    edits = stage(edits.withColumn("new_date", F.col("event_date")), "edits")
    void = F.col("price").isNotNull() & F.col("_quoted").isNull()
    dated = stage(priced(edits.where("event_date IS NOT NULL"), "_quote").where(~void), "dated")
    both = dated.select(*edits.columns).unionByName(edits.where("event_date IS NULL"))
    undated = last_known(both, ["position_id"], "event_time", ["event_time", "event_id"],
                         "new_date", "_valid_on").where("event_date IS NULL") \
        .withColumn("event_date", F.coalesce("_valid_on", "_bought")).drop("_valid_on")
    own = dated.unionByName(priced(undated, "_quote").where(~void))

    def newest(value: str | Column, when: Column) -> Column:
        return F.max_by(value, F.when(when, F.col("_at")))
    has_price = F.col("price").isNotNull()
    foreign = has_price & F.col("_foreign")
    changed = own.groupBy("position_id").agg(
        newest("_quoted", has_price).alias("e_buy_price"),
        newest("price", foreign).alias("e_txn_price"), newest("currency", foreign).alias("e_txn_currency"),
        *[newest(c, F.col(c).isNotNull()).alias(f"e_{o}") for c, o in (
            ("quantity", "quantity"), ("new_date", "buy_date"), ("comment", "comment"),
            ("invested_eur", "invested_eur"))])
    merged = positions.join(changed.withColumnRenamed("position_id", "id"), "id", "left") \
        .join(closing.select(F.col("position_id").alias("id"), "c"), "id", "left")
    out = []
    for name in positions.columns:
        if f"e_{name}" in changed.columns:
            out.append(F.coalesce(f"e_{name}", name).alias(name))
        elif name in ("sell_date", "sell_price", "sell_reason"):
            out.append(F.coalesce(F.col(f"c.{name}"), F.col(name)).alias(name))
        elif name == "status":
            out.append(F.when(F.col("c").isNotNull(), C.CLOSED).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return merged.select(*out).unionByName(added)
