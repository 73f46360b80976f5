"""Written opinions: extraction from answers, selection, forward returns and hit rates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import constants as C
from tidemark.functions import text as T
from tidemark.operators.asof import asof_join, one_per_key
from tidemark.operators.upsert import merge, newest

HORIZONS = list(C.HORIZON_DAYS)
RETURNS = [f"return_{h}" for h in HORIZONS]


# ---- extraction -----------------------------------------------------------------------------

def extract_fields(texts: DataFrame, text: str = "text", display: bool = False) -> DataFrame:
    """Conviction, event risk and summary of free-standing opinion texts; ``display`` cuts the summary."""
    stated = T.conviction(F.col(text))
    return texts.withColumns({
        "conviction": F.coalesce(stated, F.lit(T.DEFAULT_CONVICTION)),
        "is_default": stated.isNull(), "event_risk": T.event_risk(F.col(text)),
        "summary": T.summary(F.col(text), T.SUMMARY_LENGTH if display else None)})


def _split_batches(batches: DataFrame, display: bool = False) -> DataFrame:
    """Order line and sections of each answer, kept inside the row: nothing is shuffled."""
    body = F.col("text")
    order = T.first_group(body, T.ORDER_LINE)
    expected = F.transform("expected_tickers", F.upper)
    shown = lambda c, n: F.substring(c, 1, n) if display else c
    rows = batches.withColumns({
        "expected": expected,
        "lot_reading": shown(T.strip(T.first_group(body, T.LOT_READING)), T.READING_LENGTH),
        "order_line": shown(T.strip(order), T.ORDER_LENGTH),
        "_named": F.coalesce(F.regexp_extract_all(F.upper(order), F.lit(T.TICKER), 0),
                             F.expr("CAST(array() AS ARRAY<STRING>)")),
        "_parts": F.split(body, T.SECTION)})

    def section(part: Column) -> Column:
        fenced = F.contains(part, F.lit("==="))
        mark = F.when(fenced, F.lit("===")).otherwise(F.lit("\n"))
        place = F.instr(part, mark)
        head = F.when(place > 0, F.substring(part, F.lit(1), place - 1)).otherwise(part)
        tail = F.when(place > 0, F.substring(part, place + F.length(mark), F.length(part))) \
            .otherwise(F.lit(""))
        return F.struct(head.alias("header"), T.strip(tail).alias("body"))
    sections = F.transform(F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0))),
                           section)
    rows = rows.withColumn("_sections", sections).drop("_parts")
    rows = rows.withColumn("_sections", F.transform("_sections", lambda s, i: F.struct(
        T.section_ticker(s["header"], F.col("expected")).alias("ticker"), s["body"].alias("body"),
        i.alias("pos"))))
    return rows.withColumns({
        "_sections": F.filter("_sections", lambda s: s["ticker"].isNotNull()),
        "_ranked": F.array_distinct(F.filter("_named", lambda t: F.array_contains("expected", t)))})


def extract_batch_opinions(batches: DataFrame, display: bool = False) -> DataFrame:
    """One row per recognised ticker of each answer with its fields.

    A ticker's rank comes from the order line, or, when that names nobody, from the order of the
    sections. The last section of a ticker counts, its first one gives its place. Texts are whole unless
    ``display`` asks for the lengths that listings show.
    """
    rows = _split_batches(batches, display)
    placed = rows.select(
        *batches.columns, "lot_reading", "order_line", "_ranked",
        F.array_distinct(F.transform("_sections", lambda s: s["ticker"])).alias("_seen"),
        F.explode(F.map_from_entries(F.transform(
            F.array_distinct(F.transform("_sections", lambda s: s["ticker"])),
            lambda t: F.struct(t, F.element_at(F.filter(
                "_sections", lambda s: s["ticker"] == t), -1)["body"])))).alias("ticker", "body"))
    rank = F.when(F.size("_ranked") > 0, F.nullif(F.array_position("_ranked", F.col("ticker")), F.lit(0))) \
        .otherwise(F.array_position("_seen", F.col("ticker")))
    kept = [c for c in batches.columns if c not in ("expected_tickers", "text")]
    return extract_fields(placed.select(
        *kept, "ticker", F.col("body").alias("text"), rank.cast("int").alias("ai_rank"),
        "lot_reading", "order_line"), display=display)


def parse_outcome(batches: DataFrame) -> DataFrame:
    """Per answer: sections recognised, tickers missing, resulting status and note."""
    rows = _split_batches(batches).withColumn(
        "parsed", F.array_distinct(F.transform("_sections", lambda s: s["ticker"])))
    n, total = F.size("parsed"), F.size("expected")
    missing = F.filter("expected", lambda t: ~F.array_contains("parsed", t))
    rows = rows.withColumns({"n_parsed": n, "n_expected": total, "missing": missing})
    note = F.when(F.col("n_parsed") == 0, F.concat(
        F.lit(C.NOTE_NONE[0]), "n_expected", F.lit(C.NOTE_NONE[1]))).when(
        F.size("missing") > 0, F.concat(F.lit(C.NOTE_PARTIAL[0]), "n_parsed", F.lit(C.NOTE_PARTIAL[1]), "n_expected",
                                        F.lit(C.NOTE_PARTIAL[2]), F.array_join("missing", ", ")))
    return rows.select(
        "batch_id", "n_parsed", "n_expected", "missing",
        F.when(F.col("n_parsed") == 0, C.BATCH_FAILED).otherwise(C.BATCH_DONE).alias("status"),
        note.alias("note"))


def lot_concentration(members: DataFrame) -> DataFrame:
    """Instruments per sector of each lot; ``members`` has lot, sector."""
    return members.groupBy("lot", F.coalesce("sector", F.lit("Inconnu")).alias("sector")).agg(
        F.count(F.lit(1)).alias("n"))


def quant_diagnosis(rows: DataFrame) -> DataFrame:
    """Lights for trend, momentum, volume and accumulation; null where the input is missing."""
    price, sma = F.col("price"), F.col("sma_200")
    trend = F.when((price != 0) & (sma != 0), F.when(price > sma, "GREEN").otherwise("RED"))
    mom, rvol, obv = F.col("mom_r2"), F.col("rvol"), F.col("obv_slope")
    return rows.withColumns({
        "pct_vs_sma": F.when((price != 0) & (sma != 0), (price - sma) / sma * 100),
        "trend_light": trend,
        "momentum_light": F.when(mom > 0.3, "GREEN").when(mom > 0, "YELLOW").when(mom.isNotNull(), "RED"),
        "volume_light": F.when(rvol > 2.0, "GREEN").when(rvol > 1.0, "YELLOW")
        .when(rvol.isNotNull(), "RED"),
        "accumulation_light": F.when(obv > 0, "GREEN").when(obv.isNotNull(), "RED"),
        "has_momentum_data": F.coalesce(mom, rvol, obv).isNotNull()})


# ---- storage --------------------------------------------------------------------------------

def upsert_opinions(stored: DataFrame, fresh: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Replace opinions by (week, ticker, type); strips NUL characters and stamps the time."""
    stamp = now if isinstance(now, Column) else F.lit(now)
    clean = fresh.withColumns({
        "text": F.translate("text", "\u0000", ""), "summary": F.translate("summary", "\u0000", ""),
        "generated_at": F.coalesce("generated_at", stamp)})
    keys = ["week", "ticker", "type"]
    return merge(stored, newest(clean, keys, ["generated_at", "rank"]), keys)


def backfill_type(opinions: DataFrame) -> DataFrame:
    """Opinions without a type: ``position`` when their source starts so, else ``ranking``."""
    from_position = F.coalesce(F.col("source").rlike("^position."), F.lit(False))
    return opinions.withColumn("type", F.coalesce(
        "type", F.when(from_position, "position").otherwise("ranking")))


# ---- selection ------------------------------------------------------------------------------

def select_opinions(opinions: DataFrame, week: dt.date | None = None, ticker: str | None = None,
                    everything: bool = False, kind: str | None = None) -> DataFrame:
    """All; one week and ticker; one week; the newest of a ticker; or the newest week."""
    rows = opinions if kind is None else opinions.where(F.col("type") == kind)
    by_rank = F.col("rank").asc_nulls_last()
    if everything:
        return rows.orderBy(F.col("week").desc(), by_rank)
    if ticker is not None:
        rows = rows.where(F.col("ticker") == ticker.upper())
    if week is not None:
        return rows.where(F.col("week") == F.lit(week)).orderBy(by_rank)
    if ticker is not None:
        return rows.orderBy(F.col("week").desc(), F.col("generated_at").desc_nulls_last()).limit(1)
    newest_week = opinions.agg(F.max("week").alias("week"))
    return rows.join(newest_week, "week", "left_semi").orderBy(by_rank)


def recent_opinions(opinions: DataFrame, as_of: dt.date | Column, days: int = 7) -> DataFrame:
    """Newest ranking opinion per ticker among those of the trailing days."""
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    said = F.coalesce(F.to_date("generated_at"), F.col("week"))
    rows = opinions.where(F.coalesce(F.col("type"), F.lit("ranking")) == "ranking") \
        .where(said >= F.date_sub(today, days))
    return one_per_key(rows, ["ticker"], ["week", "generated_at", "type"])


def conviction_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conviction").agg(F.count(F.lit(1)).alias("n"))


def opinion_detail(opinions: DataFrame, kind: str, versions: list[str] | None = None,
                   models: list[str] | None = None, weeks: list[dt.date] | None = None,
                   tickers: list[str] | None = None, need_return: bool = False) -> DataFrame:
    """Opinions of a type narrowed by version, model, week, ticker and known return."""
    rows = labelled(opinions).where(F.col("type") == kind)
    for column, wanted in (("prompt_version", versions), ("model", models), ("week", weeks),
                           ("ticker", tickers)):
        if wanted is not None:
            rows = rows.where(F.col(column).isin(*wanted))
    if need_return:
        rows = rows.where(has_return())
    order = [F.col("week").desc(), F.col("rank").asc_nulls_last() if kind == "ranking" else F.col("ticker")]
    return rows.select("week", "ticker", "rank", "conviction", *RETURNS).orderBy(*order)


def last_opinion(opinions: DataFrame) -> DataFrame:
    """Each opinion's predecessor of the same ticker and the longest return known of it."""
    before = opinions.where("type = 'ranking'").select(
        "ticker", "week", F.col("week").alias("prev_week"), F.col("conviction").alias("prev_conviction"),
        F.coalesce("return_4w", "return_2w", "return_1w").alias("prev_return"))
    return asof_join(opinions, before, ["ticker"], "week", "week", {
        "prev_week": "prev_week", "prev_conviction": "prev_conviction", "prev_return": "prev_return"},
        strict=True)


# ---- forward returns ------------------------------------------------------------------------

def horizon_prices(bars: DataFrame) -> DataFrame:
    """Per bar the last price within each horizon, null when no later bar lies in it."""
    day = F.unix_date("date")
    rows = bars.where("adj_close IS NOT NULL AND NOT isnan(adj_close)") \
        .select("ticker", "date", F.col("adj_close").alias("price"), day.alias("_day"))
    out = {}
    for name, days in C.HORIZON_DAYS.items():
        ahead = Window.partitionBy("ticker").orderBy("_day").rangeBetween(0, days)
        last = F.last(F.struct("_day", "price")).over(ahead)
        out[f"_to_{name}"] = last
    rows = rows.withColumns(out)
    return rows.select("ticker", "date", "price", *[
        F.when(F.col(f"_to_{n}._day") > F.col("_day"), F.col(f"_to_{n}.price")).alias(f"to_{n}")
        for n in C.HORIZON_DAYS])


def forward_returns(opinions: DataFrame, bars: DataFrame, as_of: dt.date | Column,
                    types: tuple[str, ...] = ("ranking",)) -> DataFrame:
    """Opinions with prices and returns filled where they can be known by ``as_of``.

    The anchor is the last bar on or before the opinion was written. Both ends come from the same
    adjusted series and the target bar must lie after the anchor. A complete opinion and other
    types stay as they are; values already known are revised.
    """
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    written = F.coalesce(F.to_date("generated_at"), F.date_add("week", 6))
    complete = F.lit(True)
    for r in RETURNS:
        complete = complete & F.col(r).isNotNull()
    due = F.coalesce(F.col("type"), F.lit("ranking")).isin(*types) & ~complete
    asked = opinions.withColumn("_written", written)
    ahead = horizon_prices(bars).withColumn("_anchor", F.col("date"))
    found = asof_join(asked, ahead, ["ticker"], "_written", "date", {
        c: f"_b_{c}" for c in ahead.columns if c not in ("ticker", "date")})
    out = {}
    for name, days in C.HORIZON_DAYS.items():
        start, end = F.col("_b_price"), F.col(f"_b_to_{name}")
        known = due & (start > 0) & (F.date_add("_b__anchor", days) <= today) & end.isNotNull()
        out[f"price_{name}"] = F.when(known, end).otherwise(F.col(f"price_{name}"))
        out[f"return_{name}"] = F.when(known, (end - start) / start).otherwise(F.col(f"return_{name}"))
    return found.withColumns(out).select(*opinions.columns)


# ---- reports --------------------------------------------------------------------------------

def labelled(opinions: DataFrame) -> DataFrame:
    """Missing type, version and model shown as ranking and a dash."""
    return opinions.withColumns({
        "type": F.coalesce("type", F.lit("ranking")),
        "prompt_version": F.coalesce("prompt_version", F.lit("—")),
        "model": F.coalesce("model", F.lit("—"))})


def has_return() -> Column:
    return F.coalesce(*RETURNS).isNotNull()


def _performance(rows: DataFrame, keys: list[str], invert: bool = False) -> DataFrame:
    stats = [F.count(F.lit(1)).alias("n")]
    for h in HORIZONS:
        r = F.col(f"return_{h}")
        hit = (r > 0) if not invert else F.when(F.col("conviction") == "VENDRE", r < 0).otherwise(r > 0)
        stats += [F.avg(r).alias(f"mean_{h}"), F.avg(hit.cast("double")).alias(f"hit_{h}")]
    return rows.where(has_return()).groupBy(*keys).agg(*stats)


def performance_by_conviction(opinions: DataFrame) -> DataFrame:
    rows = labelled(opinions).where("type = 'ranking'")
    return _performance(rows.where(F.col("conviction").isin(*C.RANKING_CONVICTIONS)), ["conviction"])


def performance_by_version(opinions: DataFrame) -> DataFrame:
    return _performance(labelled(opinions).where("type = 'ranking'"), ["prompt_version", "model"])


def position_performance(opinions: DataFrame) -> DataFrame:
    """A call to sell is right when the price falls."""
    rows = labelled(opinions).where("type = 'position'")
    return _performance(rows.where(F.col("conviction").isin(*C.POSITION_CONVICTIONS)),
                        ["conviction"], invert=True)


def coverage(opinions: DataFrame) -> DataFrame:
    return labelled(opinions).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(has_return()).alias("n_with_return"),
        F.count_distinct("week").alias("n_weeks"), F.count_distinct("ticker").alias("n_tickers"))
