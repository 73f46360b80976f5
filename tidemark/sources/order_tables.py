"""Market tables derived from the order-and-events test tables.

Prices and quantities are copied, never divided, so another engine derives the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import constants as C, schemas as S

# Generated dates lie 9,000 days after the bars.
EVENT_SHIFT_DAYS = 9000
CURRENCY_OF_PRIORITY = {
    "1-URGENT": "USD", "2-HIGH": "CHF", "3-MEDIUM": "SEK", "4-NOT SPECIFIED": "KRW", "5-LOW": "GBP",
}
ZONE_OF_INDEX = {"F": "US", "O": "EU", "P": "KR"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(column: Column, mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[column]


def lineitem_bars(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Daily bars per ``key`` (p_brand, p_type or l_suppkey).

    The first and last trade of a day follow (order, line, price). One decimal holds that order, so
    the aggregation stays hash-based and combines before the shuffle.
    """
    rows = table(spark, sf_dir, "lineitem")
    if key.startswith("p_"):
        rows = rows.join(table(spark, sf_dir, "part").select("p_partkey", key),
                         F.col("l_partkey") == F.col("p_partkey"))
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(20,0)") \
        * F.lit(10**10).cast("decimal(11,0)") + F.col("l_extendedprice").cast("decimal(12,2)")
    price = F.col("l_extendedprice")
    return (
        rows.select(F.col(key).cast("string").alias("ticker"),
                    F.to_date("l_shipdate").alias("date"), price.alias("p"),
                    F.col("l_quantity").alias("q"), place.alias("place"))
        .groupBy("ticker", "date")
        .agg(F.min_by("p", "place").alias("open"), F.max("p").alias("high"),
             F.min("p").alias("low"), F.max_by("p", "place").alias("close"),
             F.sum("q").alias("volume"))
        .select("ticker", "date", "open", "high", "low", "close",
                F.col("close").alias("adj_close"), "volume")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_bars(spark, sf_dir, "p_brand")


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_bars(spark, sf_dir, "l_suppkey")


def etf_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_bars(spark, sf_dir, "p_type").select(
        F.col("ticker").alias("ticker_etf"), "date", "close", "adj_close",
        F.col("volume").cast("bigint").alias("volume"))


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderstatus").alias("index_ticker"), F.to_date("o_orderdate").alias("date"))
        .agg(F.max("o_totalprice").alias("close")).withColumn("adj_close", F.col("close"))
    )


def zone_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index bars with the zone each index stands for."""
    return index_bars(spark, sf_dir).withColumn(
        "zone", choose(F.col("index_ticker"), ZONE_OF_INDEX))


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(choose(F.col("o_orderpriority"), CURRENCY_OF_PRIORITY).alias("currency"),
                 F.to_date("o_orderdate").alias("date"))
        .agg(F.max("o_totalprice").alias("rate_per_eur"))
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instrument per brand; every seventh lacks a price-earnings ratio."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct() \
        .withColumn("n", F.substring("ticker", 7, 10).cast("int"))
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        brands.join(region, F.col("n") % 5 == F.col("r_regionkey"), "left")
        .join(nation, F.col("n") % 25 == F.col("n_nationkey"), "left")
        .select(
            "ticker", F.concat(F.lit("Maker "), F.col("n")).alias("name"),
            F.col("r_name").alias("sector"), F.lit("Goods").alias("industry"),
            F.col("n_name").alias("country"),
            F.element_at(F.array(*[F.lit(c) for c in ("EUR", "USD", "CHF", "SEK")]),
                         F.col("n") % 4 + 1).alias("currency"),
            (F.col("n") * 1000.0).alias("market_cap"),
            F.when(F.col("n") % 7 != 0, F.col("n") + 0.5).alias("pe_ratio"),
            F.lit(None).cast("date").alias("updated"),
            F.when(F.col("n") % 2 == 1, F.array(F.lit("US"), F.lit("EU")))
            .otherwise(F.array(F.lit("EU"), F.lit("US"))).alias("zone_priority"))
    )


def sector_etf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fund per part type; two of them share a (sector, zone)."""
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("ticker_etf")).distinct()
    zone = F.when(F.ascii("ticker_etf") % 2 == 1, "US").otherwise("EU")
    return (
        types.join(table(spark, sf_dir, "region"), F.length("ticker_etf") % 5 == F.col("r_regionkey"))
        .select("ticker_etf", F.concat(F.lit("Fund "), F.col("ticker_etf")).alias("name"),
                F.col("r_name").alias("sector"), zone.alias("zone"),
                F.when(zone == "US", "F").otherwise("O").alias("index_ticker"),
                F.lit(True).alias("active"))
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position per order; closed ones sold 0 to 59 days after purchase at 1.05 of the price."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = F.col("o_custkey") % 25 + 1
    closed = F.col("o_orderstatus") == "F"
    money = "decimal(18,4)"
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("Brand#"), n).alias("ticker"),
            F.to_date("o_orderdate").alias("buy_date"),
            F.col("o_totalprice").cast(money).alias("buy_price"),
            (F.col("o_orderkey") % 9 + 1).cast(money).alias("quantity"),
            F.when(closed, C.CLOSED).otherwise(C.OPEN).alias("status"),
            F.when(closed, F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 60).cast("int")))
            .alias("sell_date"),
            F.when(closed, (F.col("o_totalprice").cast("decimal(12,2)")
                            + (F.col("o_orderkey") % 2001 - 1000).cast("decimal(6,0)")).cast(money))
            .alias("sell_price"),
            F.when(closed, F.element_at(F.array(*[F.lit(r) for r in C.SELL_REASONS]),
                                        (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("sell_reason"),
            F.when(F.col("o_orderkey") % 2 == 0, "ranking").otherwise("manuel").alias("source"),
            F.lit(None).cast("string").alias("comment"), F.col("c_nationkey").alias("portfolio_id"),
            F.element_at(F.array(*[F.lit(c) for c in ("EUR", "USD", "CHF", "SEK")]),
                         (n % 4 + 1).cast("int")).alias("quote_currency"),
            F.lit(None).cast(money).alias("txn_price"), F.lit(None).cast("string").alias("txn_currency"),
            F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice").cast(money))
            .alias("invested_eur"))
    )


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
        (F.col("n_regionkey") != 0).alias("active"))


def shifted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts") - F.make_interval(days=F.lit(EVENT_SHIFT_DAYS))
    return table(spark, sf_dir, "events").select(
        "event_id", at.cast("timestamp").alias("at"), "user_id", "event_type", "value",
        F.concat(F.lit("Brand#"), F.col("user_id") % 25 + 1).alias("ticker"))


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One opinion per (week, ticker, type): the newest event of the week decides."""
    conviction = choose(F.col("event_type"), {
        "click": "FORT", "error": "MODÉRÉ", "purchase": "FAIBLE", "signup": "GARDER",
        "view": "VENDRE"})
    kind = F.when(F.col("event_type").isin("click", "error", "purchase"), "ranking") \
        .otherwise("position")
    rows = shifted_events(spark, sf_dir).select(
        F.date_trunc("week", "at").cast("date").alias("week"), "ticker", kind.alias("type"),
        F.struct(
            "event_id",
            F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 20 + 1).cast("int")).alias("rank"),
            conviction.alias("conviction"), F.col("at").alias("generated_at"),
            F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("v"), F.col("event_id") % 3))
            .alias("prompt_version"),
            F.concat(F.lit("m"), F.col("event_id") % 2).alias("model"),
            F.when(kind == "position", "position_auto").otherwise("cron").alias("source"),
        ).alias("row"))
    newest = rows.groupBy("week", "ticker", "type").agg(F.max_by("row", "row.event_id").alias("row"))
    return S.conform(newest.select("week", "ticker", "type", "row.*"), S.OPINIONS)


def signal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = choose(F.col("event_type"), {
        "click": "SUGGESTION", "error": "REJETÉ_ML", "purchase": "SUGGESTION",
        "signup": "REJETÉ_NLP", "view": "IGNORÉ"})
    return S.conform(
        shifted_events(spark, sf_dir).select(
            F.col("event_id").alias("id"), "ticker", F.to_date("at").alias("date"),
            (F.col("value") > 50).alias("signal"), decision.alias("decision"),
            F.col("value").alias("price_j0")), S.SIGNAL_LOG)


def position_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, edit and close events per order, some of them faulty on purpose."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    kind = choose((k % 3).cast("string"), {"0": "open", "1": "edit", "2": "close"})
    money = "decimal(18,4)"
    return o.select(
        k.alias("event_id"), (F.col("o_orderdate") + F.make_interval(secs=k % 86400))
        .cast("timestamp").alias("event_time"),
        kind.alias("kind"),
        F.when(kind != "open", F.floor(k / 6).cast("bigint")).alias("position_id"),
        F.when(kind == "open", F.when(k % 11 == 0, F.lit("bad ticker"))
               .when(k % 13 == 0, F.lit("NOPE")).otherwise(
                   F.concat(F.lit("BRAND-"), F.col("o_custkey") % 25 + 1))).alias("ticker"),
        F.when((kind != "edit") | (k % 5 != 0), F.col("o_totalprice").cast(money)).alias("price"),
        F.when((kind == "open") | ((kind == "edit") & (k % 4 == 0)), (k % 9 + 1).cast(money))
        .alias("quantity"),
        F.when((kind != "edit") | (k % 7 == 0), day).alias("event_date"),
        choose(F.col("o_orderpriority"), CURRENCY_OF_PRIORITY).alias("currency"),
        F.when(kind == "close", F.when(k % 17 == 0, "WHIM").otherwise("MANUEL")).alias("reason"),
        F.when(kind == "open", F.when(k % 19 == 0, "tip").otherwise("manuel")).alias("source"),
        F.lit(None).cast("string").alias("comment"),
        F.when(kind == "open", (F.col("o_custkey") % 26).cast("int")).alias("portfolio_id"),
        F.lit(None).cast(money).alias("invested_eur"))


def opinion_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of five whole documents written as sections of one answer.

    Section headers use the exact ticker, a longer title, a Korean code without its suffix and
    leading zeros, or an unknown name; every fourth lot lacks the order line.
    """
    d = F.col("doc_id")
    ticker = F.when(d % 5 == 3, F.concat(F.lpad(d.cast("string"), 6, "0"), F.lit(".KS"))) \
        .otherwise(F.concat(F.lit("T"), d))
    header = (
        F.when(d % 5 == 1, F.concat(F.lit("Société ("), ticker, F.lit(")")))
        .when(d % 5 == 3, d.cast("string"))
        .when(d % 10 == 4, F.lit("inconnu"))
        .otherwise(ticker))
    lines = F.concat(
        F.element_at(F.array(*[F.lit(x) for x in (
            "CONVICTION : **FORT**", "## Conviction — 🟡 modéré", "CONVICTION: FAIBLE",
            "CONVICTION : INSUFFISANT", "Conviction : (garder)", "pas de mot", "CONVICTION VENDRE")]),
            (d % 7 + 1).cast("int")),
        F.lit("\nRISQUE ÉVÉNEMENTIEL : "),
        F.element_at(F.array(F.lit("OUI"), F.lit("non"), F.lit("EARNINGS NON TROUVÉ"), F.lit("?")),
                     (d % 4 + 1).cast("int")),
        F.lit("\nRÉSUMÉ : "))
    section = F.concat(F.lit("=== TICKER : "), header, F.lit(" ===\n"), lines, F.col("text"),
                       F.lit("\nPOUR : hausse\nCONTRE : baisse\n"))
    lots = (
        table(spark, sf_dir, "documents")
        .select(F.floor(d / 5).cast("bigint").alias("batch_id"),
                F.struct(d.alias("doc_id"), ticker.alias("ticker"), section.alias("section")).alias("s"))
        # Five documents per lot by construction.
        .groupBy("batch_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    )
    order_line = F.when(F.col("batch_id") % 4 == 3, F.lit("")).otherwise(F.concat(
        F.lit("\n**CLASSEMENT** : "), F.array_join(F.reverse("s.ticker"), " > "), F.lit("\n")))
    return lots.select(
        "batch_id", F.date_add(F.lit("2001-01-01").cast("date"), (F.col("batch_id") % 52 * 7)
                               .cast("int")).alias("week"),
        F.col("s.ticker").alias("expected_tickers"),
        F.concat(F.lit("LECTURE DU LOT : le classement suit.\n"), order_line,
                 F.array_join("s.section", "\n")).alias("text"),
        F.lit(None).cast("timestamp").alias("submitted_at"))
