"""Column layouts of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

MONEY = T.DecimalType(18, 4)


TYPES = {
    "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "boolean": T.BooleanType(), "decimal(18,4)": MONEY, "array<string>": T.ArrayType(T.StringType()),
}


def _schema(fields: str) -> T.StructType:
    """Layout from ``name type, name type``, without needing a session at import."""
    pairs = [f.split() for f in fields.split(", ")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


BARS = _schema(
    "ticker string, date date, open double, high double, low double, close double, "
    "adj_close double, volume double"
)
INDEX_BARS = _schema("index_ticker string, date date, close double, adj_close double")
ETF_BARS = _schema("ticker_etf string, date date, close double, adj_close double, volume bigint")
FX_RATES = _schema("currency string, date date, rate_per_eur double")
INSTRUMENTS = _schema(
    "ticker string, name string, sector string, industry string, country string, "
    "currency string, market_cap double, pe_ratio double, updated date"
)
SECTOR_ETF = _schema(
    "ticker_etf string, name string, sector string, zone string, index_ticker string, active boolean"
)
STRENGTH = _schema(
    "ticker_etf string, date date, close double, adj_close double, volume bigint, "
    "index_price double, ratio double, ratio_vs_ma50 double, in_force boolean"
)
PORTFOLIOS = _schema("id int, name string, active boolean")
POSITIONS = _schema(
    "id bigint, ticker string, buy_date date, buy_price decimal(18,4), quantity decimal(18,4), "
    "status string, sell_date date, sell_price decimal(18,4), sell_reason string, source string, "
    "comment string, portfolio_id int, quote_currency string, txn_price decimal(18,4), "
    "txn_currency string, invested_eur decimal(18,4)"
)
POSITION_EVENTS = _schema(
    "event_id bigint, event_time timestamp, kind string, position_id bigint, ticker string, "
    "price decimal(18,4), quantity decimal(18,4), event_date date, currency string, "
    "reason string, source string, comment string, portfolio_id int, invested_eur decimal(18,4)"
)
OPINIONS = _schema(
    "week date, ticker string, type string, rank int, conviction string, text string, "
    "summary string, source string, model string, prompt_version string, generated_at timestamp, "
    "price_1w double, price_2w double, price_4w double, "
    "return_1w double, return_2w double, return_4w double, ai_rank int, event_risk boolean"
)
OPINION_BATCHES = _schema(
    "batch_id bigint, week date, expected_tickers array<string>, text string, submitted_at timestamp"
)
SIGNAL_LOG = _schema(
    "id bigint, ticker string, date date, signal boolean, decision string, "
    "price_j0 double, price_j10 double, result_pct double"
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to ``schema``, add absent columns as null, turn NaN and infinities into null."""
    have = set(df.columns)
    out = []
    for field in schema.fields:
        if field.name not in have:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        column = F.col(field.name)
        if field.dataType == T.DateType() and df.schema[field.name].dataType == T.StringType():
            column = F.try_to_date(column)
        column = column.cast(field.dataType)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = finite(column)
        out.append(column.alias(field.name))
    return df.select(*out)


def finite(column):
    """Null instead of NaN or an infinity (NaN compares greater than every number in Spark)."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)
