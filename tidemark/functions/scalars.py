"""Scalar expressions: zones, currencies, adaptive stop factor, ledger arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tidemark import constants as C


def zone_priority(ticker: Column, country: Column, by_country_only: bool = False) -> Column:
    """Order in which sector zones are tried for an instrument.

    ``by_country_only`` is the older rule that ignores where the ticker is listed.
    """
    us_first, eu_first = F.array(F.lit("US"), F.lit("EU")), F.array(F.lit("EU"), F.lit("US"))
    european = F.coalesce(country.isin(*C.EU_COUNTRIES), F.lit(False))
    by_country = F.when(european, eu_first).otherwise(us_first)
    if by_country_only:
        return by_country
    return (
        F.when(ticker.endswith(".KS") | ticker.endswith(".KQ"), F.array(F.lit("KR")))
        .when(~ticker.contains("."), us_first)
        .otherwise(by_country)
    )


def home_zone(priority: Column) -> Column:
    """First zone of the priority list; an unknown instrument counts as US."""
    return F.coalesce(F.try_element_at(priority, F.lit(1)), F.lit("US"))


def quote_currency(ticker: Column, declared: Column) -> Column:
    """Declared currency, else the listing's: known suffixes, any other suffix EUR, none USD."""
    by_suffix = reduce(
        lambda chain, item: chain.when(ticker.endswith(item[0]), item[1]),
        C.SUFFIX_CURRENCY.items(),
        F.when(F.lit(False), F.lit(None)),
    ).when(ticker.contains("."), "EUR").otherwise("USD")
    return F.coalesce(F.nullif(declared, F.lit("")), by_suffix)


def adaptive_k(atr: Column, price: Column) -> Column:
    """Trailing-stop factor that widens with volatility, kept within its bounds."""
    raw = F.round(F.lit(C.K_MIN) + atr / price * 100 * C.K_SLOPE, 2)
    return (
        F.when(price <= 0, F.lit(C.K_FALLBACK))
        .when(atr.isNotNull() & price.isNotNull(),
              F.greatest(F.lit(C.K_MIN), F.least(F.lit(C.K_MAX), raw)))
    )


def entry_k(atr: Column, price: Column) -> Column:
    """Adaptive factor with the fallback for a missing or zero range."""
    return F.when(atr > 0, adaptive_k(atr, price)).otherwise(F.lit(C.K_FALLBACK))


def invested(quantity: Column, price: Column) -> Column:
    return F.round(quantity * price, 2)


def result_amount(buy: Column, sell: Column, quantity: Column) -> Column:
    return F.round((sell - buy) * quantity, 2)


def result_pct(buy: Column, sell: Column) -> Column:
    return F.round(F.lit(100) * (sell - buy) / F.nullif(buy, F.lit(0).cast("decimal(18,4)")), 2)


def is_true(condition: Column) -> Column:
    """Condition that is false, not null, when a value is missing."""
    return F.coalesce(condition, F.lit(False))
