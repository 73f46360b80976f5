"""As-of joins and latest-row lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def one_per_key(df: DataFrame, keys: list[str], order: list[str], newest: bool = True) -> DataFrame:
    """One row per key, the greatest (or least) by ``order``.

    An aggregate, so each input partition sends at most one row per key into the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]) \
        .select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], on: str = "date") -> DataFrame:
    return one_per_key(df, keys, [on])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_on: str,
    right_on: str = "date",
    values: dict[str, str] | None = None,
    *,
    tolerance_days: int | None = None,
    strict: bool = False,
    forward: bool = False,
    left_unique: bool = False,
) -> DataFrame:
    """Left join to the nearest right row at or before (``forward``: at or after) ``left_on``.

    ``values`` maps right columns to output names; ``right`` must be unique by ``keys`` and
    ``right_on``. ``strict`` excludes equality. ``tolerance_days`` drops older matches.

    Only the distinct (key, point) pairs of the left side meet the right side in a window, so a
    window partition holds at most two rows per calendar day however many left rows share a key.
    The pairs then go back by an equi-join on key and point, which adaptive execution may split
    when one pair is hot. ``left_unique`` skips that join for a left side already unique.
    """
    values = values or {c: c for c in right.columns if c not in keys and c != right_on}
    payload = F.struct(F.col(right_on).alias("_at"), *[F.col(c).alias(o) for c, o in values.items()])
    points = left if left_unique else \
        left.select(*keys, left_on).where(_all_known(keys + [left_on])).distinct()
    packed = "_left" if left_unique else None
    # A point sorts after a right row of the same day, so that it sees it, unless strict.
    point_tag = 0 if strict else 1
    if left_unique:
        rest = [c for c in left.columns if c not in keys and c != left_on]
        ask = points.select(
            *keys, F.col(left_on).alias("_on"), F.lit(point_tag).alias("_tag"),
            F.lit(True).alias("_ask"),
            (F.struct(*rest) if rest else F.struct(F.lit(1).alias("_none"))).alias(packed))
    else:
        ask = points.select(
            *keys, F.col(left_on).alias("_on"), F.lit(point_tag).alias("_tag"),
            F.lit(True).alias("_ask"))
    known = right.where(_all_known(keys + [right_on])).select(
        *keys, F.col(right_on).alias("_on"), F.lit(1 - point_tag).alias("_tag"),
        F.lit(False).alias("_ask"), payload.alias("_hit"))
    direction = F.col("_on").desc() if forward else F.col("_on").asc()
    window = Window.partitionBy(*keys).orderBy(direction, F.col("_tag")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        ask.unionByName(known, allowMissingColumns=True)
        .withColumn("_hit", F.last("_hit", ignorenulls=True).over(window))
        .where("_ask")
    )
    hit = F.col("_hit")
    if tolerance_days is not None:
        gap = F.abs(F.datediff(F.col("_on"), F.col("_hit._at")))
        hit = F.when(gap <= tolerance_days, hit)
    found = found.withColumn("_hit", hit)
    out = [F.col(f"_hit.{o}").alias(o) for o in values.values()]
    if left_unique:
        back = [F.col(f"_left.{c}").alias(c) for c in rest]
        by_name = {c: F.col(c) for c in keys} | {left_on: F.col("_on").alias(left_on)} \
            | dict(zip(rest, back))
        return found.select(*[by_name[c] for c in left.columns], *out)
    resolved = found.select(*keys, F.col("_on").alias(left_on), *out)
    return left.join(resolved, keys + [left_on], "left").select(*left.columns, *values.values())


def last_known(df: DataFrame, keys: list[str], moment: str, order: list[str], value: str,
               out: str) -> DataFrame:
    """Add the last non-null ``value`` up to each row.

    Rows of a key are cut into hours of ``moment``: the running value is found inside each hour and
    the hours before contribute one row each, so a busy key is spread over many groups.
    """
    rows = df.withColumn("_hour", F.date_trunc("hour", moment))
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    per_hour = rows.groupBy(*keys, "_hour").agg(F.max_by(value, known).alias("_value"))
    before = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_hour.withColumn("_carry", F.last("_value", ignorenulls=True).over(before)) \
        .drop("_value")
    inside = Window.partitionBy(*keys, "_hour").orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    return found.join(carried, keys + ["_hour"]).withColumn(out, F.coalesce("_inside", "_carry")) \
        .select(*df.columns, out)


def _all_known(columns: list[str]) -> Column:
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull()
    return condition


def first_available(values: Column, order: Column, default: Column) -> Column:
    """First known entry of map ``values`` in the order of array ``order``."""
    tried = F.filter(F.transform(order, lambda z: F.try_element_at(values, z)),
                     lambda v: v.isNotNull())
    return F.coalesce(F.try_element_at(tried, F.lit(1)), default)


def daily(series: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and calendar day from the key's first date to the newest date of all keys,
    each carrying the last value known that day.

    For series of few keys (zones, sectors, currencies): the size is keys times days.
    """
    until = series.agg(F.max("date").alias("_until"))
    order = Window.partitionBy(*keys).orderBy("date")
    last = F.coalesce(F.date_sub(F.lead("date").over(order), 1), F.col("_until"))
    rest = [c for c in series.columns if c not in keys and c != "date"]
    known = series.where(_all_known(keys + ["date"])).join(F.broadcast(until))
    return known.withColumn("_last", last).select(
        *keys, *rest, F.explode(F.sequence("date", "_last")).alias("date"))


def join_daily(left: DataFrame, series: DataFrame, keys: list[str], left_on: str,
               values: dict[str, str]) -> DataFrame:
    """As-of join to a series of few keys, as one equi-join on key and day.

    ``left`` is read once and keeps its own partitioning when Spark broadcasts the small daily
    table; otherwise a hot key can be split by day. Days after the newest one count as the newest.
    """
    table = daily(series.select(*keys, "date", *[F.col(c).alias(o) for c, o in values.items()]), keys)
    return left_on_day(left, series, left_on).join(
        table.withColumnRenamed("date", "_day"), keys + ["_day"], "left") \
        .select(*left.columns, *values.values())


def left_on_day(left: DataFrame, series: DataFrame, left_on: str) -> DataFrame:
    """Add ``_day``: the looked-up day, at most the series' newest one."""
    until = F.broadcast(series.agg(F.max("date").alias("_until")))
    day = F.when(F.col(left_on).isNotNull(), F.least(left_on, "_until"))
    return left.join(until).withColumn("_day", day).drop("_until")


def asof_priority(
    left: DataFrame,
    series: DataFrame,
    key: str,
    order: str,
    left_on: str,
    value: str,
    option: str = "zone",
    default: bool = True,
    out: str = "in_force",
) -> DataFrame:
    """As-of lookup that tries several series per row and takes the first with a value.

    ``series`` has (key, option, date, value) for few keys and options; ``left`` has ``key`` and an
    array ``order`` of options. All options of a key and day travel as one small map, so each left
    row is joined once.
    """
    table = daily(series.select(key, option, "date", value), [key, option])
    # At most one entry per option: the collected map holds a handful of zones.
    options = table.where(F.col(value).isNotNull()).groupBy(key, F.col("date").alias("_day")).agg(
        F.map_from_entries(F.collect_list(F.struct(option, value))).alias("_options"))
    return (
        left_on_day(left, series, left_on).join(options, [key, "_day"], "left")
        .withColumn(out, first_available(F.col("_options"), F.col(order), F.lit(default)))
        .select(*[c for c in left.columns if c != out], out)
    )
