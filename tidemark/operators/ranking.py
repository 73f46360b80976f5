"""Cross-sectional scaling and ranks that do not gather a whole cross-section in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def min_max_scale(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Add ``<column>_norm`` in [0, 1] per group; a group without spread gets 0.5.

    The extremes come from a pre-aggregated group-by. ``df`` is read twice: stage it first when
    it is expensive.
    """
    extremes = df.groupBy(*groups).agg(
        *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = []
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        scaled.append(F.when(hi - lo > 0, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)
                      .alias(f"{c}_norm"))
    return df.join(extremes, groups).select(*df.columns, *scaled)


def ranked(df: DataFrame, groups: list[str], bucket: Column, order: list[Column],
           out: str = "rank", start: int = 1) -> DataFrame:
    """Row number within groups, exact, computed in two steps.

    ``bucket`` must be monotone in ``order``: all rows of a lower bucket come first. Rows are
    numbered inside (group, bucket) and shifted by the size of the buckets before, so a group with
    a third of all rows is spread over its buckets. ``df`` is read twice.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    return (
        rows.join(offsets, groups + ["_bucket"])
        .withColumn(out, (F.row_number().over(within) + F.col("_offset") + (start - 1)).cast("int"))
        .select(*df.columns, out)
    )


def ranked_by_score(df: DataFrame, groups: list[str], score: str, tie: str,
                    out: str = "rank", buckets: int = 256) -> DataFrame:
    """Rank by descending score in [0, 1], ties by ``tie``."""
    bucket = F.lit(buckets) - F.floor(F.col(score) * buckets)
    return ranked(df, groups, bucket, [F.col(score).desc(), F.col(tie)], out)


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int,
                  out: str = "rank") -> DataFrame:
    """First ``n`` rows per group; Spark cuts each input partition to ``n`` before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)
