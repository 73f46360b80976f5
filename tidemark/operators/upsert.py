"""Keyed merges: pure DataFrame forms, and writers that rewrite only touched partitions.

Plain Parquet has no MERGE; a merge is an anti-join plus a union, and the writer overwrites the
partitions the increment touches.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.asof import one_per_key
from tidemark.session import stage, staging


def newest(delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Drop duplicate keys of an increment, the greatest by ``order`` wins."""
    return one_per_key(delta, keys, order)


def merge(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace rows of the same key; ``delta`` must be unique by key."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(
        delta, allowMissingColumns=True).select(*base.columns)


def merge_with_policy(base: DataFrame, delta: DataFrame, keys: list[str],
                      policy: Mapping[str, str]) -> DataFrame:
    """Merge column by column.

    Policies: ``new`` (incoming wins, nulls too), ``old_else_new`` (keep a known value),
    ``insert_only`` (incoming only for new keys).
    """
    old, new = base.withColumn("_old", F.lit(True)), delta.withColumn("_new", F.lit(True))
    joined = old.alias("o").join(new.alias("n"), keys, "full")
    is_new_key = F.col("o._old").isNull()
    out = []
    for name in base.columns:
        if name in keys:
            out.append(F.col(name))
            continue
        before, after = F.col(f"o.{name}"), F.col(f"n.{name}")
        rule = policy.get(name, "new")
        if rule == "new":
            merged = F.when(F.col("n._new").isNotNull(), after).otherwise(before)
        elif rule == "old_else_new":
            merged = F.coalesce(before, after)
        elif rule == "insert_only":
            merged = F.when(is_new_key, after).otherwise(before)
        else:
            raise ValueError(f"unknown policy {rule!r} for {name}")
        out.append(merged.alias(name))
    return joined.select(*out)


def update_from(base: DataFrame, staged: DataFrame, keys: list[str],
                columns: list[str] | None = None) -> DataFrame:
    """Rows with a staged partner take its columns (nulls too); other staged rows are ignored."""
    columns = columns or [c for c in staged.columns if c not in keys and c in base.columns]
    s = staged.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in columns],
                      F.lit(True).alias("_hit"))
    out = [
        F.when(F.col("_hit").isNotNull(), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c)
        for c in base.columns
    ]
    return base.join(s, keys, "left").select(*out)


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(
        rows.join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def month_of(column: str = "date") -> Column:
    """Partition value such as 200111, which reads back as the same integer."""
    return F.year(column) * 100 + F.month(column)


def write_partitioned(df: DataFrame, path: str, partition: str, mode: str = "overwrite") -> None:
    """Overwrite only the partitions present in ``df``; the rest of the table stays."""
    # Spark splits large partition values over several writers and keeps small ones in one.
    (df.hint("rebalance", partition).write
       .option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy(partition).parquet(path))


def upsert_table(spark: SparkSession, path: str, delta: DataFrame, keys: list[str],
                 date: str = "date") -> None:
    """Merge an increment into a table partitioned by month, touching only its months.

    The list of months is short whatever the size of the increment; it prunes the read to those
    partitions. The merged months are staged before they overwrite the partitions they came from.
    """
    with staging(spark):
        delta = stage(delta.withColumn("month", month_of(date)), "delta")
        months = [r.month for r in delta.select("month").distinct().collect()]
        touched = spark.read.parquet(path).where(F.col("month").isin(months))
        write_partitioned(stage(merge(touched, delta, keys), "upsert"), path, "month")


def replace_day(df: DataFrame, path: str, day_column: str, emptied: list[str] | None = None) -> None:
    """Replace the days present in ``df`` (a short report each) in a table partitioned by day.

    ``emptied`` lists days whose new report has no rows: what is stored for them goes.
    """
    spark = df.sparkSession
    for day in emptied or []:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"{day_column}={day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    (df.repartition(day_column).write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
       .partitionBy(day_column).parquet(path))
