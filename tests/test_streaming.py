"""Incremental ingest and refresh."""

import time

from pyspark.sql import functions as F

from helpers import bar_rows, bars, walk, weekdays
from tidemark import schemas as S
from tidemark.plans.analysis import INDICATORS, indicators
from tidemark.streaming import ingest as ST


def land(spark, data, folder):
    spark.createDataFrame(data, S.BARS).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)  # file times order the corrections


def test_batches_equal_one_batch_and_late_corrections_win(spark, tmp_path):
    day = weekdays(60)
    data = bar_rows("A", walk(1, 60), day) + bar_rows("B", walk(2, 60), day)
    fixed = [("A", day[3], 9.0, 9.0, 9.0, 9.0, 9.0, 9.0)]
    out = []
    for name, per_batch in (("many", 1), ("one", 100)):
        root = tmp_path / name
        table, landing, checkpoint = str(root / "t"), str(root / "l"), str(root / "c")
        ST.create_table(bars(spark, data[:10]), table)
        for part in (data[5:70], data[70:], fixed):
            land(spark, part, landing)
        ST.ingest_bars(spark, landing, table, checkpoint, files_per_batch=per_batch)
        ST.ingest_bars(spark, landing, table, checkpoint, files_per_batch=per_batch)
        out.append(sorted(tuple(r) for r in spark.read.parquet(table).select("ticker", "date", "close").collect()))
    assert out[0] == out[1] and len(out[0]) == 120
    assert ("A", day[3], 9.0) in out[0]


def test_only_touched_tail_is_refreshed(spark, tmp_path):
    day = weekdays(120)
    data = bar_rows("A", walk(1, 120), day) + bar_rows("B", walk(2, 120), day)
    old = [r for r in data if r[1] < day[110]]
    table, ind, landing = str(tmp_path / "t"), str(tmp_path / "i"), str(tmp_path / "l")
    ST.create_table(bars(spark, old), table)
    ST.create_table(indicators(bars(spark, old)).select("ticker", "date", *INDICATORS), ind)
    land(spark, [r for r in data if r[0] == "A" and r[1] >= day[110]], landing)
    ST.ingest_and_refresh(spark, landing, table, ind, str(tmp_path / "c"))
    got = spark.read.parquet(ind)
    assert got.where("ticker = 'B'").agg(F.max("date")).first()[0] == day[109]
    want = {r.date: r.rsi_14 for r in indicators(bars(spark, data)).where("ticker = 'A'").collect()}
    newest = got.where("ticker = 'A'").orderBy(F.col("date").desc()).first()
    assert newest.date == day[119] and abs(newest.rsi_14 - want[day[119]]) < 1e-9
