"""Stored tables: what nightly jobs, rankings, searches and published models read and write."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from helpers import bar_rows, bars, rows, walk, weekdays
from tidemark import constants as C, schemas as S
from tidemark.plans import analysis as A, learning as ML, positions as POS, ranking as RK, signals as SG
from tidemark.sources import landed as L
from tidemark.streaming.ingest import create_table


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_slice_of_a_stored_table_prunes_months(spark, tmp_path):
    table = str(tmp_path / "bars")
    b = bars(spark, bar_rows("A", walk(1, 300)))
    create_table(b, table)
    day = weekdays(300)[-1]
    sliced = L.incremental_slice(spark.read.parquet(table), day, 40)
    text = plan(sliced)
    assert "PartitionFilters: [isnotnull(month" in text and "month#" in text.split("PartitionFilters:")[1].split("\n")[0]
    assert sliced.count() == b.where(F.col("date") >= F.lit(day - dt.timedelta(days=40))).count()


def test_nightly_updates_the_newest_days_only(spark, tmp_path):
    b = bars(spark, bar_rows("A", walk(1, 300)) + bar_rows("B", walk(2, 20), weekdays(300)[-20:]))
    stored, table = str(tmp_path / "bars"), str(tmp_path / "ind")
    create_table(b, stored)
    empty = A.indicators(b).select("ticker", "date", *[F.lit(None).cast("string" if c == "regime" else "double").alias(c) for c in A.INDICATORS])
    create_table(empty.where("date != DATE'2021-02-23'"), table)
    files = set(spark.read.parquet(table).inputFiles())
    day = weekdays(300)[-1]
    A.nightly(spark, stored, table, day)
    after = spark.read.parquet(table)
    since = F.lit(day - dt.timedelta(days=C.SAVE_DAYS))
    late = after.where(F.col("date") >= since)
    assert after.count() == empty.count() - 2 and after.where(F.col("date") < since).where("sma_50 IS NOT NULL").count() == 0
    assert late.where("ticker = 'A' AND sma_50 IS NULL").count() == 0 and late.where("ticker = 'A'").count() > 2
    assert late.where("ticker = 'B' AND sma_50 IS NOT NULL").count() == 0  # fewer than 50 rows
    want = A.indicators(L.incremental_slice(b, day)).where(F.col("date") >= since) \
        .where("date != DATE'2021-02-23'").select(*after.drop("month").columns)
    assert rows(late.drop("month"), "ticker", "date") == rows(want, "ticker", "date")
    assert len(files & set(after.inputFiles())) >= len(files) - 2  # older months stay untouched


def test_newest_stored_ranking_is_found_by_the_listing(spark, tmp_path):
    path = str(tmp_path / "rankings")
    assert RK.newest_stored(spark, path).count() == 0
    layout = spark.createDataFrame([], RK.STORED)
    for day, names in (("2024-01-09", "ab"), ("2024-01-10", "cde"), ("2023-12-31", "f"), ("2024-01-10", "gh")):
        made = spark.createDataFrame([(i + 1, n, dt.date.fromisoformat(day)) for i, n in enumerate(names)], "rank int, ticker string, calc_date date")
        RK.store_ranking(layout.unionByName(made, allowMissingColumns=True), path)
    newest = RK.newest_stored(spark, path, 20)
    assert [(r.rank, r.ticker, str(r.calc_date)) for r in newest.collect()] == [(1, "g", "2024-01-10"), (2, "h", "2024-01-10")]
    assert all("calc_date=2024-01-10" in f for f in newest.inputFiles())
    best = min(timed(lambda: RK.newest_stored(spark, path).collect()) for _ in range(8))
    print(f"read in {best * 1000:.0f} ms")
    assert best < 1.0


def timed(job):
    begin = time.perf_counter()
    job()
    return time.perf_counter() - begin


def test_indexed_search_equals_the_scan(spark, tmp_path):
    made = [("NVDA", "Nvidia Corp", "Technology"), ("005930.KS", "Samsung Electronics", "Technology"), ("BRK.B", "Berkshire", None),
            ("AAA", None, None), ("AAAA", "aaaaa", "X"), ("STR", "Straße und Straße", "Y"), ("AB", "ab", "Z"), ("", "Empty sign", None)]
    instruments = spark.createDataFrame(made, "ticker string, name string, sector string")
    path = str(tmp_path / "grams")
    POS.index_instruments(instruments, path)
    for query in ("nvd", "AAA", "aaaa", "samsung", "corp", "5930.k", "strasse", "SSE ", "mpty", "zzz", "nvidia corp", "a c"):
        if len(query.strip()) < 3:
            continue
        assert rows(POS.search_indexed(spark, path, query)) == rows(POS.search_instruments(instruments, query)), query
    found = plan(POS.search_indexed(spark, path, "nvidia"))
    assert "PartitionFilters: [bucket" in found
    with pytest.raises(ValueError):
        POS.search_indexed(spark, path, " ab ")


def test_short_histories_are_refused_as_rows(spark):
    data = bar_rows("LONG", walk(3, 420, drift=0.002, vol=0.015)) + bar_rows("SHORT", walk(4, 301, drift=0.002, vol=0.015))
    out = SG.backtest(SG.signals(bars(spark, data)), (2.0, 3.0))
    got = sorted((r.ticker, r.k or 0, r.outcome, r.sharpe is None) for r in out.collect())
    assert ("SHORT", 0, "REFUSED", True) in got and all(t == "LONG" and o == "TESTED" for t, _, o, _ in got if t != "SHORT")
    assert sum(t == "SHORT" for t, *_ in got) == 1


def test_published_versions(spark, tmp_path):
    rows_ = [("a", weekdays(240)[i % 240], i, 240, *[float(i % 7)] * 2, float(i % 3 == 0), 1.0) for i in range(240)]
    data = spark.createDataFrame(rows_, "ticker string, date date, idx long, n long, f1 double, f2 double, target double, weight double")
    path = str(tmp_path / "m")
    model = ML.fit(data, ["f1", "f2"])
    ML.save(ML.Trained(model, ["f1", "f2"], ["Old"], 0.7, True), path)
    ML.save(ML.Trained(model, ["f1", "f2"], ["New"], 0.4, False), path)
    kept = ML.registry(path).orderBy("version").collect()
    assert [(r.version, r.reliable, r.alarm is None) for r in kept] == [(1, True, True), (2, False, False)]
    assert "0.52" in kept[1].alarm and ML.load(path)[1:] == (["f1", "f2"], ["New"])
    assert ML.registry(str(tmp_path / "none")).count() == 0


def test_seed_funds_are_added_once(spark):
    own = spark.createDataFrame([("XLK", "mine", "Technology", "US", "^X", False)], S.SECTOR_ETF)
    out = L.with_seed_funds(own)
    assert out.count() == len(C.SEED_SECTOR_ETFS) and out.where("ticker_etf = 'XLK'").first().name == "mine"
    assert L.with_seed_funds(out).count() == out.count()


def test_landed_csv_and_json(spark, tmp_path):
    layout = "ticker string, Date date, Close double"
    spark.createDataFrame([("A", "2024-01-02", "1.5"), ("A", "2024-01-03", None)], "ticker string, Date string, Close string") \
        .write.option("header", True).csv(str(tmp_path / "c"))
    spark.createDataFrame([("B", "2024-01-02", 2.5)], "ticker string, Date string, Close double").write.json(str(tmp_path / "j"))
    got = L.landed_bars(L.read_table(spark, str(tmp_path / "c"), layout, "csv", header="true")).unionByName(
        L.landed_bars(L.read_table(spark, str(tmp_path / "j"), layout, "json")))
    assert [(r.ticker, str(r.date), r.close, r.adj_close) for r in got.orderBy("ticker").collect()] == [
        ("A", "2024-01-02", 1.5, 1.5), ("B", "2024-01-02", 2.5, 2.5)]
