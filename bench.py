"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    from tidemark.session import get_spark

    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")

    from pyspark.sql import functions as F

    from tidemark.checks.queries import QUERIES, force, macro
    from tidemark.plans import analysis as A, ranking as RK
    from tidemark.session import new_path, stage
    from tidemark.sources import order_tables as V

    # Supplier series: about a thousand tickers and half a million bars at sf0.1.
    stored = new_path(spark, "bars")
    V.supplier_bars(spark, sf_dir).write.parquet(stored)
    bars = spark.read.parquet(stored)
    report = new_path(spark, "report")
    best = RK.score_candidates(RK.ranking_indicators(bars), bars.agg(F.max("date").alias("date")))
    RK.store_ranking(spark.createDataFrame([], RK.STORED).unionByName(
        best.select("rank", "ticker", "score", "calc_date"), allowMissingColumns=True), report)
    names = [r.ticker for r in bars.select("ticker").distinct().orderBy("ticker").limit(5).collect()]

    def full_ranking():
        ind = RK.ranking_indicators(bars)
        return RK.score_candidates(ind, bars.agg(F.max("date").alias("date")))

    def weekly_ranking():
        ind = stage(RK.ranking_indicators(bars), "ind")
        return RK.score_candidates(ind, RK.mondays(ind), top_n=20)

    jobs = {
        "ranking_indicators_all": lambda: RK.ranking_indicators(bars),
        "full_ranking_run": full_ranking,
        "weekly_ranking_all_mondays": weekly_ranking,
        "analysis_indicators_all": lambda: A.indicators(bars),
        "one_ticker_indicators": lambda: RK.ranking_indicators(bars.where(F.col("ticker") == names[0])),
        "read_stored_ranking": lambda: RK.newest_stored(spark, report),
        **{name: (lambda name=name: QUERIES[name](spark, sf_dir)) for name in (
            "upsert_bars", "asof_fx", "asof_tolerance", "sector_strength", "composite_ranking", "signals_v35",
            "chandelier_exits", "signal_backtest", "exit_check", "config_compare", "position_eval",
            "position_events", "forward_returns", "extract_sections", "extract_conviction", "ml_dataset")},
    }
    force(spark, sf_dir).count(), macro(spark, sf_dir).count()
    timings = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
