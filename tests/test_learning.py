"""Label, training set, folds and model storage."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import bar_rows, bars, walk, weekdays
from tidemark.plans import learning as ML
from tidemark.plans.analysis import indicators
from tidemark.session import stage


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(0)
    rows = []
    for t in range(3):
        rows += bar_rows(f"T{t}", walk(t, 180, drift=0.002), seed=t)
    b = bars(spark, rows)
    facts = spark.createDataFrame([("T0", "Tech", 1e3, 10.0), ("T1", None, 2e3, None), ("T2", "Energy", 3e3, 30.0)],
                                  "ticker string, sector string, market_cap double, pe_ratio double")
    signal = b.select("ticker", "date", (F.col("volume") > 800).alias("signal"))
    training = stage(ML.training_rows(indicators(b), ML.label(b), signal, facts), "rows")
    return b, facts, training, stage(ML.dataset(training, ML.known_sectors(training)), "data")


def test_label(spark):
    prices = [100.0] * 10 + [105.0, 104.99] + [1.0]
    got = [r.target for r in ML.label(bars(spark, bar_rows("A", prices))).orderBy("date").collect()]
    assert got == [1, 0, 0] + [None] * 10
    share = {r.target: r.pct for r in ML.label_share(ML.label(bars(spark, bar_rows("A", prices)))).collect()}
    assert share == {1: 33.33, 0: 66.67}


def test_dataset(data):
    _, _, training, ds = data
    pdf = ds.orderBy("idx").toPandas()
    n = len(pdf)
    assert list(pdf.idx) == list(range(n)) and (pdf.n == n).all()
    assert pdf.date.is_monotonic_increasing
    for i in (0, n // 2, n - 1):
        want = math.exp(i / (n - 1)) * (5 if pdf.signal[i] == 1 else 1)
        assert math.isclose(pdf.weight[i], want)
    assert (pdf[[c for c in pdf if c.startswith("sector_")]].sum(axis=1) == 1).all()
    assert (pdf[[c for c in pdf if c.startswith("regime_")]].sum(axis=1) == 1).all()
    pe = pdf[pdf.sector_INCONNU == 1].pe_ratio
    known = pdf[pdf.sector_INCONNU == 0].pe_ratio
    assert (pe == known.median()).all()
    assert pdf[["rsi_slope", "vol_ratio", "bb_position"]].notna().all().all()


def test_folds_and_scores(spark, data, tmp_path):
    b, facts, _, ds = data
    n = ds.count()
    cv = ML.cross_validate(ds, folds=2).orderBy("fold").collect()
    assert [(r.n_train, r.n_test) for r in cv] == [(n - 2 * (n // 3), n // 3), (n - n // 3, n // 3)]
    columns = ML.feature_columns(ds)
    trained = ML.Trained(ML.fit(ds, columns), columns, ["Energy", "Tech"], 0.6, True)
    ML.save(trained, str(tmp_path / "m"))
    model, kept, sectors = ML.load(str(tmp_path / "m"))
    assert kept == columns and sectors == ["Energy", "Tech"]
    rows = indicators(b).join(facts, "ticker", "left")
    one = {(r.ticker, r.date): r.score for r in ML.score(rows, model, kept, sectors).collect()}
    two = {(r.ticker, r.date): r.score for r in ML.score(rows, trained.model, kept, ["Tech", "Energy"]).collect()}
    assert one == two and len(one) == 540 and all(0 <= v <= 1 for v in one.values())
    none = ML.score(rows, None, [], [])
    assert none.columns == ["ticker", "date", "score"] and none.agg(F.max("score")).first()[0] == 0.0


def test_categories_are_matched_by_value(spark):
    sectors = ["MIDDLE EAST", "MIDDLE_EAST", *[f"S{i}" for i in range(300)]]
    rows = spark.createDataFrame([("A", "MIDDLE EAST", "HAUSSIER"), ("B", "MIDDLE_EAST", None), ("C", None, "NEUTRE"), ("D", "new", "X")],
                                 "ticker string, sector string, regime string")
    names = list(ML.one_hot(F.lit(""), "sector", [*sectors, ML.UNKNOWN_SECTOR]))
    assert len(set(names)) == 303
    got = {r.ticker: r.asDict() for r in ML.encoded(rows, names + ["regime_BULL", "absent"], sectors).collect()}
    ones = {t: [n for n in names if r[n] == 1] for t, r in got.items()}
    assert ones == {"A": ["sector_MIDDLE_EAST"], "B": ["sector_MIDDLE_EAST_1"], "C": ["sector_INCONNU"], "D": []}
    assert got["A"]["regime_BULL"] == 1 and got["B"]["absent"] == 0


def test_too_few_rows(data):
    with pytest.raises(ValueError):
        ML.cross_validate(data[3].limit(50).withColumn("n", F.lit(50)))
