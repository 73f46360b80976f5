"""Ten-day label, training set, time-ordered validation, random forest and scoring."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark import constants as C
from tidemark.functions import indicators as I
from tidemark.operators.ranking import ranked
from tidemark.schemas import finite
from tidemark.session import stage
from tidemark.sources import landed as L

# Numeric features and what replaces a missing one in training.
NUMERIC = ("rsi_14", "vol_avg_20", "sma_200", "bb_lower", "rsi_slope", "vol_ratio", "dist_sma200",
           "bb_position", "signal", "market_cap", "pe_ratio")
FILLS = {"rsi_slope": 0.0, "vol_ratio": 1.0, "dist_sma200": 0.0, "bb_position": 0.0}
REGIMES = ("BULL", "BEAR", "NEUTRE")
REGIME_NAMES = {"HAUSSIER": "BULL", "BAISSIER": "BEAR"}
UNKNOWN_SECTOR = "INCONNU"
SIGNAL_WEIGHT = 5.0
FOLDS = 5
MIN_ROWS = 200
MIN_PRECISION = 0.52


def label(bars: DataFrame) -> DataFrame:
    """1 when the price ten bars later is at least 5% higher, else 0; null near the end."""
    later = F.lead("adj_close", C.LABEL_HORIZON).over(I.by_ticker())
    rows = L.valid_bars(bars).withColumn("_later", later)
    return rows.select("ticker", "date", "adj_close", F.when(
        F.col("_later").isNotNull(),
        (F.col("_later") >= F.col("adj_close") * C.LABEL_GAIN).cast("int")).alias("target"))


def label_share(labels: DataFrame) -> DataFrame:
    """Rows per label and share of all labelled rows in percent."""
    counts = labels.where("target IS NOT NULL").groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    # Two rows: the window over all of them is tiny.
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(whole), 2))


def training_rows(indicators: DataFrame, labels: DataFrame, signals: DataFrame,
                  instruments: DataFrame) -> DataFrame:
    """Labelled indicator rows of known instruments, infinities as null."""
    rows = indicators.select("ticker", "date", "rsi_14", "vol_avg_20", "sma_200", "bb_lower",
                             "rsi_slope", "vol_ratio", "dist_sma200", "bb_position", "regime")
    rows = rows.join(labels.where("target IS NOT NULL").select("ticker", "date", "target"),
                     ["ticker", "date"])
    rows = rows.join(signals.select("ticker", "date", F.col("signal").cast("double").alias("signal")),
                     ["ticker", "date"], "left")
    facts = instruments.select("ticker", "sector", "market_cap", "pe_ratio")
    rows = rows.join(facts, "ticker").where("rsi_14 IS NOT NULL").fillna(0.0, ["signal"])
    return rows.withColumns({c: finite(F.col(c)) for c in NUMERIC if c != "signal"})


def time_index(rows: DataFrame) -> DataFrame:
    """Add ``idx``, the place in time order, and ``n``, the number of rows.

    Ties within a day follow a hash of the ticker, which also spreads a day over 256 groups.
    """
    bucket = F.substring(F.md5("ticker"), 1, 2)
    placed = ranked(rows, ["date"], bucket, [F.md5("ticker"), F.col("ticker")], "_in_day")
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("_size"))
    # One row per calendar day: a single ordered window is small.
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = days.withColumns({
        "_offset": F.coalesce(F.sum("_size").over(before), F.lit(0)),
        "n": F.sum("_size").over(everything)}).drop("_size")
    return placed.join(offsets, "date").withColumn(
        "idx", F.col("_offset") + F.col("_in_day") - 1).drop("_offset", "_in_day")


def known_sectors(rows: DataFrame) -> list[str]:
    """Category list of the sector feature: one feature column each."""
    return sorted(r.sector for r in rows.where("sector IS NOT NULL").select("sector").distinct().collect())


def feature_name(kind: str, value: str) -> str:
    return f"{kind}_" + "".join(ch if ch.isalnum() else "_" for ch in value)


def one_hot(column: Column, kind: str, values: list[str]) -> dict[str, Column]:
    """One indicator per value; values whose names would be the same are told apart by their place."""
    out: dict[str, Column] = {}
    for i, v in enumerate(values):
        name = feature_name(kind, v)
        out[f"{name}_{i}" if name in out else name] = (column == v).cast("double")
    return out


def dataset(rows: DataFrame, sectors: list[str]) -> DataFrame:
    """Filled and encoded features, label, time weight (five-fold on signal rows)."""
    # The median over all rows, from counts per distinct ratio.
    counts = rows.where("pe_ratio IS NOT NULL").groupBy("pe_ratio").agg(F.count(F.lit(1)).alias("f"))
    median = counts.agg(F.percentile("pe_ratio", F.lit(0.5), F.col("f")).alias("_median"))
    regime = F.coalesce("regime", F.lit("NEUTRE"))
    for old, new in REGIME_NAMES.items():
        regime = F.when(regime == old, new).otherwise(regime)
    sector = F.coalesce("sector", F.lit(UNKNOWN_SECTOR))
    place = F.when(F.col("n") > 1, F.col("idx") / (F.col("n") - 1)).otherwise(0.0)
    weight = F.exp(place) * F.when(F.col("signal") == 1, SIGNAL_WEIGHT).otherwise(1.0)
    filled = time_index(rows).join(median).withColumns({
        **{c: F.coalesce(c, F.lit(v)) for c, v in FILLS.items()},
        "pe_ratio": F.coalesce("pe_ratio", "_median")})
    return filled.select(
        "ticker", "date", "idx", "n", *NUMERIC,
        *[c.alias(k) for k, c in {**one_hot(sector, "sector", sectors + [UNKNOWN_SECTOR]),
                                  **one_hot(regime, "regime", list(REGIMES))}.items()],
        F.col("target").cast("double").alias("target"), weight.alias("weight"))


def feature_columns(data: DataFrame) -> list[str]:
    return [c for c in data.columns if c not in ("ticker", "date", "idx", "n", "target", "weight")]


def balanced(data: DataFrame) -> DataFrame:
    """Weight times the balanced class weight of the given rows."""
    sizes = data.groupBy("target").agg(F.count(F.lit(1)).alias("_c"))
    total = data.agg(F.count(F.lit(1)).alias("_t"))
    return data.join(F.broadcast(sizes), "target").join(F.broadcast(total)).withColumn(
        "fit_weight", F.col("weight") * F.col("_t") / (F.col("_c") * 2)).drop("_c", "_t")


def fit(data: DataFrame, columns: list[str]) -> PipelineModel:
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(
        labelCol="target", weightCol="fit_weight", numTrees=100, maxDepth=6, seed=42)
    return Pipeline(stages=[assembler, forest]).fit(balanced(data.fillna(0.0, columns)))


def precision(predicted: DataFrame) -> DataFrame:
    chosen = F.col("prediction") == 1
    return predicted.agg(F.coalesce(
        F.count_if(chosen & (F.col("target") == 1)) / F.nullif(F.count_if(chosen), F.lit(0)),
        F.lit(0.0)).alias("precision"))


def fold_bounds(n: int, folds: int = FOLDS) -> list[tuple[int, int, int]]:
    """Fold, rows to train on and rows to test on, which follow them: training grows by one block a fold."""
    if n < MIN_ROWS:
        raise ValueError(f"training needs {MIN_ROWS} rows, got {n}")
    size = n // (folds + 1)
    return [(fold, n - (folds - fold) * size, size) for fold in range(folds)]


def cross_validate(data: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Precision of each expanding fold: train on all earlier rows, test on the next block."""
    columns = feature_columns(data)
    n = data.agg(F.max("n")).first()[0]
    parts = []
    for fold, start, size in fold_bounds(n or 0, folds):
        model = fit(data.where(F.col("idx") < start), columns)
        test = data.where((F.col("idx") >= start) & (F.col("idx") < start + size))
        scored = model.transform(test.fillna(0.0, columns))
        parts.append(precision(scored).select(F.lit(fold).alias("fold"), F.lit(start).alias("n_train"),
                                              F.lit(size).alias("n_test"), "precision"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    columns: list[str]
    sectors: list[str]
    accuracy: float
    reliable: bool


def train(data: DataFrame, sectors: list[str]) -> Trained:
    """Validate over time, then fit on everything; ``sectors`` is the category list of ``data``."""
    data = stage(data, "training")
    accuracy = cross_validate(data).agg(F.avg("precision")).first()[0]
    columns = feature_columns(data)
    return Trained(fit(data, columns), columns, list(sectors), round(accuracy, 4), accuracy >= MIN_PRECISION)


REGISTRY = "version long, model string, columns array<string>, sectors array<string>, accuracy double, reliable boolean, alarm string"


def save(trained: Trained, path: str) -> None:
    """Publish a model: it is written beside the earlier ones, then one registry row makes it the current one.

    A reader finds the version before or the new one, never half of one. The row states the columns, categories and
    precision, and an alarm where the precision is below what the scores are trusted at.
    """
    version = (registry(path).agg(F.max("version")).first()[0] or 0) + 1
    model = f"model-{version}-{uuid.uuid4().hex}"
    trained.model.write().save(f"{path}/{model}")
    alarm = None if trained.reliable else f"precision {trained.accuracy:.4f} below {MIN_PRECISION}"
    _active().createDataFrame([(version, model, trained.columns, trained.sectors, trained.accuracy, trained.reliable, alarm)], REGISTRY) \
        .coalesce(1).write.mode("append").json(f"{path}/registry")


def registry(path: str) -> DataFrame:
    """Published versions: one row each."""
    spark = _active()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/registry")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).json(f"{path}/registry")


def load(path: str) -> tuple[PipelineModel, list[str], list[str]]:
    """Current model, its feature columns and sector categories."""
    row = registry(path).orderBy(F.col("version").desc(), F.col("model")).first()
    return PipelineModel.load(f"{path}/{row.model}"), list(row.columns), list(row.sectors)


def _active() -> SparkSession:
    return SparkSession.getActiveSession()


def encoded(rows: DataFrame, columns: list[str], sectors: list[str]) -> DataFrame:
    """Rows with the feature columns that enter the model; what is absent or unknown counts as 0.

    Categories are matched by value: ``sectors`` is the list the model was trained with.
    """
    sector = F.coalesce("sector", F.lit(UNKNOWN_SECTOR))
    regime = F.coalesce("regime", F.lit("NEUTRE"))
    for old, new in REGIME_NAMES.items():
        regime = F.when(regime == old, new).otherwise(regime)
    ready = rows.withColumns({**one_hot(sector, "sector", [*sectors, UNKNOWN_SECTOR]), **one_hot(regime, "regime", list(REGIMES))})
    absent = {c: F.lit(0.0) for c in columns if c not in ready.columns}
    ready = ready.withColumns(absent) if absent else ready
    return ready.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in columns})


def score(rows: DataFrame, model: PipelineModel | None, columns: list[str],
          sectors: list[str]) -> DataFrame:
    """Probability of a gain; absent columns count as 0, and without a model so does the score."""
    if model is None:
        return rows.select("ticker", "date", F.lit(0.0).alias("score"))
    return model.transform(encoded(rows, columns, sectors)).withColumn("score", vector_to_array("probability")[1]) \
        .select("ticker", "date", "score")
