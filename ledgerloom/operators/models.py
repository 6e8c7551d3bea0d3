"""Models on Spark ML: features in, scores out."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..session import lineage_cut
from . import isotonic
from .macro import transition_matrix
from .scans import moves_between, state_probabilities
from .series import Series
from .sizes import attach_one_row

SEED = 42


def assembler(features: list[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=output, handleInvalid="skip")


@contextmanager
def held(df: DataFrame):
    """Keep a training table while a fit passes over it; lost parts are computed again."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_regression(df: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 4, seed: int = SEED):
    """Boosted regression; rows with a missing feature or label are not used."""
    tree = GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)
    with held(df.dropna(subset=[label, *features]).select(label, *features)) as train:
        return Pipeline(stages=[assembler(features), tree]).fit(train)


def predict(model: PipelineModel, df: DataFrame, name: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Score rows; helper columns are dropped and the score is bounded when asked."""
    scored = model.transform(df).withColumn(name, clip(F.col("prediction"), low, high))
    return scored.select(*df.columns, name)


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight rows so that both classes count the same: n / (2 * n_class)."""
    one = df.agg(F.count(label).alias("__n"), F.sum(F.col(label).cast("double")).alias("__pos"))
    own = F.when(F.col(label) == 1, F.col("__pos")).otherwise(F.col("__n") - F.col("__pos"))
    return attach_one_row(df, one).withColumn(name, F.col("__n") / (2 * own)).drop("__n", "__pos")


def fit_forest(df: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 8, seed: int = SEED):
    """Class-balanced random forest."""
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    )
    with held(balanced_weights(df.dropna(subset=[label, *features]).select(label, *features), label)) as train:
        return Pipeline(stages=[assembler(features), forest]).fit(train)


def positive_probability() -> Column:
    """The chance of class 1; a model that saw no row of it has no such entry, and gives 0."""
    return F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))


def class_probability(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    scored = model.transform(df).withColumn(name, positive_probability())
    return scored.select(*df.columns, name)


def calibrated_probability(
    df: DataFrame, features: list[str], label: str, key: list[str], name: str, folds: int = 3, rounds: int = 10, depth: int = 3
) -> DataFrame:
    """Boosted classifier per fold, calibrated on the rows left out, averaged over folds.

    Calibration is isotonic on all distinct scores; see ``isotonic``. ``df`` is read
    several times a fold and not kept in memory: give a written table.
    """
    labelled = df.dropna(subset=[label, *features]).withColumn("__fold", F.pmod(F.xxhash64(*key), F.lit(folds)))
    train = labelled.select(label, *features, "__fold")
    scored, fitted = df.dropna(subset=features), []
    for k in range(folds):
        tree = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=SEED + k)
        model = Pipeline(stages=[assembler(features), tree]).fit(train.where(F.col("__fold") != k))
        left_out = class_probability(model, train.where(F.col("__fold") == k), "raw")
        fitted.append(isotonic.fit(left_out, "raw", label))
        scored = class_probability(model, scored, f"__raw{k}")
    names = [f"__p{k}" for k in range(folds)]
    for k, blocks in enumerate(fitted):
        scored = isotonic.apply(scored, f"__raw{k}", blocks, names[k])
    mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)
    return scored.withColumn(name, clip(mean, 0.0, 1.0)).drop(*names, *(f"__raw{k}" for k in range(folds)))


def multi_horizon(df: DataFrame, features: list[str], targets: dict[int, str], least: int = 10, rounds: int = 10, depth: int = 4) -> dict:
    """One regression per horizon; horizons with too few known targets are left out."""
    with held(df.dropna(subset=features).select(*features, *targets.values())) as train:
        known = train.agg(*[F.count(c).alias(str(h)) for h, c in targets.items()]).first()
        return {
            h: fit_regression(train, features, c, rounds, depth, seed=SEED + h)
            for h, c in targets.items()
            if known[str(h)] >= least
        }


def forecast(models: dict, df: DataFrame) -> DataFrame:
    """A column ``forecast_<h>d_bps`` per fitted horizon.

    Rows are written between models: in one plan, what the optimizer infers about
    the inputs of several models grows with every combination of them.
    """
    for h, model in models.items():
        df = lineage_cut(predict(model, lineage_cut(df, "inputs"), f"forecast_{h}d_bps"), "forecast")
    return df


# Chances that a row counts at most 0, 1, 2, ... times in a resample of its table: a Poisson count with mean 1.
_COUNTS = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def resample_weights(hashes: np.ndarray, passes: int) -> np.ndarray:
    """How often each row counts in each refit (rows x passes); decided by the row's hash, so the same however rows are dealt."""
    x = hashes.astype(np.uint64)[:, None] + (np.arange(passes, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.searchsorted(_COUNTS, u, side="right").astype(np.float64)


def refits(df: DataFrame, lags: list[str], label: str, key: str, passes: int = 100) -> np.ndarray:
    """Coefficients (passes x inputs, the constant first) of linear fits on resampled rows.

    A task adds up, batch by batch, the weighted products of all refits as one
    matrix product; what it hands on is a row of sums for each refit, whatever the
    number of rows.
    """
    names = [*lags, label]
    width = len(names) + 1
    left, right = np.tril_indices(width)
    data = df.dropna(subset=names).select(F.xxhash64(F.lit(SEED), key).alias("h"), *(F.col(c).cast("double") for c in names))

    def sums(batches):
        total = np.zeros((passes, len(left)))
        for batch in batches:
            h = np.asarray(batch.column("h")).view(np.uint64)
            x = np.column_stack([np.ones(batch.num_rows), *(np.asarray(batch.column(c)) for c in names)])
            for at in range(0, len(h), 4096):
                part = x[at : at + 4096]
                total += resample_weights(h[at : at + 4096], passes).T @ (part[:, left] * part[:, right])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(passes, dtype=np.int32)), *map(pa.array, total.T.copy())], ["b", *columns])

    columns = [f"s{i}" for i in range(len(left))]
    partial = data.mapInArrow(sums, "b int, " + ", ".join(f"{c} double" for c in columns))
    # One row for each refit.
    rows = partial.groupBy("b").agg(*(F.sum(c).alias(c) for c in columns)).orderBy("b").collect()
    out = np.zeros((len(rows), width - 1))
    for i, row in enumerate(rows):
        full = np.zeros((width, width))
        full[left, right] = full[right, left] = [row[c] for c in columns]
        out[i] = np.linalg.lstsq(full[:-1, :-1], full[:-1, -1], rcond=None)[0]
    return out


def bootstrap_band(df: DataFrame, lags: list[str], label: str, key: str, latest: DataFrame, passes: int = 100) -> DataFrame:
    """Mean and 5/95 percentile of linear forecasts refitted on resampled rows.

    The refits are a matrix of coefficients, applied to a batch of rows as one product.
    """
    fitted = refits(df, lags, label, key, passes)
    rows, shown = latest.dropna(subset=lags), latest.columns

    def band(batches):
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(np.asarray(batch.column(f"__{c}")) for c in lags)])
            values = x @ fitted.T if len(fitted) else np.full((len(x), 1), np.nan)
            low, high = np.percentile(values, [5, 95], axis=1)
            kept = batch.select(shown)
            added = [pa.array(v, from_pandas=True) for v in (values.mean(axis=1), low, high)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *added], [*shown, "forecast", "lower", "upper"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in latest.schema.fields) + ", forecast double, lower double, upper double"
    return rows.select("*", *(F.col(c).cast("double").alias(f"__{c}") for c in lags)).mapInArrow(band, schema)


def reconstruction_error(df: DataFrame, sequence: str, components: int = 3, name: str = "reconstruction_error") -> DataFrame:
    """Mean squared part of a standardised sequence that the leading components leave out."""
    vectors = df.where(F.col(sequence).isNotNull()).withColumn("__v", array_to_vector(F.col(sequence).cast("array<double>")))
    scaler = StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True)
    pca = PCA(k=components, inputCol="__s", outputCol="__p")
    out = Pipeline(stages=[scaler, pca]).fit(vectors).transform(vectors)

    def squares(c: str) -> Column:
        return F.aggregate(vector_to_array(c), F.lit(0.0), lambda acc, x: acc + x * x)

    error = F.greatest(squares("__s") - squares("__p"), F.lit(0.0)) / F.size(sequence)
    return out.withColumn(name, error).drop("__v", "__s", "__p")


def reduced(df: DataFrame, features: list[str], components: int) -> tuple[PipelineModel, DataFrame]:
    """Standardise and project on the leading components (column ``pcs``)."""
    stages = [
        assembler(features, "raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        PCA(k=components, inputCol="scaled", outputCol="pcs"),
    ]
    model = Pipeline(stages=stages).fit(df)
    return model, model.transform(df).drop("raw", "scaled")


def ordered_labels(df: DataFrame, label: str, by: str) -> DataFrame:
    """Renumber labels by the mean of a feature, so that they mean the same in every run."""
    means = df.groupBy(label).agg(F.avg(by).alias("__m"))
    # One row per label.
    ranks = means.select(label, (F.row_number().over(Window.orderBy("__m")) - 1).alias("__rank"))
    return df.join(F.broadcast(ranks), label).drop(label).withColumnRenamed("__rank", label)


def kmeans_regimes(df: DataFrame, features: list[str], by: str, k: int = 5, components: int = 5) -> DataFrame:
    _, projected = reduced(df, features, components)
    clusters = KMeans(k=k, featuresCol="pcs", predictionCol="regime_id", seed=SEED).fit(projected).transform(projected)
    return ordered_labels(clusters.drop("pcs"), "regime_id", by)


def mixture_regimes(df: DataFrame, features: list[str], series: Series, by: str, k: int = 5, components: int = 5) -> DataFrame:
    """Mixture states given each whole history: ``regime_id``, the likeliest, and ``regime_prob_<i>``.

    Rows give likelihoods, the moves between the likeliest states of single rows give
    the chances of a change, and both passes over the history their probabilities.
    States are numbered by the mean of ``by``; one that is nowhere likeliest comes last.
    """
    _, projected = reduced(df, features, components)
    mixture = GaussianMixture(k=k, featuresCol="pcs", predictionCol="__raw", probabilityCol="__p", seed=SEED, maxIter=30)
    fitted = mixture.fit(projected)
    own = vector_to_array("__p")
    likely = F.array(*(own[i] / max(w, 1e-12) for i, w in enumerate(fitted.weights)))
    scored = lineage_cut(fitted.transform(projected).withColumn("__b", likely).drop("pcs", "__p"), "mixture")
    moves = moves_between(transition_matrix(scored, series, "__raw"), k)
    smoothed = lineage_cut(state_probabilities(scored, series, "__b", moves, np.array(fitted.weights), "__s").drop("__b", "__raw"), "states")
    smoothed = smoothed.withColumn("__state", F.array_position("__s", F.array_max("__s")).cast("int") - 1)
    # One row for each state.
    means = {r["__state"]: r["m"] for r in smoothed.groupBy("__state").agg(F.avg(by).alias("m")).collect() if r["m"] is not None}
    order = sorted(range(k), key=lambda i: (i not in means, means.get(i, 0.0), i))
    number = F.array(*(F.lit(order.index(i)) for i in range(k)))
    return smoothed.select(
        *df.columns, number[F.col("__state")].alias("regime_id"), *(F.col("__s")[i].alias(f"regime_prob_{r}") for r, i in enumerate(order))
    )


def feature_importance(models: list[PipelineModel], features: list[str], spark) -> DataFrame:
    """Mean importance per feature over fitted tree models."""
    values = np.mean([m.stages[-1].featureImportances.toArray() for m in models], axis=0)
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def row_attribution(model: PipelineModel, df: DataFrame, features: list[str], score: Column, keys: list[str]) -> DataFrame:
    """Per row and feature, how the score changes when the feature is at its mean.

    Every row is scored once as it is and once per feature, in one job.
    """
    means = df.agg(*[F.avg(f).alias(f"__m_{f}") for f in features])
    variants = F.explode(F.array(F.lit(None).cast("string"), *[F.lit(f) for f in features]))
    each = attach_one_row(df.dropna(subset=features), means).select("*", variants.alias("feature"))
    masked = each.withColumns(
        {f: F.when(F.col("feature") == f, F.col(f"__m_{f}")).otherwise(F.col(f)) for f in features}
    )
    scored = model.transform(masked).select(*keys, "feature", score.alias("__score"))
    own = F.max(F.when(F.col("feature").isNull(), F.col("__score")))
    columns = [F.max(F.when(F.col("feature") == f, F.col("__score"))).alias(f) for f in features]
    wide = scored.groupBy(*keys).agg(own.alias("__own"), *columns)
    cells = [F.struct(F.lit(f).alias("feature"), (F.col("__own") - F.col(f)).alias("contribution")) for f in features]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def curve_factors(df: DataFrame, tenors: list[str], components: int = 3) -> tuple[DataFrame, list[float]]:
    """Curve factor scores per row and the share of variance each explains."""
    model, projected = reduced(df.dropna(subset=tenors), tenors, components)
    parts = vector_to_array("pcs")
    scores = projected.select("date", *[parts[i].alias(f"factor_{i + 1}") for i in range(components)])
    return scores, [float(v) for v in model.stages[-1].explainedVariance.toArray()]
