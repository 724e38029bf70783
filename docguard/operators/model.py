"""The calibrated logistic risk model, and the pluggable text model.

The risk model is fitted by Newton steps over sums of all rows (newton.py), the text model by pyspark.ml; a fitted
risk model is a few dozen numbers, and scoring is a plain column expression over the feature columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, IDF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docguard.fixed_values import NINE_FEATURES, REGULARISATION_GRID
from docguard.functions.numbers import clip, num, quote
from docguard.functions.signals import is_high_risk, risk_level
from docguard.operators.features import feature_map, replaced
from docguard.operators.linear import BUCKET, SEPARATOR
from docguard.operators.newton import Problem, fit_logistic, fit_sigmoids, held_out_counts, soft_targets
from docguard.operators.splits import aggregates

FOLDS = 3
#: Cut points of so many classes at most are broadcast.
BROADCAST_CLASSES = 100_000


@dataclass(frozen=True)
class FoldModel:
    """One logistic model on standardised features, and its sigmoid calibration."""
    coefficients: list[float]
    intercept: float
    slope: float = 1.0
    offset: float = 0.0


@dataclass(frozen=True)
class RiskModel:
    columns: list[str]
    means: list[float]
    scales: list[float]
    c: float
    folds: list[FoldModel]


def standardise(train: DataFrame, columns: Sequence[str]) -> tuple[list[float], list[float]]:
    """Mean and population deviation per column of the training rows; a constant has scale 1."""
    row = train.agg(*aggregates(*[f"avg({c}) AS m{i}" for i, c in enumerate(columns)],
                                *[f"stddev_pop({c}) AS s{i}" for i, c in enumerate(columns)])).first()
    means = [float(row[f"m{i}"]) for i in range(len(columns))]
    scales = [float(row[f"s{i}"]) or 1.0 for i in range(len(columns))]
    return means, scales


def scaled(columns: Sequence[str], means: Sequence[float], scales: Sequence[float]) -> list[str]:
    return [f"((double({c}) - {num(m)}) / {num(s)})" for c, m, s in zip(columns, means, scales)]


def standardised(df: DataFrame, columns: Sequence[str], means: Sequence[float],
                 scales: Sequence[float]) -> DataFrame:
    return replaced(df, dict(zip(columns, scaled(columns, means, scales))))


def fold_hash(id_column: str, seed: str = "42") -> str:
    return f"xxhash64(concat({quote(seed + ':')}, string({id_column})))"


def with_folds(df: DataFrame, label: str, id_column: str = "sample_id", seed: str = "42") -> DataFrame:
    """Add fold, stratified: each class in the order of its ids' hashes is cut into parts of equal size.

    Only the cut points are looked up, by rank, for all classes at once; rows move only if the classes are too many
    to be broadcast.  Rows that share an id share a fold.
    """
    hashed = df.withColumn("_hash", F.expr(fold_hash(id_column, seed)))
    # ranges of the hash hold equal shares of a class; a rank is looked up inside the range that it falls into
    hashes = hashed.selectExpr(f"{label} AS _class", "_hash", "shiftright(_hash, 50) AS _range").distinct()
    counts = hashes.groupBy("_class", "_range").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "*", "sum(n) OVER (PARTITION BY _class ORDER BY _range) AS upto", "sum(n) OVER (PARTITION BY _class) AS n_total")
    ranks = ", ".join(f"struct({i} AS cut, bigint(ceil(n_total * {i}D / {FOLDS}D)) AS rank)" for i in range(1, FOLDS))
    wanted = counts.selectExpr("_class", "_range", "upto - n AS n_before", "upto", f"explode(array({ranks})) AS at").filter(
        "at.rank > n_before AND at.rank <= upto").groupBy("_class", "_range").agg(
        F.collect_list(F.expr("struct(at.cut AS cut, at.rank - n_before AS place)")).alias("wanted"))
    same = F.col("h._class").eqNullSafe(F.col("w._class")) & (F.col("h._range") == F.col("w._range"))
    placed = hashes.alias("h").join(wanted.alias("w"), same).selectExpr(
        "h._class AS _class", "_hash", "wanted", "row_number() OVER (PARTITION BY h._class, h._range ORDER BY _hash) AS place")
    found = placed.selectExpr("_class", "_hash", "explode(filter(wanted, x -> x.place = place)) AS at")
    cuts = found.groupBy("_class").agg(*[F.expr(f"max(if(at.cut = {i}, _hash, NULL)) AS _cut{i}") for i in range(1, FOLDS)])
    if cuts.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        cuts = F.broadcast(cuts)
    above = " + ".join(f"int(_hash > _cut{i})" for i in range(1, FOLDS))
    return hashed.join(cuts, F.col(label).eqNullSafe(F.col("_class")), "left").withColumn("fold", F.expr(above)).drop(
        "_hash", "_class", *[f"_cut{i}" for i in range(1, FOLDS)])


def fit_risk(train: DataFrame, columns: Sequence[str] = tuple(NINE_FEATURES), label: str = "label",
             grid: Sequence[float] = tuple(REGULARISATION_GRID), seed: str = "42",
             most_iterations: int = 100) -> tuple[RiskModel, list[tuple]]:
    """Choose C by three-fold macro F1, calibrate each fold's model on its held-out rows.

    All folds and all C are fitted side by side: each Newton step is one job (see newton.py), and so are the held-out
    counts of all of them and each step of the three calibrations.  Returns the model and the table of the search: C,
    mean macro F1, the most steps that a fold's fit took, and whether all of them converged within `most_iterations`.
    """
    means, scales = standardise(train, columns)
    z = [f"z{i}" for i in range(len(columns))]
    rows = with_folds(train, label, "sample_id", seed).selectExpr(
        f"double({label}) AS y", "int(fold) AS fold", *[f"{c} AS {name}" for name, c in zip(z, scaled(columns, means, scales))])
    prepared = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {(r["fold"], r["y"]): r["n"] for r in
                 prepared.groupBy("fold", "y").agg(F.expr("count(1) AS n")).collect()}
        candidates = [(fold, c) for fold in range(FOLDS) for c in grid]
        weights = [_class_weights(sizes, fold) for fold in range(FOLDS)]
        fits = fit_logistic(prepared, z, [Problem(fold, weights[fold][0.0], weights[fold][1.0], 1.0 / c) for fold, c in candidates],
                            most_iterations)
        counted = held_out_counts(prepared, z, [f.weights for f in fits], [fold for fold, _ in candidates])
        f1 = [(_f1(tp, errors) + _f1(tn, errors)) / 2 for tp, tn, errors in counted]
        mean_f1 = [sum(f1[fold * len(grid) + i] for fold in range(FOLDS)) / FOLDS for i in range(len(grid))]
        best = max(range(len(grid)), key=lambda i: mean_f1[i])
        chosen = [fits[fold * len(grid) + best] for fold in range(FOLDS)]
        targets = [soft_targets(sizes.get((fold, 1.0), 0), sizes.get((fold, 0.0), 0)) for fold in range(FOLDS)]
        sigmoids = fit_sigmoids(prepared, z, [f.weights for f in chosen], targets)
    finally:
        prepared.unpersist()
    folds = [FoldModel(f.weights[:-1], f.weights[-1], s.weights[0], s.weights[1]) for f, s in zip(chosen, sigmoids)]
    of_c = [[fits[fold * len(grid) + i] for fold in range(FOLDS)] for i in range(len(grid))]
    return RiskModel(list(columns), means, scales, grid[best], folds), [
        (c, score, max(f.steps for f in of), all(f.converged for f in of)) for c, score, of in zip(grid, mean_f1, of_c)]


def _class_weights(sizes: dict, fold: int) -> dict[float, float]:
    """Weights that give both classes equal shares of the rows outside the fold."""
    n = {y: sum(size for (f, label), size in sizes.items() if f != fold and label == y) for y in (0.0, 1.0)}
    if not n[0.0] or not n[1.0]:
        raise ValueError(f"the rows outside fold {fold} are all of one class; too few rows to fit {FOLDS} folds")
    return {y: (n[0.0] + n[1.0]) / (2.0 * n[y]) for y in n}


def _f1(hits: float, errors: float) -> float:
    return 2.0 * hits / (2.0 * hits + errors) if hits else 0.0


def _margin(terms: Sequence[str], model: FoldModel) -> str:
    products = [f"{num(weight)} * {term}" for term, weight in zip(terms, model.coefficients)]
    return f"({' + '.join([num(model.intercept), *products])})"


def risk_probability(model: RiskModel) -> str:
    """Mean of the calibrated fold probabilities over raw feature columns; missing counts 0.0."""
    terms = [f"coalesce(double({c}), 0.0D)" for c in model.columns]
    parts = []
    for fold in model.folds:
        weights = [c / s for c, s in zip(fold.coefficients, model.scales)]
        shift = fold.intercept - sum(w * m for w, m in zip(weights, model.means))
        margin = _margin(terms, FoldModel(weights, shift))
        parts.append(f"1.0D / (1.0D + exp(-({num(fold.slope)} * {margin} + {num(fold.offset)})))")
    return clip(f"({' + '.join(parts)}) / {num(len(model.folds))}")


def score_risk(df: DataFrame, model: RiskModel) -> DataFrame:
    """Add risk_score, risk_level, is_high_risk and the feature map the score was made of."""
    present = df.columns
    scored = replaced(df, {c: "0.0D" for c in model.columns if c not in present})
    scored = replaced(scored, {"risk_score": risk_probability(model)})
    return replaced(scored, {
        "risk_level": risk_level("risk_score"), "is_high_risk": is_high_risk("risk_score"),
        "feature_values": feature_map(model.columns),
    })


def feature_importance(spark: SparkSession, model: RiskModel) -> DataFrame:
    """Feature and magnitude of its mean coefficient, largest first."""
    n = len(model.folds)
    rows = [(c, abs(sum(f.coefficients[i] for f in model.folds) / n)) for i, c in enumerate(model.columns)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


_MODEL_SCHEMA = ("columns array<string>, means array<double>, scales array<double>, c double, "
                 "folds array<struct<coefficients: array<double>, intercept: double, slope: double, offset: double>>")


def save_model(spark: SparkSession, model: RiskModel, path: str) -> None:
    """Write the model, its scaling and its column order as one row."""
    folds = [(f.coefficients, f.intercept, f.slope, f.offset) for f in model.folds]
    row = (model.columns, model.means, model.scales, model.c, folds)
    spark.createDataFrame([row], _MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> RiskModel:
    row = spark.read.schema(_MODEL_SCHEMA).parquet(path).first()
    folds = [FoldModel(list(f["coefficients"]), f["intercept"], f["slope"], f["offset"]) for f in row["folds"]]
    return RiskModel(list(row["columns"]), list(row["means"]), list(row["scales"]), row["c"], folds)


def fit_text_model(df: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16,
                   most_iterations: int = 1000) -> PipelineModel:
    """A bag-of-words text classifier: hashed term counts, IDF, logistic regression.

    Tokens are dealt to buckets by the SQL of linear.BUCKET, so that `linear.compiled` can look weights up in any row.
    """
    buckets = BUCKET.format(t="t", n=features)
    counting = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=SEPARATOR, toLowercase=True),
        SQLTransformer(statement=f"SELECT *, transform(_tokens, t -> string({buckets})) AS _buckets FROM __THIS__"),
        CountVectorizerModel.from_vocabulary([str(i) for i in range(features)], "_buckets", "_counts"),
    ]).fit(df)
    # counted once for both fits
    counted = counting.transform(df.select(text, label)).select("_counts", label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        idf = IDF(inputCol="_counts", outputCol="_features").fit(counted)
        regression = LogisticRegression(
            featuresCol="_features", labelCol=label, regParam=0.01, maxIter=most_iterations,
            probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction").fit(idf.transform(counted))
    finally:
        counted.unpersist()
    return PipelineModel(stages=[*counting.stages, idf, regression])


def text_probability(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add malicious_probability of whole texts from a fitted text model; for windows of long texts see linear.compiled."""
    scored = model.transform(df).withColumn("malicious_probability", vector_to_array("_probability")[1])
    return scored.drop("_tokens", "_buckets", "_counts", "_features", "_probability", "_raw", "_prediction")
