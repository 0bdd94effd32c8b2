"""Training frames, walk-forward folds, a persistence and an elastic-net forecaster.

The elastic net needs the data only through its moments (counts, sums, cross products), which one
aggregation gives; coordinate descent then runs on a matrix of the number of features. Moments per
bucket give those of every fold at once: the training rows of a fold are the buckets before it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ("precio_lag_1", "precio_lag_2", "mediana_movil", "dispersion_precios", "usd_uyu_rate")
MIN_WEEKS, CV_SPLITS = 12, 5
KEYS = ["week_start", "canonical_product_id"]


def numbers(df: DataFrame, columns=FEATURES) -> DataFrame:
    """NaN becomes NULL in the columns."""
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in columns})


def targets(snapshots: DataFrame) -> DataFrame:
    week = F.date_format(F.date_trunc("week", "timestamp"), "yyyy-MM-dd")
    rows = snapshots.where("price_usd IS NOT NULL AND NOT isnan(price_usd)")
    return rows.groupBy(week.alias("week_start"), "canonical_product_id").agg(F.median("price_usd").alias("target"))


def with_history(df: DataFrame, least: int = MIN_WEEKS) -> DataFrame:
    """Rows of products with at least ``least`` rows."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy("canonical_product_id"))).where(F.col("_n") >= least).drop("_n")


def forward_fill(df: DataFrame, columns=FEATURES) -> DataFrame:
    w = Window.partitionBy("canonical_product_id").orderBy("week_start").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def training_frame(features: DataFrame, snapshots: DataFrame, least: int = MIN_WEEKS) -> DataFrame:
    """Features joined to targets, products with enough weeks, filled forward, complete rows."""
    frame = numbers(features.select(*KEYS, *FEATURES)).join(targets(snapshots), KEYS)
    return forward_fill(with_history(frame, least)).na.drop(subset=list(FEATURES))


def with_bucket(frame: DataFrame, n_splits: int = CV_SPLITS) -> DataFrame:
    """Rows with ``bucket`` 0 .. n_splits-1 of their place in (week, product) order; the last takes the rest.

    The place is the rows of all earlier weeks (one number a week) plus the rank in its own week, so
    no window holds more than a week.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    weeks = frame.groupBy(F.col("week_start").alias("_week")).agg(F.count("*").alias("_k"))
    all_weeks = Window.orderBy("_week").rowsBetween(Window.unboundedPreceding, -1)
    before = weeks.select("_week", F.coalesce(F.sum("_k").over(all_weeks), F.lit(0)).alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("week_start").orderBy("canonical_product_id"))
    placed = frame.withColumn("_rank", rank).join(before, F.col("week_start") == F.col("_week"))
    size = F.floor(F.col("_n") / n_splits)
    short = F.when(F.col("_n") < n_splits, F.raise_error(F.lit("fewer rows than splits")).cast("bigint"))
    bucket = F.coalesce(short, F.least(F.floor((F.col("_before") + F.col("_rank") - 1) / size), F.lit(n_splits - 1)))
    return placed.withColumn("bucket", bucket.cast("int")).drop("_rank", "_week", "_before", "_n")


def walk_forward(bucketed: DataFrame, n_splits: int = CV_SPLITS) -> DataFrame:
    """(fold, role, row) for folds 1 .. n_splits-1: trained on buckets before, tested on the fold's."""
    folds = F.explode(F.sequence(F.greatest(F.col("bucket"), F.lit(1)), F.lit(n_splits - 1)))
    rows = bucketed.withColumn("fold", folds).withColumn("role", F.when(F.col("bucket") == F.col("fold"), "test").otherwise("train"))
    return rows


def metrics(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """mae, rmse and mape (percent; targets of 0 are left out of it)."""
    e = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))) * 100).alias("mape"))


def mean_of_folds(per_fold: DataFrame) -> DataFrame:
    return per_fold.agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("mape").alias("mape"))


@runtime_checkable
class PriceModel(Protocol):
    """What every forecaster can do."""

    kind: str

    def fit(self, df: DataFrame, target: str = "target") -> PriceModel: ...

    def predict_column(self, columns: list[str]) -> Column: ...

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame: ...

    def to_json(self) -> str: ...


@dataclass
class Naive:
    """Persistence: the price of the week before."""

    kind: str = "naive"

    def fit(self, df: DataFrame, target: str = "target") -> Naive:
        return self

    def predict_column(self, columns: list[str]) -> Column:
        if "precio_lag_1" not in columns:
            raise ValueError("precio_lag_1 is missing")
        return F.col("precio_lag_1")

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.predict_column(df.columns))

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind})


@dataclass
class ElasticNet:
    """Least squares with L1 and L2 penalties on standardised features (population deviation)."""

    alpha: float = 1.0
    l1_ratio: float = 0.5
    columns: tuple[str, ...] = FEATURES
    max_iter: int = 10_000
    tol: float = 1e-10
    means: list[float] = field(default_factory=list)
    scales: list[float] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0
    fitted: bool = False
    kind: str = "elastic_net"

    def fit(self, df: DataFrame, target: str = "target") -> ElasticNet:
        return self.from_moments(*total_moments(bucket_moments(df.withColumn("bucket", F.lit(0)), [*self.columns, target]).values()))

    def from_moments(self, n: int, sums: np.ndarray, cross: np.ndarray, shift: np.ndarray) -> ElasticNet:
        """From the number of rows, and sums and cross products of features and target less ``shift``."""
        if not n:
            raise ValueError("no rows to fit")
        mean = sums / n
        self.solve(cross / n - np.outer(mean, mean), mean + shift)
        return self

    def solve(self, m: np.ndarray, means: np.ndarray) -> None:
        """From centred second moments (features, then target) and means."""
        k = len(self.columns)
        scales = np.sqrt(np.diag(m)[:k])
        scales[scales < 1e-12] = 1.0
        gram, corr = m[:k, :k] / np.outer(scales, scales), m[:k, k] / scales
        l1, l2 = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)
        w = np.zeros(k)
        for _ in range(self.max_iter):
            moved = 0.0
            for j in range(k):
                rho = corr[j] - gram[j] @ w + gram[j, j] * w[j]
                new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (gram[j, j] + l2)
                moved = max(moved, abs(new - w[j]))
                w[j] = new
            if moved < self.tol:
                break
        self.means, self.scales = means[:k].tolist(), scales.tolist()
        self.coefficients, self.intercept, self.fitted = w.tolist(), float(means[k]), True

    def predict_column(self, columns: list[str]) -> Column:
        if not self.fitted:
            raise ValueError("the model is not fitted")
        missing = set(self.columns) - set(columns)
        surplus = set(columns) & set(FEATURES) - set(self.columns)
        if missing or surplus:
            raise ValueError(f"feature columns differ: missing {sorted(missing)}, not trained on {sorted(surplus)}")
        out = F.lit(self.intercept)
        for c, mean, scale, w in zip(self.columns, self.means, self.scales, self.coefficients):
            out = out + (F.col(c) - F.lit(mean)) / F.lit(scale) * F.lit(w)
        return out

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.predict_column(df.columns))

    def importances(self) -> list[tuple[str, float]]:
        if not self.fitted:
            raise ValueError("the model is not fitted")
        return sorted(zip(self.columns, self.coefficients), key=lambda x: -abs(x[1]))

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "alpha": self.alpha, "l1_ratio": self.l1_ratio, "columns": list(self.columns), "means": self.means, "scales": self.scales, "coefficients": self.coefficients, "intercept": self.intercept})

    @staticmethod
    def from_json(text: str) -> ElasticNet:
        d = json.loads(text)
        return ElasticNet(d["alpha"], d["l1_ratio"], tuple(d["columns"]), means=d["means"], scales=d["scales"], coefficients=d["coefficients"], intercept=d["intercept"], fitted=True)


def bucket_moments(bucketed: DataFrame, names: list[str]) -> dict[int, tuple]:
    """{bucket: (rows, sums, cross products, shift)} of the columns less their means over all rows, in two aggregations."""
    means = bucketed.agg(*(F.avg(c).alias(f"s{i}") for i, c in enumerate(names))).first()
    shift = np.array([float(x or 0.0) for x in means])
    c = [F.col(n) - F.lit(float(shift[i])) for i, n in enumerate(names)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    out = {}
    for row in bucketed.groupBy("bucket").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"c{i}") for i, x in enumerate(c)), *(F.sum(c[i] * c[j]).alias(f"m{i}_{j}") for i, j in pairs)).collect():
        cross = np.zeros((len(names), len(names)))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = row[f"m{i}_{j}"]
        out[row["bucket"]] = (row["n"], np.array([row[f"c{i}"] for i in range(len(names))], dtype=float), cross, shift)
    return out


def total_moments(parts) -> tuple:
    parts = list(parts)
    if not parts:
        return 0, np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    return (*(reduce(lambda a, b: a + b, (p[k] for p in parts)) for k in range(3)), parts[0][3])


def save_model(spark, model, folder: str, name: str, metadata: dict | None = None) -> None:
    """One JSON row per model, with its metadata beside it; the kind is part of it, so either forecaster can be the winner."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/model_{name}")
    if metadata is not None:
        spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata_{name}")


def load_latest(spark, folder: str):
    """(name, model) of the lexicographically last model of a folder."""
    row = spark.read.text(f"{folder}/model_*").select("value", F.regexp_extract(F.input_file_name(), r"/model_([^/]+)/[^/]*$", 1).alias("name")).orderBy(F.desc("name")).first()
    if row is None:
        raise FileNotFoundError(f"no model in {folder}")
    return row["name"], (ElasticNet.from_json(row["value"]) if json.loads(row["value"])["kind"] == "elastic_net" else Naive())


def load_metadata(spark, folder: str, name: str) -> dict | None:
    """The metadata saved with a model; None without any."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(f"{folder}/metadata_{name}").first()
    except AnalysisException:
        return None
    return json.loads(row["value"]) if row else None


def model_id(spark, folder: str, name: str) -> str:
    """The id that predictions carry: the model's kind from its metadata, else the name of the artifact."""
    found = load_metadata(spark, folder, name)
    return f"model_{name}" if found is None else found.get("model", "unknown")


def training_metadata(frame: DataFrame, winner, scores: dict[str, dict], trained_on: str) -> dict:
    """What is kept about a training: the model, its date, rows, products, features, and the metrics of each forecaster."""
    row = frame.agg(F.count("*").alias("n"), F.count_distinct("canonical_product_id").alias("k")).first()
    return {"model": winner.kind, "train_date": trained_on, "train_rows": row["n"], "skus": row["k"], "features": list(FEATURES), **{f"metrics_{k}": v for k, v in scores.items()}, "metrics_winner": scores[winner.kind]}


def fold_models(bucketed: DataFrame, make_model, n_splits: int = CV_SPLITS) -> dict[int, PriceModel]:
    """{fold: model fitted on the buckets before it}."""
    probe = make_model()
    if not isinstance(probe, ElasticNet):
        return {fold: make_model().fit(bucketed.where(F.col("bucket") < fold)) for fold in range(1, n_splits)}
    moments = bucket_moments(bucketed, [*probe.columns, "target"])
    return {fold: make_model().from_moments(*total_moments(m for b, m in moments.items() if b < fold)) for fold in range(1, n_splits)}


def fold_predictions(bucketed: DataFrame, make_model, n_splits: int = CV_SPLITS, out: str = "prediction") -> DataFrame:
    """The test rows of all folds with ``fold`` and the prediction of the fold's own model, in one pass."""
    rows = bucketed.where(F.col("bucket").between(1, n_splits - 1)).withColumn("fold", F.col("bucket"))
    columns = [c for c in bucketed.columns]
    return rows.withColumn(out, F.coalesce(*(F.when(F.col("fold") == fold, m.predict_column(columns)) for fold, m in fold_models(bucketed, make_model, n_splits).items())))


def cross_validate(bucketed: DataFrame, make_model, n_splits: int = CV_SPLITS) -> DataFrame:
    """(fold, mae, rmse, mape) with a fresh model for each fold."""
    return metrics(fold_predictions(bucketed, make_model, n_splits), "target", "prediction", ["fold"])


def compare_models(bucketed: DataFrame, n_splits: int = CV_SPLITS) -> dict[str, dict]:
    """{kind: mean metrics of its folds} of the two forecasters."""
    return {m().kind: mean_of_folds(cross_validate(bucketed, m, n_splits)).first().asDict() for m in (ElasticNet, Naive)}


def choose_model(bucketed: DataFrame, n_splits: int = CV_SPLITS, scores: dict[str, dict] | None = None):
    """The forecaster of the lower mean MAPE (the elastic net on a tie), fitted on all rows."""
    scores = scores or compare_models(bucketed, n_splits)
    return (ElasticNet() if scores["elastic_net"]["mape"] <= scores["naive"]["mape"] else Naive()).fit(bucketed)


def rejoined(rows: DataFrame, predictions: dict[str, DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """``rows`` with each forecaster's ``prediction`` under its name, joined by the keys of the row; only rows that all predicted."""
    for name, p in predictions.items():
        rows = rows.join(p.select(*keys, F.col("prediction").alias(name)), keys)
    return rows


def latest_week(features: DataFrame) -> DataFrame:
    last = features.agg(F.max("week_start").alias("_last"))
    return features.join(F.broadcast(last), F.col("week_start") == F.col("_last")).drop("_last")


def predictions(features: DataFrame, model, model_id: str, run_at: str) -> DataFrame:
    """Banded predictions of the latest week's complete rows."""
    rows = numbers(latest_week(features.select(*KEYS, *FEATURES))).na.drop(subset=list(FEATURES))
    p = model.predict(rows, "predicted_price_usd")
    return p.select(*KEYS, "predicted_price_usd", (F.col("predicted_price_usd") * 0.9).alias("lower_bound"), (F.col("predicted_price_usd") * 1.1).alias("upper_bound"), F.lit(model_id).alias("model_id"), F.lit(run_at).alias("run_at"))
