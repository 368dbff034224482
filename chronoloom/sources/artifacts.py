"""Stored models: MLlib models per target, the scaler and the column order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Model
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession

from chronoloom.plans.recursive import Predictor
from chronoloom.plans.training import linear_model
from chronoloom.spec import ArtifactMissingError, PanelSpec, PanelValidationError

KINDS = {"trees": GBTRegressionModel, "linear": LinearRegressionModel}
META_SCHEMA = (
    "kind string, window int, horizon int, targets array<string>, drivers array<string>, features array<string>"
)


@dataclass(frozen=True)
class Artifact:
    kind: str
    window: int
    horizon: int
    targets: tuple[str, ...]
    drivers: tuple[str, ...]
    features: tuple[str, ...]
    stats: DataFrame
    models: list[Model]
    #: What a forecast takes: one linear model, or the trees of each target.
    predictor: Predictor | list[Model]


def save(path: str, kind: str, models: list[Model], stats: DataFrame, spec: PanelSpec, horizon: int = 1) -> None:
    """Write models, scaler and metadata; the metadata comes last and marks the artifact complete."""
    if len(models) != len(spec.targets):
        raise PanelValidationError(f"{len(models)} models for {len(spec.targets)} targets.")
    for target, model in zip(spec.targets, models):
        model.write().overwrite().save(f"{path}/models/{target}")
    stats.write.mode("overwrite").parquet(f"{path}/scaler")
    row = (kind, spec.window, horizon, list(spec.targets), list(spec.drivers), list(spec.features))
    meta = stats.sparkSession.createDataFrame([row], META_SCHEMA)
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def _metadata(spark: SparkSession, path: str):
    try:
        row = spark.read.schema(META_SCHEMA).json(f"{path}/metadata").first()
    except AnalysisException as exc:
        raise ArtifactMissingError(f"There is no model at {path}") from exc
    if row is None or row["kind"] not in KINDS:
        raise ArtifactMissingError(f"The model at {path} has no readable metadata")
    return row


def load(spark: SparkSession, path: str, spec: PanelSpec) -> Artifact:
    meta = _metadata(spark, path)
    models = [KINDS[meta["kind"]].load(f"{path}/models/{t}") for t in meta["targets"]]
    if meta["kind"] == "linear":
        predictor: Predictor | list[Model] = linear_model(models, spec.but(window=meta["window"]))
    else:
        predictor = models
    return Artifact(
        meta["kind"],
        meta["window"],
        meta["horizon"],
        tuple(meta["targets"]),
        tuple(meta["drivers"]),
        tuple(meta["features"]),
        spark.read.parquet(f"{path}/scaler"),
        models,
        predictor,
    )


def feature_order(spark: SparkSession, paths: list[str], spec: PanelSpec) -> tuple[str, ...]:
    """Feature order of the first readable artifact, else the panel's own."""
    for path in paths:
        try:
            features = _metadata(spark, path)["features"]
        except ArtifactMissingError:
            continue
        if features:
            return tuple(features)
    return spec.features
