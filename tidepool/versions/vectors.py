"""Vector fields: one current vector for each asset and field, written all or nothing, and exact search."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ModelError, ValidationError
from ..functions import dot, vector_norm

DISTANCES = ("cosine", "dot", "l2")


@dataclass(frozen=True)
class VectorField:
    field_id: str
    name: str
    model_id: str
    model_fingerprint: str
    dimension: int
    distance: str

    def __post_init__(self) -> None:
        if self.distance not in DISTANCES:
            raise ValidationError(f"distance must be one of {', '.join(DISTANCES)}")

    @classmethod
    def make(cls, name: str, model_id: str, fingerprint: str, dimension: int, distance: str) -> VectorField:
        return cls("v_" + uuid.uuid4().hex[:12], name, model_id, fingerprint, dimension, distance)

    def same(self, other: VectorField) -> bool:
        return (self.name, self.model_id, self.model_fingerprint, self.dimension, self.distance) == (other.name, other.model_id, other.model_fingerprint, other.dimension, other.distance)


def embed(assets: DataFrame, model: Callable[[list[bytes]], np.ndarray], dimension: int, batch: int = 64) -> DataFrame:
    """asset_id and value for rows (asset_id, content), by batches in the tasks; a wrong shape or a value that is not finite fails the whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                made = np.asarray(model([bytes(x) for x in part["content"]]), np.float32)
                if made.shape != (len(part), dimension) or not np.isfinite(made).all():
                    raise ModelError(f"the model must give {dimension} finite numbers for each image")
                yield pd.DataFrame({"asset_id": part["asset_id"].to_numpy(), "value": list(made)})

    return assets.select("asset_id", "content").mapInPandas(run, "asset_id string, value array<float>")


def targets(assets: DataFrame, current: DataFrame, overwrite: bool) -> DataFrame:
    """The assets that need a vector."""
    return assets if overwrite else assets.join(current.select("asset_id"), "asset_id", "left_anti")


def nearest(vectors: DataFrame, query: Sequence[float], k: int, distance: str = "cosine") -> DataFrame:
    """The k rows (asset_id, value) nearest to one vector, exactly; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    value = F.col("value").cast("array<double>")
    if distance == "l2":
        score = F.sqrt(F.aggregate(F.zip_with(value, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    elif distance == "dot":
        score = -dot(value, q)
    else:
        score = 1 - dot(value, q) / (vector_norm(value) * vector_norm(q))
    return vectors.select("asset_id", score.alias("distance")).orderBy("distance", "asset_id").limit(k)
