"""Learning operators: Spark ML and numpy in place of a deep-learning backend."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExtractionConf:
    """EXT-05: what contextual texts to gather."""

    scope: str = "parent"
    languages: tuple[str, ...] = ("english",)
    ocr: bool = False


@dataclass(frozen=True)
class PreProcessConf:
    stop: tuple[str, ...] = ()
    min_support: int = 1
    length: int = 20
    least_size: int = 5
    ratio: float = 10.0


@dataclass(frozen=True)
class TrainConf:
    repeats: int = 3
    split: dict = field(default_factory=lambda: {"train": 0.7, "valid": 0.1, "test": 0.2})
    buckets: int = 1 << 12
    regularisation: float = 0.01
    threshold: float = 0.5


#: EXT-01: named transforms.
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def client(name: str) -> Callable[[Callable], Callable]:
    """EXT-01: registers a DataFrame transform under a name."""

    def add(f: Callable) -> Callable:
        REGISTRY[name] = f
        return f

    return add


def run_client(name: str, df: DataFrame, params: list[str] = ()) -> DataFrame:
    """EXT-01: runs a registered transform; parameters are `key=value` strings."""
    return df.transform(REGISTRY[name], **dict(p.split("=", 1) for p in params))


def encode(tokens: Column, vector: Column, buckets: int) -> Column:
    """Counts of hashed tokens beside the image's vector, as one array."""

    @F.pandas_udf("array<double>")
    def run(t: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([np.bincount(np.asarray(a if a is not None else [], int) % buckets, minlength=buckets).astype(float), np.asarray(b if b is not None else [], float)]) for a, b in zip(t, v)])

    return run(tokens, vector)


def train_labels(rows: DataFrame, labels: list[int], conf: TrainConf = TrainConf()):
    """ML-04, ML-05: one logistic model per label on (tokens, vector, labels); returns {label: model}."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("features", array_to_vector(encode(F.col("tokens"), F.col("vector"), conf.buckets))).select("features", "labels").persist()
    out = {}
    for label in labels:
        y = data.withColumn("label", F.array_contains("labels", label).cast("double"))
        out[label] = LogisticRegression(regParam=conf.regularisation, maxIter=40).fit(y)
    data.unpersist()
    return out


def predict_labels(rows: DataFrame, models: dict, conf: TrainConf = TrainConf()) -> DataFrame:
    """ML-06, ML-07: adds probs, a probability for each label in order, in one pass over the rows."""
    order = sorted(models)
    w = np.array([models[k].coefficients.toArray() for k in order])
    b = np.array([models[k].intercept for k in order])

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        z = np.stack(x.to_numpy()) @ w.T + b if len(x) else np.zeros((0, len(b)))
        return pd.Series(list(1 / (1 + np.exp(-np.clip(z, -30, 30)))))

    return rows.withColumn("probs", run(encode(F.col("tokens"), F.col("vector"), conf.buckets)))


def co_attention(text: np.ndarray, image: np.ndarray, weight: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ML-03: attended text and image vectors from their affinity; masked positions get a weight of about nothing."""
    affinity = np.tanh(text @ weight @ image.T)
    t, i = affinity.max(axis=1), affinity.max(axis=0)
    if mask is not None:
        t = np.where(mask, t, -10000.0)
    soft = lambda x: (e := np.exp(x - x.max())) / e.sum()
    return soft(t) @ text, soft(i) @ image


def attend(text: Column, image: Column, weight: np.ndarray) -> Column:
    """ML-03 over arrays of vectors: attended text and image, concatenated."""

    @F.pandas_udf("array<float>")
    def run(t: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate(co_attention(np.stack(a).astype(float), np.stack(b).astype(float), weight)) for a, b in zip(t, i)])

    return run(text, image)


def image_features(img: Column, model: Callable[[bytes, int, int], list[float]] | None = None, dim: int = 100) -> Column:
    """ML-02, EXT-02: features of a packed image by a plug-in model; mean and deviation of blocks of its bytes without one."""

    @F.pandas_udf("array<float>")
    def run(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        def one(d, a, b):
            if d is None:
                return None
            if model is not None:
                return model(d, a, b)
            parts = np.array_split(np.frombuffer(d, np.uint8) / 255.0, dim // 2)
            return [float(f(p)) if len(p) else 0.0 for p in parts for f in (np.mean, np.std)]

        return pd.Series([one(*x) for x in zip(data, w, h)])

    return run(img["data"], img["w"], img["h"])


def recognise(img: Column, engines: list[Callable[[bytes], list[str]]] | None = None) -> Column:
    """ML-12: texts in an image by the first engine that finds any; none without engines."""

    @F.pandas_udf("array<string>")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([next((t for e in engines or [] if (t := e(d))), []) if d is not None else [] for d in data])

    return run(img["data"])
