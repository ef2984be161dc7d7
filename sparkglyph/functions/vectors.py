"""Vector, box and image functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def euclidean(a: Column, b: Column) -> Column:
    """SF-24: distance in doubles; unequal lengths are an error."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.sqrt(total)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def pad(tokens: Column, n: int, fill: int = 0) -> Column:
    """SF-21: first n tokens, filled up at the end."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(fill), F.lit(n))), 1, n)


def multi_hot(labels: Column, n: int) -> Column:
    """SF-22: label ids to n doubles."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(labels, i).cast("double"))


def from_multi_hot(hot: Column) -> Column:
    """SF-22: n numbers to the ids above 0.5."""
    return F.filter(F.transform(hot, lambda v, i: F.when(v > 0.5, i)), lambda i: i.isNotNull())


def threshold(scores: Column, t: float) -> Column:
    """SF-23: strictly above."""
    return F.transform(scores, lambda y: (y > t).cast("int"))


def blend(a: Column, b: Column, share: float = 0.5) -> Column:
    """SF-25."""
    return F.zip_with(a, b, lambda x, y: share * x + (1 - share) * y)


def scale_box(x0: Column, y0: Column, x1: Column, y1: Column, rw, rh, w: Column, h: Column, padding: float = 0.1) -> list[Column]:
    """SF-28: a box scaled, padded (twice as much at its far sides) and clamped to the image."""
    sx0, sx1 = (x0 * rw).cast("int"), (x1 * rw).cast("int")
    sy0, sy1 = (y0 * rh).cast("int"), (y1 * rh).cast("int")
    dx, dy = ((sx1 - sx0) * padding).cast("int"), ((sy1 - sy0) * padding).cast("int")
    zero = F.lit(0)
    return [F.greatest(zero, sx0 - dx).alias("x0"), F.greatest(zero, sy0 - dy).alias("y0"), F.least(w, sx1 + 2 * dx).alias("x1"), F.least(h, sy1 + 2 * dy).alias("y1")]


def rotated_boxes(cells: DataFrame, least: float = 0.6, stride: float = 4.0) -> DataFrame:
    """SF-29, FLT-12: boxes of detector cells (keys, row, col, score, top, right, bottom, left, angle) that are sure enough."""
    c = cells.where(F.col("score") >= least)
    cos, sin, ox, oy = F.cos("angle"), F.sin("angle"), F.col("col") * stride, F.col("row") * stride
    end_x = (ox + cos * F.col("right") + sin * F.col("bottom")).cast("int")
    end_y = (oy - sin * F.col("right") + cos * F.col("bottom")).cast("int")
    c = c.withColumns({"x1": end_x, "y1": end_y})
    return c.withColumns({"x0": (F.col("x1") - (F.col("right") + F.col("left"))).cast("int"), "y0": (F.col("y1") - (F.col("top") + F.col("bottom"))).cast("int")})


def top_down(boxes: Column) -> Column:
    """SRT-01: boxes from top to bottom, then from left to right."""
    key = F.transform(boxes, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b.alias("box")))
    return F.transform(F.array_sort(key), lambda k: k["box"])


def suppress(boxes: DataFrame, key: str, overlap: float = 0.3) -> DataFrame:
    """SF-30: greedy non-maximum suppression per image. boxes: key, x0, y0, x1, y1, score; ties in score go to the last by coordinates."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = pdf.sort_values(["score", "x0", "y0", "x1", "y1"], ascending=False, ignore_index=True)
        xy = b[["x0", "y0", "x1", "y1"]].to_numpy(float)
        area = (xy[:, 2] - xy[:, 0] + 1) * (xy[:, 3] - xy[:, 1] + 1)
        alive, kept = np.ones(len(b), bool), []
        for i in range(len(b)):
            if alive[i]:
                kept.append(i)
                w = np.minimum(xy[:, 2], xy[i, 2]) - np.maximum(xy[:, 0], xy[i, 0]) + 1
                h = np.minimum(xy[:, 3], xy[i, 3]) - np.maximum(xy[:, 1], xy[i, 1]) + 1
                alive &= np.maximum(w, 0) * np.maximum(h, 0) / area <= overlap
        return b.iloc[kept]

    return boxes.groupBy(key).applyInPandas(run, boxes.schema)


def fit_size(w: Column, h: Column, multiple: int = 32) -> list[Column]:
    """SF-31: the nearest lower multiple of each side, and the ratios back."""
    nw, nh = F.greatest(F.lit(multiple), F.floor(w / multiple) * multiple), F.greatest(F.lit(multiple), F.floor(h / multiple) * multiple)
    return [nw.alias("nw"), nh.alias("nh"), (w / nw).alias("rw"), (h / nh).alias("rh")]


def subtract_mean(pixels: Column, mean: list[float]) -> Column:
    """SF-31: channel means taken from interleaved pixels."""
    m = F.array(*map(F.lit, mean))
    return F.transform(pixels, lambda v, i: v - F.element_at(m, (i % len(mean) + 1).cast("int")))


def tensor(img: Column, channels: int) -> Column:
    """SF-19, SF-20: packed image (mode, w, h, data) to numbers in 0..1, for images that already have the wanted size and channels."""

    @F.pandas_udf("array<float>")
    def run(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or len(d) != a * b * channels else np.frombuffer(d, np.uint8).astype(np.float32) / 255 for d, a, b in zip(data, w, h)])

    return run(img["data"], img["w"], img["h"])
