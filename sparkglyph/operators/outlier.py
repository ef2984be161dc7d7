"""Neighbourhood-weighted outlier scores per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import euclidean

BLOCK = 4096


def of_group(rows: DataFrame, permissions: str = "perms") -> DataFrame:
    """FLT-20: one row per permission of an item."""
    return rows.withColumn("grp", F.explode(permissions)).drop(permissions)


def neighbours(queries: DataFrame, train: DataFrame, k: int, decimals: int | None = None, others: bool = False) -> DataFrame:
    """JN-19, SET-05, SRT-02: the min(k, distinct) nearest distinct training vectors of each query within its group.

    queries: (id, grp, vector); train: (tid, grp, vector). Returns id, grp, rank,
    tid, vector, distance; equal vectors count once, by their smallest tid, and with
    ``others`` the one whose tid is the query's id does not count. Ties in distance
    (rounded to ``decimals``) go to the smaller tid. Exact: each group's vectors are dealt into blocks of BLOCK that meet blocks of
    queries; a block of queries keeps its k nearest of a block of vectors, and
    these are merged.
    """
    # new column ids on both sides, which may come from one table
    queries = queries.select(*(F.col(c).alias(c) for c in ("id", "grp", "vector")))
    t = train.groupBy("grp", "vector").agg(F.min("tid").alias("tid")).select(*(F.col(c).alias(c) for c in ("grp", "vector", "tid")))
    size = t.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("tn"))
    size = size.join(queries.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qn")), "grp")
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left_size, right_size = (size.select(*(F.col(c).alias(c) for c in ("grp", "tn", "qn"))) for _ in range(2))
    left = queries.select("id", "grp", "vector").join(left_size, "grp").withColumn("qb", dealt("id", "qn")).withColumn("tb", every("tn"))
    right = t.join(right_size, "grp").withColumn("tb", dealt("tid", "tn")).withColumn("qb", every("qn"))
    schema = f"id {queries.schema['id'].dataType.simpleString()}, grp {queries.schema['grp'].dataType.simpleString()}, tid {train.schema['tid'].dataType.simpleString()}, distance double"

    def block(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"id": [], "grp": [], "tid": [], "distance": []})
        v = v.sort_values("tid", ignore_index=True)
        b = np.stack(v["vector"].to_numpy()).astype(float)
        out = []
        tid = v["tid"].to_numpy()
        for i in range(0, len(q), 256):
            a = np.stack(q["vector"].iloc[i : i + 256].to_numpy()).astype(float)
            ids = q["id"].iloc[i : i + 256].to_numpy()
            rough = (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)
            if others:
                rough[ids[:, None] == tid] = np.inf
            # all that may be as near as the kth once rounded, whatever their number
            kth = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
            slack = 1e-9 * ((a * a).sum(1) + (b * b).sum(1).max()) + 1e-12
            reach = (np.sqrt(np.maximum(kth, 0) + slack) + (0 if decimals is None else 10.0**-decimals)) ** 2 + slack
            row, near = np.nonzero((rough <= reach[:, None]) & np.isfinite(rough))
            exact = np.sqrt(((a[row] - b[near]) ** 2).sum(1))
            if decimals is not None:
                exact = exact.round(decimals)
            order = np.lexsort((near, exact, row))
            row, near, exact = row[order], near[order], exact[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(pd.DataFrame({"id": ids[row[top]], "grp": q["grp"].iloc[0], "tid": tid[near[top]], "distance": exact[top]}))
        return pd.concat(out)

    near = left.groupBy("grp", "qb", "tb").cogroup(right.groupBy("grp", "qb", "tb")).applyInPandas(block, schema)
    rank = F.row_number().over(Window.partitionBy("id", "grp").orderBy("distance", "tid"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return near.join(t.select("grp", "tid", "vector"), ["grp", "tid"]).select("id", "grp", "rank", "tid", "vector", "distance")


def neighbourhood_weight(near: DataFrame, cap: float = 1e6) -> DataFrame:
    """AGG-20, ML-09: (id, grp, weight): inverse of the mean pairwise distance of the neighbours, of the distance to a single one; ``cap`` for distance 0.

    Pairs stay within a query's k neighbours.
    """
    g = near.groupBy("id", "grp").agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "vector"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: euclidean(x["vector"], y["vector"]))))
    mean = F.when(F.size("v") == 1, F.col("v")[0]["distance"]).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, d: a + d) / F.size(pairs))
    return g.select("id", "grp", inverse(mean, cap).alias("weight"))


def inverse(distance: Column, cap: float = 1e6) -> Column:
    """1 / distance; a missing neighbourhood counts as distance 1, distance 0 gives the cap."""
    d = F.coalesce(distance, F.lit(1.0))
    return F.when(d == 0, F.lit(cap)).otherwise(F.least(1 / d, F.lit(cap)))


def fuse(scores: DataFrame, weights: DataFrame, predictions: DataFrame, share: float = 0.5) -> DataFrame:
    """SF-25, AGG-19, ML-10: (id, score): sum over an item's groups of score * (share * weight + (1 - share) * (1 - prob)). Groups an item lacks add nothing."""
    all_ = scores.join(weights, ["id", "grp"], "left").join(predictions, ["id", "grp"], "left")
    w = share * F.coalesce("weight", F.lit(1.0)) + (1 - share) * (1 - F.coalesce("prob", F.lit(0.0)))
    return all_.groupBy("id").agg(F.sum(F.col("score") * w).alias("score"))


def reconstruction(train: DataFrame, queries: DataFrame, components: int = 8) -> DataFrame:
    """ML-08: (id, grp, score): distance of each query to the principal subspace of its group's training vectors.

    A linear autoencoder in closed form. Groups are summed to means and second
    moments in parts, so a group of any size is one small matrix at its end.
    """
    dim_schema = "grp string, part int, n long, s array<double>, m array<double>"

    def moments(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vector"].to_numpy()).astype(float)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "part": [int(pdf["part"].iloc[0])], "n": [len(x)], "s": [x.sum(0)], "m": [(x.T @ x).ravel()]})

    def subspace(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s, m = pdf["n"].sum(), np.sum(list(pdf["s"]), axis=0), np.sum(list(pdf["m"]), axis=0)
        mean = s / n
        cov = m.reshape(len(s), len(s)) / n - np.outer(mean, mean)
        _, vec = np.linalg.eigh(cov)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "mean": [mean], "axes": [vec[:, ::-1][:, :components].T.ravel()]})

    parts = train.select(F.col("grp").cast("string").alias("grp"), "vector", F.pmod(F.xxhash64("tid"), F.lit(256)).cast("int").alias("part"))
    model = parts.groupBy("grp", "part").applyInPandas(moments, dim_schema).groupBy("grp").applyInPandas(subspace, "grp string, mean array<double>, axes array<double>")

    @F.pandas_udf("double")
    def error(grp: pd.Series, vector: pd.Series, mean: pd.Series, axes: pd.Series) -> pd.Series:
        out = np.zeros(len(vector))
        for _, at in grp.groupby(grp).indices.items():  # rows of a group share its subspace
            d = np.stack(vector.iloc[at].to_numpy()).astype(float) - np.asarray(mean.iloc[at[0]])
            a = np.asarray(axes.iloc[at[0]]).reshape(-1, d.shape[1])
            out[at] = np.linalg.norm(d - (d @ a.T) @ a, axis=1)
        return pd.Series(out)

    q = queries.withColumn("g", F.col("grp").cast("string"))
    return q.join(model.withColumnRenamed("grp", "g"), "g").select("id", q["grp"], error("g", "vector", "mean", "axes").alias("score"))


def features(model_output: DataFrame) -> DataFrame:
    """ML-07: the two heads of a model, features and probabilities, as columns of one pass."""
    return model_output.select("id", "vector", "probs")
