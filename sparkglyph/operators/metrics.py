"""Evaluation of multi-label predictions and rankings. Long form: one row per (item, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import running


def hits(truth: Column, predicted: Column) -> Column:
    """SET-07: labels that are both."""
    return F.size(F.array_intersect(truth, predicted))


def example_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """AGG-14, AGG-15: mean precision and recall of examples (0 where a denominator is 0), F1 of these means, share of exact matches."""
    tp = hits(F.col(truth), F.col(predicted))
    ratio = lambda n: F.when(n > 0, tp / n).otherwise(0.0)
    same = F.array_sort(F.array_distinct(truth)) == F.array_sort(F.array_distinct(predicted))
    m = rows.agg(F.avg(ratio(F.size(F.array_distinct(predicted)))).alias("precision"), F.avg(ratio(F.size(F.array_distinct(truth)))).alias("recall"), F.avg(same.cast("double")).alias("accuracy"))
    return m.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def label_scores(rows: DataFrame, label: str = "label", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """AGG-16, AGG-17: precision, recall, F1, support and accuracy of each label from 0/1 columns; 0 where a denominator is 0."""
    a, b = F.col(y) == 1, F.col(yhat) == 1
    m = rows.groupBy(label).agg(
        F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"), F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy")
    )
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    m = m.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return m.select(label, "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"), "accuracy")


def top_k_masks(scores: DataFrame, item: str, label: str, score: str, n: int) -> DataFrame:
    """WIN-01, WIN-02: for k = 1..n, 1 for the k best labels of each item; ties go to the larger label."""
    rank = F.row_number().over(Window.partitionBy(item).orderBy(F.desc(score), F.desc(label)))
    return scores.withColumn("rank", rank).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(item, label, "k", (F.col("rank") <= F.col("k")).cast("int").alias("yhat"))


def prefix_ranks(rows: DataFrame, score: str, tie: str, y: str, keys: list[str]) -> DataFrame:
    """Rank by score descending and positives so far, without sorting a group in one task.

    Scores are cut into 64 ranges at approximate quantiles; counts and
    positives of the ranges before are added to those within.
    """
    rows = rows.withColumn("__range", _score_range(rows, score))
    by = rows.groupBy(*keys, "__range").agg(F.count("*").alias("__n"), F.sum(y).alias("__p"))
    order = Window.partitionBy(*keys).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    by = by.select(*keys, "__range", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__p").over(order), F.lit(0)).alias("__p0"), F.sum("__n").over(whole).alias("n"), F.sum("__p").over(whole).alias("p"))
    inside = Window.partitionBy(*keys, "__range").orderBy(F.desc(score), tie)
    rows = rows.withColumn("__k", F.row_number().over(inside)).withColumn("__h", F.sum(y).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(by, [*keys, "__range"])
    return rows.withColumns({"k": F.col("__k") + F.col("__n0"), "hits": F.col("__h") + F.col("__p0")}).drop("__range", "__k", "__h", "__n0", "__p0")


def _score_range(rows: DataFrame, score: str) -> Column:
    edges = rows.approxQuantile(score, [i / 64 for i in range(1, 64)], 0.005)  # 63 numbers
    out = F.lit(0)
    for e in sorted(set(edges)):
        out = out + (F.col(score) > e).cast("int")
    return out


def curve(rows: DataFrame, score: str, tie: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """WIN-03: precision and recall at k = 1..n-1; groups that are all or not at all positive are left out (FLT-22)."""
    r = prefix_ranks(rows, score, tie, y, keys or [])
    r = r.where((F.col("p") > 0) & (F.col("p") < F.col("n")) & (F.col("k") < F.col("n")))
    return r.select(*(keys or []), "k", (F.col("hits") / F.col("k")).alias("precision"), (F.col("hits") / F.col("p")).alias("recall"), "p")


def break_even(curve_rows: DataFrame) -> DataFrame:
    """WIN-04: the curve where k is the number of positives."""
    return curve_rows.where(F.col("k") == F.col("p"))


def auc(rows: DataFrame, score: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """AGG-21: Mann-Whitney with average ranks. Counts by distinct score stand in for ranks, so ties cost nothing."""
    keys = keys or []
    by = rows.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(y).alias("p"))
    by = running(by, keys, [score], {"before": F.col("n")})
    t = by.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return t.where("p > 0 AND q > 0").select(*keys, ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def runs_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG-18: mean and population variance over repeated runs."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def marks(rows: DataFrame, mark: str) -> DataFrame:
    """FLT-21: rows with a mark, as 0/1."""
    return rows.where(F.col(mark) != 0).withColumn("y", (F.col(mark) == 1).cast("int"))


def any_positive(array: Column) -> Column:
    """AGG-22."""
    return F.exists(array, lambda m: m == 1)


def evaluate(rows: DataFrame, item: str, label: str, score: str, mark: str) -> DataFrame:
    """ML-11: break-even precision, recall and AUC of each label, and of all (label null): an item is positive if any mark is."""
    m = marks(rows, mark)
    per = break_even(curve(m, score, item, "y", [label])).select(label, "precision", "recall").join(auc(m, score, "y", [label]), label)
    whole = rows.groupBy(item).agg(F.sum(score).alias("s"), F.max((F.col(mark) == 1).cast("int")).alias("y")).withColumn("one", F.lit(1))
    total = break_even(curve(whole, "s", item, "y", ["one"])).select("one", "precision", "recall").join(auc(whole, "s", "y", ["one"]), "one")
    return per.unionByName(total.select(F.lit(None).cast(rows.schema[label].dataType).alias(label), "precision", "recall", "auc"))


def prediction_dump(predictions: DataFrame, raw: DataFrame, key: str, token_names: Column) -> DataFrame:
    """JN-21, SNK-10: a flag, the names of the tokens (padding dropped) and the raw row of each prediction."""
    both = predictions.join(raw, key)
    kept = F.filter("tokens", lambda t: t != 0)
    return both.withColumn("names", F.transform(kept, lambda t: F.try_element_at(token_names, t))).withColumn("correct", F.col("predicted") == F.col("truth"))
