"""Grouped and ranked choices with stated tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_first(rows: DataFrame, keys: list[str], value: str, order: str, default: str) -> DataFrame:
    """AGG-09: the most frequent value of a group; on a tie the first seen by ``order``; ``default`` if all are null."""
    n = rows.groupBy(*keys, value).agg(F.count(value).alias("n"), F.min(order).alias("at"))
    best = F.min_by(value, F.when(F.col("n") > 0, F.struct(-F.col("n"), F.col("at"))))
    return n.groupBy(*keys).agg(F.coalesce(best, F.lit(default)).alias(value))


def argmax(rows: DataFrame, keys: list[str], pick: str, by: str, tie: str) -> DataFrame:
    """AGG-11: ``pick`` of the row with the greatest ``by``; the least ``tie`` decides."""
    return rows.groupBy(*keys).agg(F.min_by(pick, F.struct(-F.col(by), F.col(tie))).alias(pick), F.max(by).alias(by))


def argmin(rows: DataFrame, keys: list[str], pick: str, by: str, tie: str) -> DataFrame:
    """AGG-12."""
    return rows.groupBy(*keys).agg(F.min_by(pick, F.struct(F.col(by), F.col(tie))).alias(pick), F.min(by).alias(by))


def best_bucket(rows: DataFrame, keys: list[str], bucket: str, value: str) -> DataFrame:
    """AGG-13, SRT-03, SRT-08: the rows of each key's first bucket that holds a non-null value."""
    some = rows.where(F.col(value).isNotNull())
    first = some.groupBy(*keys).agg(F.min(bucket).alias(bucket))
    return some.join(first, [*keys, bucket], "left_semi")


def first_non_null(*columns: Column) -> Column:
    """SRT-08: break on the first hit."""
    return F.coalesce(*columns)


def collect_ordered(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """AGG-10, AGG-25: values as a list in a stated order."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(value))


def adjacency(edges: DataFrame) -> DataFrame:
    """AGG-05: caller to its distinct callees."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dst"))


def symbol_maps(symbols: DataFrame) -> DataFrame:
    """AGG-27: name-to-id map of each subclass; the last by id wins on a repeated name."""
    one = symbols.groupBy("subclass", "name").agg(F.max("id").alias("id"))
    return one.groupBy("subclass").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "id")))).alias("ids"))


def class_statistics(classes: DataFrame) -> DataFrame:
    """AGG-24: counts by kind."""
    return classes.groupBy("kind").agg(F.count("*").alias("n"))


def removal_statistics(rows: DataFrame, before: str, after: str) -> DataFrame:
    """AGG-08: rows and tokens before and after a filter on array columns."""
    return rows.agg(
        F.count("*").alias("rows_in"), F.count_if(F.size(after) == 0).alias("rows_emptied"),
        F.sum(F.size(before)).alias("tokens_in"), F.sum(F.size(after)).alias("tokens_out"),
    )


def reverse_lookup(ids: Column, names: Column) -> Column:
    """JN-20: ids to names by a map (id -> name); unknown ids are dropped."""
    return F.filter(F.transform(ids, lambda i: F.try_element_at(names, i)), lambda n: n.isNotNull())


def resource_ids(names: DataFrame, known: DataFrame) -> DataFrame:
    """JN-22, WIN-07: ids of (type, name): the known one, else the next numbers after the type's count, by name."""
    at = known.groupBy("type").agg(F.count("*").alias("n"))
    new = names.select("type", "name").distinct().join(known, ["type", "name"], "left_anti").join(at, "type", "left")
    rank = F.row_number().over(Window.partitionBy("type").orderBy("name"))
    return known.select("type", "name", "id").unionByName(new.select("type", "name", (F.coalesce("n", F.lit(0)) + rank).cast("long").alias("id")))


def label_frames(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """WIN-09: `first` and `later` frames, and `target` where the state says so."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("label", F.when(rank == 1, "first").otherwise("later"))


def seeded_choice(rows: DataFrame, keys: list[str], item: str, seed: int = 0) -> DataFrame:
    """WIN-10: one item of each group, reproducibly at random."""
    return rows.groupBy(*keys).agg(F.min_by(item, F.struct(F.xxhash64(item, F.lit(seed)), F.col(item))).alias(item))


def location_priority(kind: Column, order: Column) -> Column:
    """SRT-03: integer rank of a drawable's place: direct, target state, first frame, other states, later frames, random."""
    ranks = ["direct", "target", "first", "state", "later", "random"]
    base = F.lit(len(ranks))
    for i, name in reversed(list(enumerate(ranks))):
        base = F.when(kind == name, i).otherwise(base)
    return base * 1_000_000 + F.coalesce(order, F.lit(0))


def index_range(rows: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """SRT-05: rows first..last (from 1) by ``order``; only the rows up to ``last`` are sorted into one place."""
    return rows.orderBy(order).limit(last).withColumn("__n", F.row_number().over(Window.orderBy(order))).where(F.col("__n") >= first).drop("__n")


def ranked(rows: DataFrame, score: str, tie: str, k: int | None = None) -> DataFrame:
    """SRT-06: by score descending, ties by key; top k if given."""
    out = rows.orderBy(F.desc(score), tie)
    return out if k is None else out.limit(k)


def method_intents(messages: DataFrame) -> DataFrame:
    """AGG-23: (method, actions, uris, classes) of the exit points of component messages (file, ord, path, node, value).

    Fields of an exit point stand in its node or below it; classes keep their order.
    """
    m = messages.withColumn("point", F.regexp_extract("node", r"^(0/\d+/\d+)", 1)).where(F.col("path").contains("exit_points") & (F.col("point") != ""))
    field = F.substring_index("path", ".", -1)
    method = m.where(field == "statement").select("file", "point", F.regexp_extract("value", "(<.*>)", 1).alias("method")).unionByName(
        m.where(field == "method").select("file", "point", F.col("value").alias("method"))
    )
    rows = m.select("file", "point", "ord", field.alias("field"), "value").join(method.distinct(), ["file", "point"])
    classes = F.array_sort(F.collect_list(F.when(F.col("field") == "class", F.struct("ord", "value"))))
    return rows.groupBy("method").agg(
        F.array_sort(F.collect_set(F.when(F.col("field") == "action", F.col("value")))).alias("actions"),
        F.array_sort(F.collect_set(F.when(F.col("field") == "uri", F.col("value")))).alias("uris"),
        F.transform(classes, lambda x: x["value"]).alias("classes"),
    )


def flatten_map(nested: DataFrame, key: str, column: str) -> DataFrame:
    """AGG-02: a row for each entry of a map column."""
    return nested.select(key, F.explode(column).alias("entry", "value"))
