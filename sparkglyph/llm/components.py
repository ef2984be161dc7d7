"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common as C


def connected(links: DataFrame) -> DataFrame:
    """links (a, b), long: returns (id, component), component being the smallest id reachable; ids without links are absent.

    Repeated links, links of an id with itself and links with a null end change
    nothing; no links give an empty result; other columns are ignored. Steps
    go on until a step changes nothing. Each step is a shuffled minimum per node,
    joined back; nothing but a count and a checksum reaches the driver. Hubs are
    plain keys of joins that Spark splits when they are skewed.
    """
    e, last = _written(links.where("a != b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood
        both = e.select("u", "v").union(e.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u AS n", "least(u, m) AS m")
        big = both.join(least, F.col("u") == F.col("n")).where("v > u").selectExpr("v AS u", "m AS v")
        big = big.where("u != v").distinct()
        # small star: a node and its neighbours below go to the least of them
        least = big.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = big.join(least, F.col("u") == F.col("n")).selectExpr("v AS u", "m AS v").union(least.selectExpr("n AS u", "m AS v"))
        new, now = _written(small.where("u != v").distinct())
        C.discard(e)
        e = new
        if now == last:
            return e.selectExpr("u AS id", "v AS component").union(e.selectExpr("v AS id", "v AS component").distinct())
        last = now


def _written(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, written, and their count and checksum, taken as they pass."""
    seen = Observation()
    e = C.materialize(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "cc")
    return e, (seen.get["n"], seen.get["sum"])
