"""Intermediate data in the cluster's shared folder, and ranks without a global sort in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _base(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only in local mode, where all tasks see it."""
    ready = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (ready.get() if ready.isDefined() else None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkglyph-")
    if not ready.isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{_base(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder."""
    _base(df.sparkSession)
    return df.checkpoint()


def running(rows: DataFrame, keys: list[str], order: list[str], before: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Adds, for each name in ``before``, the sum of its column over the rows of the same ``keys`` that come earlier by ``order``.

    Rows are dealt into ranges of the order, summed per range, and only the
    ranges' sums, a row each, are added up in one place. ``order`` is unique within ``keys``.
    """
    by = [*keys, *order]
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    dealt = cut(dealt.withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in before.items()))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__range", *(F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in before))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in before.items()})
    out = out.join(sums, [*keys, "__range"])
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in before}).drop("__range", *(f"__{n}" for n in before))
