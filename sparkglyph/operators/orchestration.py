"""What drivers of external tools need of an engine: status rows, dispatch and retries as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ORC-02: exit codes of an external tool and their names.
STATUS = {0: "DONE", -1: "TIMEOUT", -2: "ERROR", -3: "KILLED"}


def status_name(code: Column) -> Column:
    """ORC-02: the name of an exit code; others are errors."""
    out = F.lit("ERROR")
    for k, v in STATUS.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def project_kind(files: DataFrame) -> DataFrame:
    """ORC-04, FLT-17: (project, kind) from (project, file): apk, studio (a Gradle script), eclipse (a .project), else unknown."""
    rank = F.when(F.lower("file").endswith(".apk"), 0).when(F.col("file").rlike(r"(^|/)build\.gradle(\.kts)?$"), 1).when(F.col("file").rlike(r"(^|/)\.project$"), 2).otherwise(3)
    names = F.array(*map(F.lit, ("apk", "studio", "eclipse", "unknown")))
    return files.groupBy("project").agg(F.min(rank).alias("r")).select("project", F.element_at(names, F.col("r") + 1).alias("kind"))


def spread(rows: DataFrame, app: str = "app", parts: int | None = None) -> DataFrame:
    """ORC-01, ORC-05: rows dealt over tasks by app; the scheduler does the rest."""
    return rows.repartition(parts, app) if parts else rows.repartition(app)


def retry(rows: DataFrame, settings: list[dict], attempt: Callable[[DataFrame, dict], DataFrame], key: str) -> DataFrame:
    """ORC-07: tries settings in turn on what is not yet done. ``attempt`` returns the key and result of rows that worked."""
    left, out = rows, None
    for s in settings:
        done = attempt(left, s)
        out = done if out is None else out.unionByName(done)
        left = left.join(done.select(key), key, "left_anti")
    return out


def elapsed_seconds(start: Column, end: Column) -> Column:
    """SF-37."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def timed_out(seconds: Column, limit: int) -> Column:
    """STR-04: flags runs over their limit, so that partial results are seen as such."""
    return seconds > limit
