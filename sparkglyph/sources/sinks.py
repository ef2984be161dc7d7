"""Sinks. Each writes as many files as there are partitions; a single file is made only where a format is for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.association import render_handlers

ASSOCIATION = ["APK", "Image", "WID", "WID Name", "Layout", "Handler", "Method", "Permissions"]


def rows(df: DataFrame, path: str, mode: str = "error") -> None:
    """SNK-01: rows as Parquet."""
    df.write.mode(mode).parquet(path)


def json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """SNK-02, SNK-10: a JSON value a line."""
    df.write.mode(mode).json(path)


def image_widgets(df: DataFrame, path: str, mode: str = "error") -> None:
    """SNK-03: tab-separated image-widget rows, handlers as `[h1|h2|]`."""
    out = df.select(F.col("app").alias("APK"), F.col("image").alias("Image"), F.col("id").alias("WID"), F.col("id_name").alias("WID Name"), F.col("layout").alias("Layout"), render_handlers(F.col("handlers")).alias("Handler"))
    out.write.mode(mode).csv(path, sep="\t", header=True)


def app_permissions(df: DataFrame, path: str, mode: str = "error") -> None:
    """SNK-04: tab-separated rows with lines, a folder for each app."""
    df.write.mode(mode).partitionBy("apk").csv(path, sep="\t", header=True)


def combined(df: DataFrame, path: str, mode: str = "error") -> None:
    """SNK-05, SNK-06: eight columns by name; permissions as `[p1, p2]`."""
    cell = F.concat(F.lit("["), F.array_join("permissions", ", "), F.lit("]"))
    names = ["apk", "image", "wid", "wid_name", "layout", "handler", "method"]
    out = df.select(*(F.col(c).cast("string").alias(n) for c, n in zip(names, ASSOCIATION)), cell.alias(ASSOCIATION[-1]))
    out.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def dot(vertices: DataFrame, edges: DataFrame, path: str, mode: str = "error") -> None:
    """SNK-07: lines of a DOT graph, vertices before edges."""
    v = vertices.select(F.lit(1).alias("part"), F.format_string('  %d [ label="%s" ];', "id", "signature").alias("value"))
    e = edges.select(F.lit(2), F.format_string("  %d -> %d;", "src", "dst"))
    spark = vertices.sparkSession
    ends = spark.createDataFrame([(0, "digraph G {"), (3, "}")], "part int, value string")
    v.union(e).union(ends).orderBy("part", "value").select("value").write.mode(mode).text(path)


def model(pipeline_model, vocab: DataFrame, labels: list[str], path: str) -> None:
    """SNK-08: a fitted pipeline with its vocabulary and labels."""
    pipeline_model.write().overwrite().save(f"{path}/model")
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    spark = vocab.sparkSession
    spark.createDataFrame(list(enumerate(labels)), "id int, name string").write.mode("overwrite").parquet(f"{path}/labels")


def metric_report(metrics: DataFrame, path: str, mode: str = "error") -> None:
    """SNK-09: (level, label, metric, k, value) rows, and as fixed-width text beside them."""
    metrics.write.mode(mode).parquet(f"{path}/rows")
    line = F.concat(F.rpad(F.coalesce("label", F.lit("all")), 24, " "), F.rpad("metric", 16, " "), F.lpad(F.coalesce(F.col("k").cast("string"), F.lit("-")), 4, " "), F.lpad(F.format_number("value", 4), 12, " "))
    metrics.orderBy("level", "label", "metric", "k").select(line.alias("value")).write.mode(mode).text(f"{path}/text")


def curve(points: DataFrame, path: str, mode: str = "error") -> None:
    """SNK-11: the points of a curve; plotting is left to other tools."""
    points.write.mode(mode).parquet(path)


def status(df: DataFrame, path: str) -> None:
    """SNK-12: appends (app, status); appended files never overlap, so no lock is needed."""
    df.select("app", "status").write.mode("append").parquet(path)


def progress(df: DataFrame, name: str):
    """SNK-13: counts rows as they pass; read the result's ``get`` after an action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen


def symbol_source(symbols: DataFrame, package: str, path: str, mode: str = "error") -> None:
    """SNK-14: a source file of constants, a class for each subclass, one folder."""
    body = F.array_join(F.array_sort(F.collect_list(F.format_string("    public static final int %s = 0x%08x;", "name", "id"))), "\n")
    classes = symbols.groupBy("subclass").agg(body.alias("body")).select(F.lit(1).alias("part"), F.format_string("  public static final class %s {\n%s\n  }", "subclass", "body").alias("value"))
    ends = symbols.sparkSession.createDataFrame([(0, f"package {package};\npublic final class R {{"), (2, "}")], "part int, value string")
    classes.union(ends).orderBy("part", "value").select("value").write.mode(mode).text(path)


def view_dump(views: DataFrame, path: str, mode: str = "error") -> None:
    """SNK-15: views and sensitive fields as text; rendering is external."""
    line = F.format_string("%s [%d,%d,%d,%d] %s", "class", "left", "top", "right", "bottom", F.coalesce("text", F.lit("")))
    views.select(line.alias("value")).write.mode(mode).text(path)
