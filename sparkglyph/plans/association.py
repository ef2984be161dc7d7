"""The association plan as one lazy DAG: GUI models and layout tags to images, widgets, handlers, methods and permissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import association as A
from ..operators import graph as R
from ..sources import readers


def image_widgets(spark: SparkSession, models: str, tags: str, groups: str | None = None) -> DataFrame:
    """(app, image, id, id_name, layout, handlers) of the apps below the given paths."""
    model = readers.gui_model(spark, models)
    pairs = A.image_widgets(A.tag_widgets(readers.layout_tags(spark, tags)), A.view_widgets(model))
    if groups:
        pairs = A.propagate(pairs, readers.image_groups(spark, groups))
    return A.associate(pairs, A.widget_handlers(model))


def permissions(pairs: DataFrame, edges: DataFrame, methods: DataFrame, lookup: DataFrame, mapping: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """The associated rows with reachable methods and their permissions, as (apk, image, wid, wid_name, layout, handler, method, permissions).

    edges: (app, src, dst), methods: (app, method), targets: (app, method, ord,
    class); each app's graph is closed by itself. Tables without an `app` column
    are those of a single app. lookup and mapping hold for methods of any app.
    """
    from pyspark.sql import functions as F

    k = ["app"] if "app" in edges.columns else []
    handlers = pairs.select("app", F.explode("handlers").alias("handler")).distinct()
    graph = R.augment(edges, methods, targets)
    entries = None if targets is None else targets.select(*k, F.col("method").alias("handler")).distinct()
    found = R.handler_reach(graph, handlers.select(*k, "handler").distinct(), entries)
    reach = handlers.join(found, [*k, "handler"]).where(~F.col("method").startswith("hub:"))
    rows = A.handler_permissions(pairs, reach, lookup)
    out = rows.groupBy("app", "image", "id", "id_name", "layout", "handler", "method").agg(F.array_sort(F.collect_set("permission")).alias("permissions"))
    if mapping is not None:
        out = A.override(out, mapping)
    return out.select(F.col("app").alias("apk"), "image", F.col("id").alias("wid"), F.col("id_name").alias("wid_name"), "layout", "handler", "method", "permissions")
