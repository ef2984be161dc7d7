"""Contextual texts from layout XML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.xml import element_table

def _attr(name: str) -> F.Column:
    """An attribute by its local name."""
    return F.get(F.map_values(F.map_filter("attrs", lambda k, v: k.rlike(f"(^|:){name}$"))), F.lit(0))


def layout_nodes(layouts: DataFrame) -> DataFrame:
    """layouts: (app, layout, xml) to element rows."""
    return element_table(layouts, ["app", "layout"])


def image_nodes(nodes: DataFrame, images: DataFrame) -> DataFrame:
    """SF-34, GR-10: (app, layout, image, node, parent): elements with an attribute `@drawable/<image>`; the last such element of a layout counts."""
    values = nodes.select("app", "layout", "node", "parent", F.explode(F.map_values("attrs")).alias("v"))
    hit = values.where(F.col("v").startswith("@drawable/")).withColumn("image", F.expr("substring(v, 11)"))
    hit = hit.join(images, ["app", "layout", "image"], "left_semi")
    return hit.groupBy("app", "layout", "image").agg(F.max("node").alias("node"), F.max_by("parent", "node").alias("parent"))


def layout_texts(layouts: DataFrame, strings: DataFrame, images: DataFrame, scope: str = "parent") -> DataFrame:
    """FLT-09, JN-14: (app, layout, image, texts): texts of the elements at and below the image's parent (the root if there is none), or of the whole layout.

    Invisible elements are passed over, their children are not. `@string/x` is
    looked up in (app, name, value); what is unknown or null is left out, a
    literal text stays. Texts come in document order.
    """
    nodes = layout_nodes(layouts)
    seen = nodes.where(F.coalesce(_attr("visibility"), F.lit("")) != "invisible").select("app", "layout", "node", "path", _attr("text").alias("text")).where(F.col("text").isNotNull())
    wanted = images.select("app", "layout", "image").distinct()
    if scope == "parent":
        found = image_nodes(nodes, wanted)
        at = nodes.select("app", "layout", F.col("node").alias("top"), F.col("path").alias("top_path"))
        wanted = wanted.join(found, ["app", "layout", "image"], "left").withColumn("top", F.greatest(F.coalesce("parent", F.lit(0)), F.lit(0))).join(at, ["app", "layout", "top"])
    else:
        wanted = wanted.withColumn("top_path", F.lit("0"))
    inside = (F.col("path") == F.col("top_path")) | F.col("path").startswith(F.concat("top_path", F.lit("/")))
    rows = wanted.select("app", "layout", "image", "top_path").join(seen, ["app", "layout"], "left").where(F.col("node").isNull() | inside)
    rows = rows.withColumn("name", F.when(F.col("text").startswith("@string/"), F.expr("substring(text, 9)")))
    rows = rows.join(strings, ["app", "name"], "left").withColumn("t", F.when(F.col("name").isNull(), F.col("text")).otherwise(F.col("value")))
    got = F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("node", "t"))))
    out = rows.groupBy("app", "layout", "image").agg(F.transform(got, lambda x: x["t"]).alias("texts"))
    return images.select("app", "layout", "image").distinct().join(out, ["app", "layout", "image"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def contextual_texts(layout: DataFrame, embedded: DataFrame, resource: DataFrame) -> DataFrame:
    """ML-13, JN-16: the three kinds of texts, joined by key, never by position."""
    key = ["app", "layout", "image"]
    empty = F.array().cast("array<string>")
    out = layout.withColumnRenamed("texts", "layout_texts").join(embedded.withColumnRenamed("texts", "embedded_texts"), key, "left").join(resource.withColumnRenamed("texts", "resource_texts"), key, "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("embedded_texts", "resource_texts")})


def app_language(rows: DataFrame, languages: DataFrame) -> DataFrame:
    """JN-15: the app's language on each of its rows."""
    return rows.join(languages, "app", "left")


def view_kinds(views: DataFrame) -> DataFrame:
    """FLT-16: `annotation` for text views with an area, `edit` for inputs with an inner area, null for others."""
    wide = (F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top"))
    inner = (F.col("right") - F.col("pad_right") > F.col("left") + F.col("pad_left")) & (F.col("bottom") - F.col("pad_bottom") > F.col("top") + F.col("pad_top"))
    last = F.substring_index("class", ".", -1)
    kind = F.when((last == "TextView") & wide, "annotation").when(last.isin("EditText", "RadioButton", "CheckBox") & inner, "edit")
    return views.withColumn("kind", kind)


def sensitive_fields(views: DataFrame, keywords: list[str]) -> DataFrame:
    """FLT-18: inputs whose text has one of the keywords."""
    text = F.lower(F.coalesce("text", F.lit("")))
    return views.where((F.col("kind") == "edit") & F.exists(F.array(*map(F.lit, keywords)), lambda k: text.contains(k)))


def layout_names(views: DataFrame) -> DataFrame:
    """SRT-07: ordered distinct layout names of each app."""
    return views.groupBy("app").agg(F.array_sort(F.collect_set("layout")).alias("layouts"))
