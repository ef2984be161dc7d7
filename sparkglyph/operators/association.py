"""Image - widget - handler - method - permission association."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from .scratch import cut

#: Permission groups: fixed values.
GROUPS = {
    "NETWORK": ["INTERNET", "CHANGE_WIFI_STATE"],
    "LOCATION": ["ACCESS_COARSE_LOCATION", "ACCESS_FINE_LOCATION", "ACCESS_MOCK_LOCATION"],
    "MICROPHONE": ["RECORD_AUDIO"],
    "SMS": ["SEND_SMS", "READ_SMS", "WRITE_SMS", "RECEIVE_SMS"],
    "CAMERA": ["CAMERA"],
    "CALL": ["CALL_PHONE"],
    "STORAGE": ["WRITE_EXTERNAL_STORAGE", "READ_EXTERNAL_STORAGE"],
    "CONTACTS": ["READ_CONTACTS", "WRITE_CONTACTS", "GET_ACCOUNTS", "MANAGE_ACCOUNTS", "AUTHENTICATE_ACCOUNTS"],
}

WIDGET = ["id", "id_name", "layout"]


def tag_widgets(tags: DataFrame) -> DataFrame:
    """FLT-02, FLT-03, SF-14: (app, image, id, id_name, layout) of layout tags with an id and an image that is no background."""
    rows = tags.where(F.col("id_name").isNotNull() & (F.col("attribute") != "background"))
    return rows.select("app", P.strip_prefix(F.col("value"), "drawable/").alias("image"), "id", P.strip_prefix(F.col("id_name"), "id/").alias("id_name"), "layout")


def _views(model: DataFrame) -> DataFrame:
    named = model.withColumn("w", P.widget_id(F.col("view"))).where(F.col("w").isNotNull())
    return named.select("app", "w.id", "w.id_name", P.layout_name(F.col("window")).alias("layout"), "images", "handlers")


def view_widgets(model: DataFrame) -> DataFrame:
    """FLT-04, FLT-05: (app, image, widget) of the GUI model's views."""
    rows = _views(model).select("app", F.explode("images").alias("i"), *WIDGET)
    return rows.select("app", P.drawable_name(F.col("i")).alias("image"), *WIDGET).where(F.col("image").isNotNull())


def widget_handlers(model: DataFrame) -> DataFrame:
    """AGG-04: (app, widget, handlers), all events merged, sorted and distinct."""
    rows = _views(model).select("app", *WIDGET, F.explode("handlers").alias("h")).select("app", *WIDGET, F.explode("h.handlers").alias("h"))
    return rows.groupBy("app", *WIDGET).agg(F.array_sort(F.collect_set("h")).alias("handlers"))


def image_widgets(*producers: DataFrame) -> DataFrame:
    """SET-01, AGG-03: the distinct union of (app, image, widget)."""
    out = producers[0]
    for p in producers[1:]:
        out = out.unionByName(p)
    return out.distinct()


def propagate(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """JN-03: members of a group take over the widgets of its head, in place of their own.

    groups: app, ord, head, images. Groups apply in order, so a member's last
    group decides, and a head that an earlier group overwrote hands on what it
    got. Heads are followed to the image whose own widgets count, however long
    the chain (each step leads to an earlier group); an image that is only a head
    keeps its widgets.
    """
    steps = groups.select("app", "ord", "head", F.explode("images").alias("member"))
    # origin of each member: walk from its last group to the head's last earlier group, and so on
    last = steps.groupBy("app", "member").agg(F.max_by("head", "ord").alias("head"), F.max("ord").alias("ord"))
    walk = last.select("app", "member", F.col("head").alias("origin"), "ord", F.lit(True).alias("open"))
    earlier = cut(steps.select("app", F.col("member").alias("origin"), F.col("head").alias("next"), F.col("ord").alias("next_ord")))
    while True:
        step = walk.where("open").join(earlier, ["app", "origin"], "left").groupBy("app", "member", "origin", "ord").agg(
            F.max(F.when(F.col("next_ord") < F.col("ord"), F.struct("next_ord", "next"))).alias("n")
        )
        step = step.select("app", "member", F.coalesce("n.next", "origin").alias("origin"), F.coalesce("n.next_ord", "ord").alias("ord"), F.col("n").isNotNull().alias("open"))
        walk = cut(walk.where("NOT open").unionByName(step))
        if walk.where("open").isEmpty():
            break
    heads = pairs.withColumnRenamed("image", "origin")
    # a head without widgets of its own hands on none, and its members keep theirs
    taken = walk.join(heads, ["app", "origin"]).select("app", F.col("member").alias("image"), *WIDGET)
    kept = pairs.join(taken.select("app", "image").distinct(), ["app", "image"], "left_anti")
    return kept.unionByName(taken).distinct()


def associate(pairs: DataFrame, handlers: DataFrame) -> DataFrame:
    """JN-01: every image-widget pair with its handlers, an empty array where there are none."""
    out = pairs.join(handlers, ["app", *WIDGET], "left")
    return out.select("app", "image", *WIDGET, F.coalesce("handlers", F.array().cast("array<string>")).alias("handlers"))


def render_handlers(handlers: Column) -> Column:
    """SNK-03: `[h1|h2|]`."""
    return F.concat(F.lit("["), F.array_join(F.transform(handlers, lambda h: F.concat(h, F.lit("|"))), ""), F.lit("]"))


def has_handler(cell: Column) -> Column:
    """FLT-13: something stands between the brackets."""
    return cell.rlike(r"\[[^\]]")


def files_with_handlers(rows: DataFrame, file: str, cell: str) -> DataFrame:
    """AGG-26: the number of files with a handler."""
    return rows.agg(F.count_distinct(F.when(has_handler(F.col(cell)), F.col(file))).alias("files"))


def handler_permissions(pairs: DataFrame, reach: DataFrame, permissions: DataFrame) -> DataFrame:
    """JN-02, JN-04, JN-05, GR-03: associated rows with the methods that each handler reaches and their permissions.

    Equi-joins on what a handler really reaches; pairing each handler with every
    method of its app is deliberately left out. reach: (app, handler, method),
    permissions: (method, permission), what the platform's methods need in any app.
    """
    rows = pairs.withColumn("handler", F.explode("handlers")).drop("handlers")
    reached = reach.join(permissions, "method")
    return rows.join(reached, ["app", "handler"])


def first_permission(permissions: DataFrame) -> DataFrame:
    """WIN-08: one permission per method, the first by name: a defined stand-in for first-row order."""
    return permissions.groupBy("method").agg(F.min("permission").alias("permission"))


def override(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """JN-06: permissions replaced where the mapping (method, permissions) knows the method."""
    m = mapping.select("method", F.col("permissions").alias("mapped"))
    return rows.join(m, "method", "left").withColumn("permissions", F.coalesce("mapped", "permissions")).drop("mapped").select(rows.columns)


def merge_permissions(rows: DataFrame) -> DataFrame:
    """AGG-01, SET-04, FLT-01: (app, image, layout) with the sorted union of permissions. Sets are merged item by item, so no list outgrows its distinct items."""
    item = rows.select("apk", "image", "layout", F.explode_outer("permissions").alias("p"))
    return item.groupBy("apk", "image", "layout").agg(F.array_sort(F.collect_set("p")).alias("permissions"))


def group_table(spark) -> DataFrame:
    """The permission-group dimension: (permission, grp)."""
    return spark.createDataFrame([(p, g) for g, ps in GROUPS.items() for p in ps], "permission STRING, grp STRING")


def groups_of(permissions: Column) -> Column:
    """JN-07: sorted distinct groups of an array of permission names, by their short names."""
    lookup = F.create_map(*[F.lit(x) for g, ps in GROUPS.items() for p in ps for x in (p, g)])
    got = F.transform(permissions, lambda p: F.try_element_at(lookup, P.short_name(p)))
    return F.array_sort(F.array_distinct(F.filter(got, lambda g: g.isNotNull())))


def sensitive(rows: DataFrame, column: str = "permissions") -> DataFrame:
    """FLT-06: permissions replaced by their groups; rows without one are dropped."""
    return rows.withColumn(column, groups_of(F.col(column))).where(F.size(column) > 0)


def library_filter(rows: DataFrame, column: str, patterns: DataFrame) -> DataFrame:
    """FLT-14: rows whose class matches no pattern (exact, or a prefix where it ends in .* or $*).

    Prefixes become equi-joins on the class cut to each dotted length, not a
    comparison of all classes with all patterns.
    """
    p = patterns.select(F.regexp_replace("pattern", r"([.$])\*$", "$1").alias("p"), F.col("pattern").rlike(r"[.$]\*$").alias("prefix"))
    cuts = F.expr("transform(filter(sequence(1, length(class)), i -> substring(class, i, 1) IN ('.', '$')), i -> substring(class, 1, i))")
    classes = rows.select(F.col(column).alias("class")).distinct()
    keyed = classes.select("class", F.explode(F.concat(F.array(F.struct(F.col("class").alias("p"), F.lit(False).alias("prefix"))), F.transform(cuts, lambda x: F.struct(x.alias("p"), F.lit(True).alias("prefix"))))).alias("m"))
    hit = keyed.select("class", "m.p", "m.prefix").join(p, ["p", "prefix"], "left_semi").select(F.col("class").alias("__class")).distinct()
    return rows.join(hit, F.col(column) == F.col("__class"), "left_anti")


def unhandled(apps: DataFrame, done: DataFrame, redo: tuple[str, ...] = ()) -> DataFrame:
    """JN-17, SET-08: apps not yet in the status table (app, status), or with a status to redo."""
    return apps.join(done.where(~F.col("status").isin(*redo)) if redo else done, "app", "left_anti")


def combine(*parts: DataFrame) -> DataFrame:
    """SET-02, SNK-05: UNION ALL by name; columns that only some have become null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
