"""Graph operators on edge tables (src, dst), or (app, src, dst) of several apps. Closures are semi-naive loops: the frontier joins the edges and what was seen is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut as _cut


def _scope(edges: DataFrame) -> list[str]:
    """Graphs of several apps in one table never meet: with an `app` column, every step stays within it."""
    return ["app"] if "app" in edges.columns else []


def reach(edges: DataFrame, starts: DataFrame, most: int | None = None, include_start: bool = False) -> DataFrame:
    """GR-02, SET-06: (start, node, depth) of all nodes within ``most`` steps of each start, with the least depth.

    Cycles and self-loops end by themselves. A start is not its own result
    unless ``include_start``, even where a cycle leads back to it.
    """
    k = _scope(edges)
    edges = edges.select(*k, F.col("src").alias("node"), F.col("dst").alias("next")).where("node IS NOT NULL AND next IS NOT NULL").distinct()
    seen = _cut(starts.select(*k, F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    frontier, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        new = frontier.join(edges, [*k, "node"]).select(*k, "start", F.col("next").alias("node")).distinct().join(seen, [*k, "start", "node"], "left_anti")
        frontier = _cut(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = _cut(seen.unionByName(frontier)) if depth % 8 == 0 else seen.unionByName(frontier)
    return seen if include_start else seen.where("start != node")


def handler_reach(edges: DataFrame, handlers: DataFrame, component_entries: DataFrame | None = None) -> DataFrame:
    """GR-02 with the root rule: nodes that call `startActivity(` expand only for handlers that have an inter-component entry.

    edges: (app, src, dst) by signature; handlers: (app, handler); component_entries: (app, handler).
    """
    k = _scope(edges)
    closed = edges.where(~F.col("src").contains("startActivity("))
    plain = handlers if component_entries is None else handlers.join(component_entries, [*k, "handler"], "left_anti")
    out = reach(closed, plain.select(*k, F.col("handler").alias("start")))
    if component_entries is not None:
        out = out.unionByName(reach(edges, handlers.join(component_entries, [*k, "handler"], "left_semi").select(*k, F.col("handler").alias("start"))))
    return out.select(*k, F.col("start").alias("handler"), F.col("node").alias("method"))


def closure(edges: DataFrame) -> DataFrame:
    """GR-05: (sub, super, depth) over edges (src subtype, dst supertype), every node with itself at depth 0."""
    nodes = edges.select(F.col("src").alias("start")).union(edges.select("dst")).distinct()
    return reach(edges, nodes, include_start=True).select(F.col("start").alias("sub"), F.col("node").alias("super"), "depth")


def subtypes(closed: DataFrame, roots: DataFrame, concrete: DataFrame | None = None) -> DataFrame:
    """GR-06: (sub) below any root (super), concrete ones only where a table (sub) is given."""
    out = closed.join(roots, "super", "left_semi").select("sub").distinct()
    return out if concrete is None else out.join(concrete, "sub", "left_semi")


def dispatch(closed: DataFrame, declares: DataFrame) -> DataFrame:
    """GR-07: the nearest declaring ancestor of each (sub, subsig); ties by name. declares: (class, subsig)."""
    hit = closed.join(declares.withColumnRenamed("class", "super"), "super")
    return hit.groupBy("sub", "subsig").agg(F.min_by("super", F.struct("depth", "super")).alias("target"), F.min("depth").alias("depth"))


def common_ancestor(closed: DataFrame, pairs: DataFrame) -> DataFrame:
    """GR-11: nearest common ancestor of pairs (a, b); ties by name."""
    a = closed.select(F.col("sub").alias("a"), "super", F.col("depth").alias("da"))
    b = closed.select(F.col("sub").alias("b"), "super", F.col("depth").alias("db"))
    both = pairs.join(a, "a").join(b, ["b", "super"])
    return both.groupBy("a", "b").agg(F.min_by("super", F.struct(F.col("da") + F.col("db"), F.col("super"))).alias("ancestor"))


def add_subtypes(closed: DataFrame, extra: DataFrame) -> DataFrame:
    """GR-14: (sub, super) pairs patched into a closure."""
    return closed.unionByName(extra.withColumn("depth", F.lit(1))).groupBy("sub", "super").agg(F.min("depth").alias("depth"))


def callbacks(closed: DataFrame, framework: DataFrame, app: DataFrame, instantiated: DataFrame) -> DataFrame:
    """GR-12: (class, subsig) of app methods that override a framework method of a supertype, for classes that app code does not create.

    framework and app: (class, subsig); instantiated: (class).
    """
    over = app.join(closed.where("depth > 0").select(F.col("sub").alias("class"), "super"), "class").join(framework.withColumnRenamed("class", "super"), ["super", "subsig"], "left_semi")
    return over.select("class", "subsig").distinct().join(instantiated, "class", "left_anti")


#: Type kinds by the framework class at their root: fixed values.
KINDS = {"view": "android.view.View", "menu": "android.view.Menu", "dialog": "android.app.Dialog", "activity": "android.app.Activity"}


def type_kinds(closed: DataFrame) -> DataFrame:
    """GR-06: (sub, kind): what each class is by the framework class above it; a class may be of several kinds."""
    spark = closed.sparkSession
    roots = spark.createDataFrame([(root, kind) for kind, root in KINDS.items()], "super string, kind string")
    return closed.join(F.broadcast(roots), "super").select("sub", "kind").distinct()  # one row per kind


def caller_edges(statements: DataFrame) -> DataFrame:
    """GR-01, FLT-19: distinct (app, src, dst, role) from invoke statements (app, method, stmt)."""
    k = _scope(statements)
    dst = F.regexp_extract("stmt", "(<.*>)", 1)
    rows = statements.where(F.col("stmt").contains("invoke") & (dst != "")).select(*k, F.col("method").alias("src"), dst.alias("dst"))
    role = (
        F.when(F.col("dst").contains("sendMessage("), "message")
        .when(F.col("dst").rlike(r"execute(OnExecutor)?\("), "async")
        .when(F.col("dst").contains("setOnClickListener("), "click")
        .when(F.col("dst").contains("Thread: void start("), "thread")
        .when(F.col("dst").contains("startActivity("), "component")
        .otherwise("call")
    )
    return rows.withColumn("role", role).distinct()


def thread_edges(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """JN-09: callers of a class's `start()` to the `run()` of the same class of their app, by an equi-join on the class."""
    k = _scope(edges)
    cls = lambda c: F.regexp_extract(c, "^<([^:]+):", 1)
    start = edges.where(F.col("dst").contains("void start()")).select(*k, "src", cls(F.col("dst")).alias("class"))
    run = methods.where(F.col("method").contains("void run()")).select(*k, F.col("method").alias("dst"), cls(F.col("method")).alias("class"))
    return start.join(run, [*k, "class"]).select(*k, "src", "dst").distinct()


def implicit_edges(edges: DataFrame, methods: DataFrame, call: str, target: str) -> DataFrame:
    """JN-10 to JN-12: every caller of a method matching ``call`` to every method of its app matching ``target``.

    The pairs go through one hub node for each app, so they are stored as callers +
    targets; closures over them reach the same methods one step later.
    """
    k = _scope(edges)
    hub = F.concat(F.lit(f"hub:{call}->{target}"), *([F.lit("@"), F.col("app")] if k else []))
    into = edges.where(F.col("dst").rlike(call)).select(*k, "src", hub.alias("dst")).distinct()
    out = methods.where(F.col("method").rlike(target)).select(*k, hub.alias("src"), F.col("method").alias("dst")).distinct()
    return into.unionByName(out)


def component_edges(edges: DataFrame, methods: DataFrame, targets: DataFrame, first_only: bool = True) -> DataFrame:
    """JN-13, JN-18: callers of `startActivity(` to onCreate of their target classes that exist in the app. targets: (app, method, ord, class)."""
    k = _scope(edges)
    if first_only:
        targets = targets.groupBy(*k, "method").agg(F.min_by("class", "ord").alias("class"))
    callers = edges.where(F.col("dst").contains("startActivity(")).select(*k, F.col("src").alias("method")).distinct()
    rows = callers.join(targets, [*k, "method"]).select(*k, F.col("method").alias("src"), F.format_string("<%s: void onCreate(android.os.Bundle)>", "class").alias("dst"))
    return rows.join(methods.select(*k, F.col("method").alias("dst")), [*k, "dst"], "left_semi").select(*k, "src", "dst").distinct()


def augment(edges: DataFrame, methods: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """GR-04: all implicit edges added."""
    base = edges.select(*_scope(edges), "src", "dst")
    parts = [
        thread_edges(base, methods),
        implicit_edges(base, methods, r"sendMessage\(", r"handleMessage\("),
        implicit_edges(base, methods, r"execute(OnExecutor)?\(", r"(doInBackground|onPreExecute|onPostExecute|onProgressUpdate)\("),
        implicit_edges(base, methods, r"setOnClickListener\(", r"onClick\("),
    ]
    if targets is not None:
        parts.append(component_edges(base, methods, targets))
    for p in parts:
        base = base.unionByName(p)
    return base.distinct()


def absolute_positions(nodes: DataFrame) -> DataFrame:
    """GR-08, SF-32: (tree, node, x, y, depth): offsets added from the root down. nodes: (tree, node, parent, left, top); roots have a null parent.

    Every node's pointer up doubles its reach in each round, so trees take as many
    rounds as the logarithm of their depth. Nodes below a missing parent, and
    those on a cycle or below one, have no position.
    """
    far = _cut(nodes.select("tree", "node", F.col("parent").alias("up"), F.col("left").alias("x"), F.col("top").alias("y"), F.col("parent").isNotNull().cast("int").alias("depth")))
    left = None
    while (open_ := far.where("up IS NOT NULL").count()) and open_ != left:
        left = open_
        above = far.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("depth").alias("depth2"))
        moved = far.where("up IS NOT NULL").join(above, ["tree", "up"]).selectExpr("tree", "node", "up2 AS up", "x + x2 AS x", "y + y2 AS y", "depth + depth2 AS depth")
        far = _cut(far.where("up IS NULL").unionByName(moved))
    return far.where("up IS NULL").select("tree", "node", "x", "y", "depth")


def resolve_drawables(references: DataFrame, files: DataFrame) -> DataFrame:
    """GR-09: (app, name, image, trace): files that a drawable name leads to through XML references, without going round.

    references: (app, name, target) from XML drawables; files: (app, name, image).
    Walks end when every trace has met a file or itself.
    """
    walk = references.select("app", "name").union(files.select("app", "name")).distinct().select("app", F.col("name").alias("start"), "name", F.array("name").alias("trace"))
    out = None
    while True:
        hit = walk.join(files, ["app", "name"]).select("app", F.col("start").alias("name"), "image", "trace")
        out = hit if out is None else out.unionByName(hit)
        walk = _cut(
            walk.join(references, ["app", "name"]).where(~F.array_contains("trace", F.col("target")))
            .select("app", "start", F.col("target").alias("name"), F.concat("trace", F.array("target")).alias("trace"))
        )
        if walk.isEmpty():
            return out


def control_dependence(edges: DataFrame) -> DataFrame:
    """GR-13: (method, branch, node): nodes whose run a branch decides, from flow edges (method, src, dst) of each method.

    Post-dominators are worked out per method, whose graph is one body of code.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        succ: dict = {}
        for s, d in zip(pdf["src"], pdf["dst"]):
            succ.setdefault(s, set()).add(d)
            succ.setdefault(d, set())
        every = set(succ)
        post = {n: ({n} if not succ[n] else set(every)) for n in every}
        moved = True
        while moved:
            moved = False
            for n in sorted(every, reverse=True):
                if succ[n]:
                    new = set.intersection(*(post[m] for m in succ[n])) | {n}
                    if new != post[n]:
                        post[n], moved = new, True
        got = [(b, n) for b in every if len(succ[b]) > 1 for n in every if any(n in post[m] for m in succ[b]) and not (n in post[b] and n != b)]
        return pd.DataFrame({"method": [pdf["method"].iloc[0]] * len(got), "branch": [b for b, _ in got], "node": [n for _, n in got]}).astype({"method": str, "branch": "int64", "node": "int64"})

    return edges.groupBy("method").applyInPandas(run, "method string, branch long, node long")
