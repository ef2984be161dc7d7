"""Queries of the association plan, graphs, choices, features, boxes, status tables and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import aggregates as G
from ..operators import association as A
from ..operators import features as E
from ..operators import graph as R
from ..operators import learning as N
from ..operators import metrics as M
from ..operators import orchestration as C
from ..operators import outlier as O
from ..operators.scratch import folder
from ..streaming import streams
from . import association as plan
from .catalogue import joined, query


def _s(c: str) -> F.Column:
    return F.col(c).cast("string")


def _name(*parts: str) -> F.Column:
    """Literals and, after a $, columns, put together."""
    return F.concat(*(_s(p[1:]) if p[0] == "$" else F.lit(p) for p in parts))


#: What a nation's handler does, by its key: a listener, a message, an async task, a thread, or a call of its own.
_CALLS = ("<v: void setOnClickListener(l)>", "<H: boolean sendMessage(M)>", "<A: X execute(P)>", "<t.T: void start()>", "<d.D: void direct()>")


@query("""SELECT 'r' || n_regionkey AS apk, n_name AS image, '<h.n' || n_nationkey || ': void go()>' AS handler,
['CLICK', 'MESSAGE', 'ASYNC', 'RUN', 'DIRECT'][n_nationkey % 5 + 1] || CASE WHEN n_nationkey % 5 < 3 THEN n_regionkey::VARCHAR ELSE '' END AS permissions FROM nation""")
def q83_handler_permissions(spark, t):
    n, r = t("nation"), t("region").withColumn("app", _name("r", "$r_regionkey"))
    app, handler = _name("r", "$n_regionkey").alias("app"), _name("<h.n", "$n_nationkey", ": void go()>")
    pairs = n.select(app, F.col("n_name").alias("image"), F.col("n_nationkey").alias("id"), F.lit("w").alias("id_name"), F.lit("l").alias("layout"), F.array(handler).alias("handlers"))
    edges = n.select(app, handler.alias("src"), F.element_at(F.array(*map(F.lit, _CALLS)), F.col("n_nationkey") % 5 + 1).alias("dst"))
    own = {"CLICK": "void onClick(v)", "MESSAGE": "void handleMessage(M)", "ASYNC": "void doInBackground(P)"}
    methods = [r.select("app", _name("<c.R", "$r_regionkey", f": {sig}>").alias("method"), _name(p, "$r_regionkey").alias("permission")) for p, sig in own.items()]
    methods += [r.select("app", F.lit(sig).alias("method"), F.lit(p).alias("permission")) for p, sig in (("RUN", "<t.T: void run()>"), ("DIRECT", "<d.D: void direct()>"))]
    known = methods[0]
    for m in methods[1:]:
        known = known.unionByName(m)
    out = plan.permissions(pairs, edges, known.select("app", "method"), known.select("method", "permission").distinct())
    return out.select("apk", "image", "handler", F.array_join("permissions", "|").alias("permissions"))


@query("""SELECT DISTINCT 'r' || a.n_regionkey AS app, a.n_name AS src, '<' || b.n_name || ': void onCreate(android.os.Bundle)>' AS dst
FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey = (SELECT min(n_nationkey) FROM nation c WHERE c.n_regionkey = a.n_regionkey AND c.n_nationkey >= a.n_nationkey) WHERE a.n_nationkey % 2 = 0""")
def q84_component_edges(spark, t):
    n = t("nation").withColumn("app", _name("r", "$n_regionkey"))
    edges = n.select("app", F.col("n_name").alias("src"), F.when(F.col("n_nationkey") % 2 == 0, "<x: void startActivity(I)>").otherwise("<x: void other()>").alias("dst"))
    to = n.select("app", F.col("n_name").alias("class"), F.col("n_nationkey").alias("ord"))
    targets = n.select("app", F.col("n_name").alias("method"), F.col("n_nationkey").alias("at")).join(to, "app").where("ord >= at").select("app", "method", "ord", "class")
    return R.component_edges(edges, n.select("app", _name("<", "$n_name", ": void onCreate(android.os.Bundle)>").alias("method")), targets)


@query("""SELECT 'm' || l_partkey AS src, CASE l_linenumber % 3 WHEN 0 THEN '<H: boolean sendMessage(M)>' WHEN 1 THEN '<s.S' || l_suppkey || ': void f()>' END AS dst,
CASE l_linenumber % 3 WHEN 0 THEN 'message' ELSE 'call' END AS role FROM lineitem WHERE l_linenumber % 3 < 2 GROUP BY ALL""")
def q85_caller_edges(spark, t):
    k = F.col("l_linenumber") % 3
    stmt = F.when(k == 0, "virtualinvoke r.<H: boolean sendMessage(M)>(m)").when(k == 1, _name("specialinvoke r.<s.S", "$l_suppkey", ": void f()>()")).otherwise("r = 1")
    return R.caller_edges(t("lineitem").select(_name("m", "$l_partkey").alias("method"), stmt.alias("stmt")))


@query("""SELECT n_name AS sub, ['view', 'menu', 'dialog', 'activity'][n_regionkey + 1] AS kind FROM nation WHERE n_regionkey < 4
UNION ALL SELECT r_name, ['view', 'menu', 'dialog', 'activity'][r_regionkey + 1] FROM region WHERE r_regionkey < 4 UNION ALL SELECT unnest(['android.view.View', 'android.view.Menu', 'android.app.Dialog', 'android.app.Activity']), unnest(['view', 'menu', 'dialog', 'activity'])""")
def q86_type_kinds(spark, t):
    root = F.element_at(F.array(*map(F.lit, [*R.KINDS.values(), "java.lang.Object"])), F.col("r_regionkey") + 1)
    edges = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    return R.type_kinds(R.closure(edges.union(t("region").select("r_name", root))))


@query("SELECT n_name AS class, 'f' AS subsig FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 AND n_regionkey <> 1")
def q87_callbacks(spark, t):
    n, r = t("nation"), t("region")
    closed = R.closure(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst")))
    framework = r.where("r_regionkey <> 1").select(F.col("r_name").alias("class"), F.lit("f").alias("subsig"))
    app = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("class"), F.lit("f").alias("subsig"))
    return R.callbacks(closed, framework, app, n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("class")))


@query("""SELECT n_name AS sub, r_name AS super, 1 AS depth FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_name, n_name, 0 FROM nation
UNION ALL SELECT r_name, r_name, 0 FROM region UNION ALL SELECT n_name, 'Listener', 1 FROM nation WHERE n_nationkey < 5""")
def q88_added_subtypes(spark, t):
    n = t("nation")
    closed = R.closure(n.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst")))
    return R.add_subtypes(closed, n.where("n_nationkey < 5").select(F.col("n_name").alias("sub"), F.lit("Listener").alias("super")))


@query("SELECT DISTINCT c_name AS sub FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND c_acctbal > 0")
def q89_concrete_subtypes(spark, t):
    c, n, r = t("customer"), t("nation"), t("region")
    edges = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_name").alias("src"), F.col("n_name").alias("dst")).union(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"))
    roots = r.where("r_regionkey = 1").select(F.col("r_name").alias("super"))
    return R.subtypes(R.closure(edges), roots, c.where("c_acctbal > 0").select(F.col("c_name").alias("sub")))


@query("""SELECT a.n_name AS name, b.n_name || '.png' AS image, CASE WHEN a.n_name = b.n_name THEN a.n_name ELSE a.n_name || '>' || b.n_name END AS trace
FROM nation a JOIN (SELECT n_regionkey, min(n_name) AS n_name FROM nation GROUP BY n_regionkey) b USING (n_regionkey)""")
def q90_drawable_references(spark, t):
    n = t("nation").select(F.lit("x").alias("app"), F.col("n_name").alias("name"), "n_regionkey")
    heads = n.groupBy("n_regionkey").agg(F.min("name").alias("head"))
    # heads refer to themselves, which no trace follows
    refs = n.join(heads, "n_regionkey").select("app", "name", F.col("head").alias("target"))
    files = heads.select(F.lit("x").alias("app"), F.col("head").alias("name"), F.concat("head", F.lit(".png")).alias("image"))
    return R.resolve_drawables(refs, files).select("name", "image", F.array_join("trace", ">").alias("trace"))


@query("SELECT n_name AS method, 1::BIGINT AS branch, unnest([2, 3])::BIGINT AS node FROM nation WHERE n_nationkey % 2 = 0")
def q91_control_dependence(spark, t):
    even = F.col("n_nationkey") % 2 == 0  # a branch whose arms meet, or a straight line
    pair = lambda a, b: F.struct(F.lit(a).cast("long").alias("src"), F.lit(b).cast("long").alias("dst"))
    flow = F.when(even, F.array(pair(1, 2), pair(1, 3), pair(2, 4), pair(3, 4))).otherwise(F.array(pair(1, 2), pair(2, 3)))
    return R.control_dependence(t("nation").select(F.col("n_name").alias("method"), F.inline(flow)))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice, o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def q92_ordered_lists(spark, t):
    rows = t("orders").select("o_custkey", F.struct("o_totalprice", "o_orderkey").alias("at"), "o_orderkey")
    return G.collect_ordered(rows, ["o_custkey"], "o_orderkey", "at").select("o_custkey", joined("o_orderkey").alias("orders"))


@query(r"""SELECT count(*) AS rows_in, count(*) FILTER (after = 0) AS rows_emptied, sum(before)::BIGINT AS tokens_in, sum(after)::BIGINT AS tokens_out
FROM (SELECT len(w) AS before, len(list_filter(w, lambda x: length(x) > 3)) AS after FROM (SELECT regexp_extract_all(text, '\p{L}+') AS w FROM documents))""")
def q93_removed_tokens(spark, t):
    rows = t("documents").select(X.tokenize(F.col("text")).alias("before")).withColumn("after", X.drop_short(F.col("before"), 3))
    return G.removal_statistics(rows, "before", "after")


@query(r"SELECT DISTINCT unnest(list_concat(regexp_extract_all(text, '\p{L}+'), ['extra'])) AS token FROM benchmark")
def q94_raw_vocabulary(spark, t):
    return E.raw_vocabulary(t("benchmark").select(E.concat_texts(X.tokenize(F.col("text")), F.array(F.lit("extra"))).alias("w")), "w")


@query(r"SELECT item_id, len(list_filter(regexp_extract_all(text, '\p{L}+'), lambda x: length(x) <= 2)) AS n FROM benchmark")
def q95_short_tokens(spark, t):
    return t("benchmark").select("item_id", F.size(X.only_short(X.tokenize(F.col("text")), 2)).cast("long").alias("n"))


@query("SELECT c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY ALL")
def q96_class_statistics(spark, t):
    return G.class_statistics(t("customer").select(F.col("c_mktsegment").alias("kind")))


@query("SELECT p_partkey, unnest(['brand', 'type']) AS entry, unnest([p_brand, p_type]) AS value FROM part")
def q97_flatten_map(spark, t):
    m = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type")
    return G.flatten_map(t("part").select("p_partkey", m.alias("m")), "p_partkey", "m")


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END, CASE WHEN p_size > 25 THEN 'large' END], lambda x: x IS NOT NULL), ',') AS names FROM part")
def q98_reverse_lookup(spark, t):
    names = F.create_map(F.lit(0), F.lit("even"), F.lit(1), F.lit("odd"), F.lit(2), F.lit("large"))
    ids = F.array(F.col("p_size") % 2, F.when(F.col("p_size") > 25, 2).otherwise(99))
    return t("part").select("p_partkey", F.array_join(G.reverse_lookup(ids, names), ",").alias("names"))


@query("SELECT name, id FROM (SELECT unnest(['NETWORK', 'LOCATION', 'MICROPHONE', 'SMS', 'CAMERA', 'CALL', 'STORAGE', 'CONTACTS']) AS name, unnest(range(0, 8))::INT AS id)")
def q99_label_ids(spark, t):
    names = F.array(*map(F.lit, A.GROUPS))
    return spark.range(1).select(F.explode(E.label_ids(names)).alias("l")).select("l.name", "l.id")


@query("""WITH k AS (SELECT 'r' || n_regionkey AS type, n_name AS name, n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey % 3 = 0), c AS (SELECT type, count(*) AS n FROM k GROUP BY type)
SELECT * FROM k UNION ALL SELECT 'r' || n_regionkey, n_name, coalesce(n, 0) + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) FROM nation LEFT JOIN c ON type = 'r' || n_regionkey WHERE n_nationkey % 3 <> 0""")
def q100_resource_ids(spark, t):
    names = t("nation").select(_name("r", "$n_regionkey").alias("type"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"))
    return G.resource_ids(names.select("type", "name"), names.where("id % 3 = 0"))


_MARKED = "SELECT doc_id, quality AS mark, (doc_id * 7919 % 1000) / 1000.0 AS s FROM labels"


@query(f"""WITH c AS (SELECT row_number() OVER w AS k, sum(mark) OVER w AS h, sum(mark) OVER () AS p, count(*) OVER () AS n FROM ({_MARKED}) WINDOW w AS (ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING))
SELECT k, round(h / k, 6) AS precision, round(h / p, 6) AS recall FROM c WHERE k = p AND k < n""")
def q101_break_even(spark, t):
    rows = t("labels").select("doc_id", F.col("quality").alias("y"), (F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000.0).alias("s"))
    return M.break_even(M.curve(rows, "s", "doc_id", "y")).select("k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""WITH m AS (SELECT doc_id, unnest([0, 1]) AS label, unnest([2 * quality - 1, 2 * toxic - 1]) AS mark, unnest([doc_id * 7919 % 1000, doc_id * 104729 % 1000]) AS s FROM labels),
a AS (SELECT label, doc_id, s, (mark = 1)::INT AS y FROM m UNION ALL SELECT NULL, doc_id, sum(s), max((mark = 1)::INT) FROM m GROUP BY doc_id),
c AS (SELECT label, row_number() OVER w AS k, sum(y) OVER w AS h, sum(y) OVER (PARTITION BY label) AS p, count(*) OVER (PARTITION BY label) AS n FROM a WINDOW w AS (PARTITION BY label ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY s) + (count(*) OVER (PARTITION BY label, s) - 1) / 2.0 AS r FROM a),
u AS (SELECT label, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY label)
SELECT coalesce(c.label, -1)::INT AS label, round(h / k, 6) AS precision, round(h / p, 6) AS recall, round(auc, 6) AS auc FROM c JOIN u ON u.label IS NOT DISTINCT FROM c.label WHERE k = p AND k < n""")
def q102_outlier_evaluation(spark, t):
    score = lambda m: F.pmod(F.col("doc_id") * m, F.lit(1000))
    rows = t("labels").select("doc_id", F.posexplode(F.array(F.struct((2 * F.col("quality") - 1).alias("mark"), score(7919).alias("s")), F.struct((2 * F.col("toxic") - 1).alias("mark"), score(104729).alias("s")))).alias("label", "v"))
    got = M.evaluate(rows.select("doc_id", "label", "v.mark", "v.s"), "doc_id", "label", "s", "mark")
    return got.select(F.coalesce("label", F.lit(-1)).alias("label"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "auc")))


@query("SELECT doc_id, quality = 1 OR toxic = 1 AS positive FROM labels")
def q103_any_positive(spark, t):
    return t("labels").select("doc_id", M.any_positive(F.array("quality", "toxic")).alias("positive"))


@query("SELECT doc_id, quality AS y FROM labels WHERE doc_id % 3 <> 0")
def q104_marks(spark, t):
    mark = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(2 * F.col("quality") - 1)
    return M.marks(t("labels").select("doc_id", mark.alias("mark")), "mark").select("doc_id", "y")


@query("SELECT doc_id, CASE WHEN n_chars > 300 THEN 'long' ELSE 'short' END AS names, quality = (n_chars > 300)::INT AS correct, source FROM labels JOIN documents USING (doc_id)")
def q105_prediction_dump(spark, t):
    raw = t("documents").select("doc_id", "source", "n_chars")
    long = raw.select("doc_id", (F.col("n_chars") > 300).cast("int").alias("predicted"))
    rows = long.join(t("labels").select("doc_id", F.col("quality").alias("truth")), "doc_id").withColumn("tokens", F.array(F.col("predicted") + 1, F.lit(0)))
    names = F.create_map(F.lit(1), F.lit("short"), F.lit(2), F.lit("long"))
    return M.prediction_dump(rows, raw, "doc_id", names).select("doc_id", F.array_join("names", ",").alias("names"), "correct", "source")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 'first' ELSE 'later' END AS label FROM orders")
def q106_frame_labels(spark, t):
    return G.label_frames(t("orders"), ["o_custkey"], "o_orderkey").select("o_orderkey", "label")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 40 OFFSET 10")
def q107_index_range(spark, t):
    return G.index_range(t("part").select("p_partkey", "p_name"), "p_partkey", 11, 50)


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 2000000 WHEN 2 THEN 5000000 ELSE 6000000 END + p_size AS rank FROM part")
def q108_location_priority(spark, t):
    kind = F.element_at(F.array(*map(F.lit, ("direct", "first", "random", "elsewhere"))), F.col("p_size") % 4 + 1)
    return t("part").select("p_partkey", G.location_priority(kind, F.col("p_size")).alias("rank"))


@query("SELECT p_partkey, p_size > 4 AND p_partkey % 50 > 4 AND p_size <= 3 * (p_partkey % 50) AND p_partkey % 50 <= 3 * p_size AS fit, CASE WHEN p_size >= 1 AND p_partkey % 50 >= 1 AND p_size <= 10 * (p_partkey % 50) AND p_partkey % 50 <= 10 * p_size THEN p_name ELSE '' END AS texts FROM part")
def q109_icon_shapes(spark, t):
    img = F.struct(F.col("p_size").alias("w"), (F.col("p_partkey") % 50).alias("h"))
    rows = t("part").select("p_partkey", "p_name", img.alias("img"))
    fit = F.coalesce(E.icon_shape(F.col("img"), 5, 3), F.lit(False))
    return rows.where("p_partkey % 50 <> 0").select("p_partkey", fit.alias("fit"), F.array_join(E.ocr_guard(F.col("img"), F.array("p_name")), "").alias("texts")).unionByName(
        rows.where("p_partkey % 50 = 0").select("p_partkey", F.lit(False).alias("fit"), F.lit("").alias("texts"))
    )


@query("""SELECT p_partkey, r + b - (r + l) AS x0, 4 * (p_partkey % 7) + r AS x1, 4 * (p_partkey % 5) + b AS y1 FROM (SELECT p_partkey, p_size % 9 + 1 AS r, p_size % 5 + 1 AS b, p_size % 4 AS l FROM part) WHERE p_partkey % 10 >= 6""".replace("r + b - (r + l) AS x0", "4 * (p_partkey % 7) + r - (r + l) AS x0"))
def q110_rotated_boxes(spark, t):
    c = t("part").select(
        "p_partkey", (F.col("p_partkey") % 5).alias("row"), (F.col("p_partkey") % 7).alias("col"), ((F.col("p_partkey") % 10) / 10.0).alias("score"), F.lit(1).alias("top"),
        (F.col("p_size") % 9 + 1).alias("right"), (F.col("p_size") % 5 + 1).alias("bottom"), (F.col("p_size") % 4).alias("left"), F.lit(0.0).alias("angle"),
    )
    return V.rotated_boxes(c).select("p_partkey", *(F.col(x).cast("long").alias(x) for x in ("x0", "x1", "y1")))


@query("""SELECT p_partkey, greatest(0, 2 * p_size - p_size // 5) AS x0, least(100, 4 * p_size + 2 * (p_size // 5)) AS x1, 32 * greatest(1, p_size // 32) AS nw, round(p_size / (32.0 * greatest(1, p_size // 32)), 6) AS rw FROM part""")
def q111_box_scaling(spark, t):
    box = V.scale_box(F.col("p_size"), F.lit(0), 2 * F.col("p_size"), F.lit(10), 2, 1, F.lit(100), F.lit(100), 0.1)
    size = V.fit_size(F.col("p_size"), F.col("p_size"))
    return t("part").select("p_partkey", box[0].cast("long").alias("x0"), box[2].cast("long").alias("x1"), size[0].cast("long").alias("nw"), F.round(F.col("p_size") / size[0], 6).alias("rw"))


@query("SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_size, p_partkey) AS boxes FROM part GROUP BY p_brand")
def q112_reading_order(spark, t):
    b = t("part").groupBy("p_brand").agg(F.collect_list(F.struct(F.col("p_size").alias("y0"), F.col("p_partkey").alias("x0"))).alias("b"))
    return b.select("p_brand", F.array_join(F.transform(V.top_down(F.col("b")), lambda x: x["x0"].cast("string")), ",").alias("boxes"))


@query("""SELECT n_nationkey, 'a: ' || n_name AS signature, 'c.' || n_name AS class, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE -1 END AS level,
'"' || n_name || chr(92) || '"' || '"' AS quoted, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name || '; hint' ELSE 'hint' END AS label FROM nation""")
def q113_string_functions(spark, t):
    k = F.col("n_nationkey") % 3
    return t("nation").select(
        "n_nationkey", F.array_join(P.signatures(_name("x <a: ", "$n_name", "> y")), ",").alias("signature"), P.class_of(_name("<'c.", "$n_name", "': void f()>")).alias("class"),
        P.api_level(F.when(F.col("n_nationkey") % 2 == 0, _name("android-", "$n_nationkey")).otherwise("other")).alias("level"), P.quote(_name("$n_name", '"')).alias("quoted"),
        P.text_or_hint(F.when(k == 2, " ").otherwise(F.col("n_name")), F.when(k == 0, "").otherwise("hint")).alias("label"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'DONE' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'ERROR' ELSE 'ERROR' END AS status, (o_custkey % 900)::BIGINT AS seconds, o_custkey % 900 > 600 AS late FROM orders""")
def q114_run_status(spark, t):
    code = F.element_at(F.array(*map(F.lit, (0, -1, -2, 7))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    start = F.timestamp_seconds(F.col("o_orderkey"))
    rows = t("orders").select("o_orderkey", C.status_name(code).alias("status"), C.elapsed_seconds(start, F.timestamp_seconds(F.col("o_orderkey") + F.col("o_custkey") % 900)).alias("seconds"))
    return rows.withColumn("late", C.timed_out(F.col("seconds"), 600))


@query("""SELECT p_brand AS project, CASE min(CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END) WHEN 1 THEN 'studio' WHEN 2 THEN 'eclipse' ELSE 'unknown' END AS kind FROM part GROUP BY p_brand""")
def q115_project_kinds(spark, t):
    file = F.when(F.col("p_size") % 5 == 0, "x/build.gradle").when(F.col("p_size") % 5 == 1, "x/.project").otherwise("readme")
    return C.project_kind(t("part").select(F.col("p_brand").alias("project"), file.alias("file")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 2 WHEN p_partkey % 3 = 0 THEN 3 END AS worked FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def q116_retries(spark, t):
    rows = C.spread(t("part").select("p_partkey"), "p_partkey")
    return C.retry(rows, [{"m": 2}, {"m": 3}], lambda d, s: d.where(F.col("p_partkey") % s["m"] == 0).withColumn("worked", F.lit(s["m"])), "p_partkey")


@query("SELECT event_id, unnest([event_type, 'all']) AS grp FROM events")
def q117_items_of_groups(spark, t):
    return O.of_group(t("events").select("event_id", F.array("event_type", F.lit("all")).alias("perms")))


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type")
def q118_client(spark, t):
    @N.client("counts_above")
    def counts_above(df: DataFrame, least: str = "0") -> DataFrame:
        return df.where(F.col("value") > float(least)).groupBy("event_type").agg(F.count("*").alias("n"))

    return N.run_client("counts_above", t("events"), ["least=50"])


@query("""SELECT p_partkey, array_to_string([p_size % 3 = 0, p_size % 3 = 1]::INT[], ',') AS hot, CASE WHEN p_size % 3 < 2 THEN (p_size % 3)::VARCHAR ELSE '' END AS labels,
round(0.25 * p_size + 0.75 * p_retailprice, 4) AS blend FROM part""")
def q119_labels_and_blends(spark, t):
    label = F.array(F.col("p_size") % 3)
    named = E.encode_labels(F.transform(label, lambda x: F.element_at(F.array(*map(F.lit, ("a", "b", "none"))), x + 1)), ["a", "b"])
    mix = V.blend(F.array(F.col("p_size").cast("double")), F.array("p_retailprice"), 0.25)
    return t("part").select("p_partkey", joined(V.threshold(V.multi_hot(label, 2), 0.5)).alias("hot"), joined(named).alias("labels"), F.round(mix[0], 4).alias("blend"))


def _stream(spark, t, name: str) -> DataFrame:
    """A table as a stream of its files."""
    df = t(name)
    files = df.inputFiles()[0]
    base = files.rsplit("/", 1)[0] if files.rsplit("/", 2)[1] == f"{name}.parquet" else f"{files.rsplit('/', 1)[0]}/{name}.parq*"
    return spark.readStream.schema(df.schema).parquet(base)


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has returned once all its input is read, from the shared folder."""
    spark = stream.sparkSession
    path, schema = folder(spark, "stream"), stream.schema
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", folder(spark, "offsets")).trigger(availableNow=True)
    if mode == "append":
        q = q.format("parquet").option("path", path)
    else:  # the last batch holds the whole result
        q = q.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    q.start().awaitTermination()
    return spark.read.schema(schema).parquet(path)


@query("""WITH e AS (SELECT user_id, event_id, event_type, value, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER w AS b, max(CASE WHEN event_type = 'click' THEN event_id END) OVER w AS c
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT 'u' || user_id AS file, CASE WHEN b IS NOT NULL THEN 't' || b END AS test, CASE WHEN c > coalesce(b, -1) THEN (c % 1000)::INT ELSE -1 END AS rep, 'v' || event_id AS allocated FROM e WHERE event_type = 'purchase'""")
def q41_log_state_machine(spark, t):
    k = F.col("event_type")
    tag = F.when(k == "signup", "BEGIN").when(k == "click", "REP").when(k == "purchase", "MEM").otherwise("OTHER")
    value = F.when(k == "signup", _name("t", "$event_id")).when(k == "click", (F.col("event_id") % 1000).cast("string")).otherwise(_name("v", "$event_id"))
    lines = _stream(spark, t, "events").select(_name("u", "$user_id").alias("file"), F.col("event_id").alias("line"), tag.alias("tag"), value.alias("value"))
    return _run(streams.repetitions(lines), "append").withColumn("rep", F.coalesce("rep", F.lit(-1)))


@query("""SELECT epoch(time_bucket(INTERVAL 10 minutes, ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def q42_window_sampler(spark, t):
    got = _run(streams.samples(_stream(spark, t, "events"), "10 minutes"), "complete")
    return got.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 minutes THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def q120_sessions(spark, t):
    got = _run(streams.sessions(_stream(spark, t, "events")), "complete")
    return got.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("SELECT event_id, event_type FROM events WHERE event_id % 2 = 0")
def q121_incremental(spark, t):
    df = t("events").select("event_id", "event_type")
    source, target, offsets = (folder(spark, n) for n in ("source", "target", "offsets"))
    run = lambda: streams.incremental(spark, source, "event_id long, event_type string", "parquet", lambda d: d.where("event_id % 2 = 0"), target, offsets)
    df.where("event_id % 3 = 0").write.parquet(source)
    run()
    df.where("event_id % 3 <> 0").write.mode("append").parquet(source)
    run()  # what the first run has seen is not seen again
    return spark.read.parquet(target)
