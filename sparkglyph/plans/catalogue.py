"""Queries of the engine's operators over the driver tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import aggregates as G
from ..operators import association as A
from ..operators import features as E
from ..operators import graph as R
from ..operators import metrics as M
from ..operators import outlier as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(c: str | F.Column) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("""SELECT o_orderkey, coalesce(string_agg(p, ',' ORDER BY p), '') AS parts, count(p) AS n
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, CAST(l_partkey AS VARCHAR) AS p FROM lineitem) l ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def q01_widget_handler_left_join(spark, t):
    key = lambda c: F.col(c).cast("string")
    event = F.struct(F.lit("click").alias("event"), F.array(key("l_partkey")).alias("handlers"))
    model = t("lineitem").select(
        F.lit("x").alias("app"), F.lit("LID[1|layout_o]").alias("window"), F.concat(F.lit("INFL[B,WID["), key("l_orderkey"), F.lit("|o]1,2]3")).alias("view"),
        F.array().cast("array<string>").alias("images"), F.array(event).alias("handlers"),
    )
    pairs = t("orders").select(F.lit("x").alias("app"), key("o_orderkey").alias("image"), F.col("o_orderkey").alias("id"), F.lit("o").alias("id_name"), F.lit("o.xml").alias("layout"))
    out = A.associate(pairs, A.widget_handlers(model))
    return out.select(F.col("id").alias("o_orderkey"), F.array_join("handlers", ",").alias("parts"), F.size("handlers").cast("long").alias("n"))


@query("SELECT l_partkey AS part, l_suppkey AS supp FROM lineitem UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def q02_union_distinct(spark, t):
    l = t("lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_returnflag")
    return A.image_widgets(l.select("part", "supp"), l.where("l_returnflag = 'R'").select("part", "supp"))


@query("""WITH h AS (SELECT n_regionkey, min(n_name) AS head FROM nation GROUP BY n_regionkey)
SELECT n.n_name AS image, w.n_nationkey AS widget FROM nation n JOIN h USING (n_regionkey) JOIN nation w ON w.n_name = CASE WHEN n.n_nationkey % 2 = 0 THEN h.head ELSE n.n_name END""")
def q03_group_propagation(spark, t):
    n = t("nation")
    pairs = n.select(F.lit("x").alias("app"), F.col("n_name").alias("image"), F.col("n_nationkey").alias("id"), F.lit("").alias("id_name"), F.lit("").alias("layout"))
    groups = n.groupBy("n_regionkey").agg(F.min("n_name").alias("head"), F.collect_set(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))).alias("images"))
    groups = groups.select(F.lit("x").alias("app"), F.col("n_regionkey").alias("ord"), "head", "images")
    return A.propagate(pairs, groups).select("image", F.col("id").alias("widget"))


@query("""SELECT user_id, event_type, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events) GROUP BY ALL""")
def q04_merge_sets(spark, t):
    rows = t("events").select(F.col("user_id").alias("apk"), F.col("event_type").alias("image"), F.lit("").alias("layout"), F.array(F.get_json_object("props", "$.k")).alias("permissions"))
    return A.merge_permissions(rows).select(F.col("apk").alias("user_id"), F.col("image").alias("event_type"), F.array_join("permissions", ",").alias("ks"))


@query("""SELECT c_custkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)))::DOUBLE AS score
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey ORDER BY score DESC, c_custkey LIMIT 100""")
def q05_flagship_assoc_rank(spark, t):
    orders = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("v")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # distinct pairs of each kind and the sum, each aggregated before its shuffle; no row is expanded
    count = lambda c, name: rows.select("c_custkey", c).distinct().groupBy("c_custkey").agg(F.count(c).alias(name))
    v = rows.groupBy("c_custkey").agg(F.sum("v").cast("double").alias("score")).join(count("l_partkey", "parts"), "c_custkey").join(count("l_suppkey", "suppliers"), "c_custkey")
    return G.ranked(v.select("c_custkey", "parts", "suppliers", "score"), "score", "c_custkey", 100)


@query("SELECT event_id, 'k' || json_extract_string(props, '$.k') || ',' || event_type AS items FROM events")
def q06_decode_list_cell(spark, t):
    cell = F.format_string("['k%s', '%s', '%s']", F.get_json_object("props", "$.k"), "event_type", "event_type")
    return t("events").select("event_id", F.array_join(P.decode_list(cell), ",").alias("items"))


@query("""WITH g AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'NETWORK' WHEN 'view' THEN 'LOCATION' WHEN 'purchase' THEN 'SMS' END AS grp FROM events)
SELECT grp, count(*) AS n FROM g WHERE grp IS NOT NULL GROUP BY grp""")
def q07_group_dimension(spark, t):
    names = {"click": "android.permission.INTERNET", "view": "android.permission.ACCESS_FINE_LOCATION", "purchase": "android.permission.SEND_SMS"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    rows = t("events").select("event_id", F.array(F.coalesce(F.try_element_at(m, F.col("event_type")), F.lit("android.permission.VIBRATE"))).alias("permissions"))
    return A.sensitive(rows).select(F.explode("permissions").alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ',' || p_type ELSE p_name END AS permissions FROM part")
def q08_override_left_join(spark, t):
    p = t("part")
    rows = p.select("p_partkey", F.col("p_partkey").alias("method"), F.array("p_name").alias("permissions"))
    m = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("method"), F.array("p_brand", "p_type").alias("permissions"))
    return A.override(rows, m).select("p_partkey", F.array_join("permissions", ",").alias("permissions"))


@query("SELECT l_partkey AS part, min(s_name) AS permission FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey")
def q09_first_match_lookup(spark, t):
    rows = t("lineitem").select("l_partkey", "l_suppkey").distinct().join(t("supplier").select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"))
    return A.first_permission(rows.select(F.col("l_partkey").alias("method"), F.col("s_name").alias("permission"))).withColumnRenamed("method", "part")


@query("SELECT c_custkey AS app FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q10_anti_join_handled(spark, t):
    return A.unhandled(t("customer").select(F.col("c_custkey").alias("app")), t("orders").select(F.col("o_custkey").alias("app")))


@query("""SELECT s_name AS src, '<' || n_name || ': void onCreate(android.os.Bundle)>' AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey
WHERE n_regionkey <> 2 AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')""")
def q11_semi_exists(spark, t):
    s = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "s_name", "n_name", "n_regionkey")
    calls = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"), F.lit("<a: void startActivity(I)>").alias("dst"))
    edges = calls.join(s, "s_suppkey").select(F.col("s_name").alias("src"), "dst")
    methods = t("nation").where("n_regionkey <> 2").select(F.format_string("<%s: void onCreate(android.os.Bundle)>", "n_name").alias("method"))
    return R.component_edges(edges, methods, s.select(F.col("s_name").alias("method"), F.lit(0).alias("ord"), F.col("n_name").alias("class")))


@query("""SELECT DISTINCT c_name AS src, '<' || n_name || ': void run()>' AS dst FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 3 AND c_acctbal > 0""")
def q12_thread_join(spark, t):
    call = F.when(F.col("c_acctbal") > 0, F.format_string("<%s: void start()>", "n_name")).otherwise("<x: void stop()>")
    edges = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_name").alias("src"), call.alias("dst"))
    return R.thread_edges(edges, t("nation").where("n_regionkey <> 3").select(F.format_string("<%s: void run()>", "n_name").alias("method")))


@query("""SELECT n_name, e.event_type FROM nation, (SELECT DISTINCT event_type FROM events WHERE length(event_type) > 4) e WHERE n_regionkey IN (1, 2)""")
def q13_filtered_cross_join(spark, t):
    edges = t("nation").where("n_regionkey IN (1, 2)").select(F.col("n_name").alias("src"), F.lit("setOnClickListener(").alias("dst"))
    methods = t("events").where(F.length("event_type") > 4).select(F.concat(F.lit("onClick("), "event_type").alias("method")).distinct()
    hubs = R.implicit_edges(edges, methods, r"setOnClickListener\(", r"onClick\(")
    into, out = hubs.where(F.col("dst").startswith("hub:")), hubs.where(F.col("src").startswith("hub:"))
    both = into.select(F.col("src").alias("n_name"), F.col("dst").alias("hub")).join(out.select(F.col("src").alias("hub"), "dst"), "hub")
    return both.select("n_name", P.strip_prefix(F.col("dst"), "onClick(").alias("event_type"))


STOP = ["the", "of", "and", "de", "la", "der", "die"]
_TOKENS = r"""SELECT doc_id, pos, t AS raw FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS pos
FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS w FROM documents))
WHERE length(t) > 1 AND t NOT IN ('the','of','and','de','la','der','die')"""


@query(f"SELECT d.doc_id, count(t.raw) AS n, coalesce(sum(length(t.raw)), 0)::BIGINT AS letters FROM documents d LEFT JOIN ({_TOKENS}) t USING (doc_id) GROUP BY d.doc_id")
def q14_tokenize(spark, t):
    d = t("documents").select("doc_id", E.text_tokens(F.array("text"), STOP).alias("tokens"))
    return d.select("doc_id", F.size("tokens").cast("long").alias("n"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("letters"))


def _doc_tokens(t):
    return t("documents").select("doc_id", E.text_tokens(F.array("text"), STOP).alias("tokens"))


_LOWER = f"SELECT doc_id, pos, lower(raw) AS token FROM ({_TOKENS})"
_VOCAB = f"SELECT token, row_number() OVER (ORDER BY f) + 1 AS id FROM (SELECT token, min((doc_id, pos)) AS f FROM ({_LOWER}) GROUP BY token HAVING count(*) > 5)"


@query(f"SELECT token, id::BIGINT AS id FROM ({_VOCAB})")
def q15_vocab(spark, t):
    return E.vocabulary(_doc_tokens(t), "doc_id", "tokens", 5).select("token", F.col("id").cast("long").alias("id"))


@query(f"""WITH v AS ({_VOCAB}), i AS (SELECT doc_id, pos, coalesce(id, 1) AS id FROM ({_LOWER}) LEFT JOIN v USING (token)),
a AS (SELECT doc_id, list(id ORDER BY pos) AS l FROM i GROUP BY doc_id)
SELECT doc_id, array_to_string(list_resize(coalesce(l, []), 20, 0), ',') AS ids FROM documents LEFT JOIN a USING (doc_id)""")
def q16_index_tokens(spark, t):
    d = _doc_tokens(t)
    ids = E.index_tokens(d, "doc_id", "tokens", E.vocabulary(d, "doc_id", "tokens", 5))
    return ids.select("doc_id", joined(V.pad(F.col("ids"), 20)).alias("ids"))


@query(r"""SELECT p_partkey, regexp_replace(replace(n, '_', ' '), '(\p{Ll})(\p{Lu})', '\1 \2', 'g') AS words
FROM (SELECT p_partkey, replace(p_brand, '#', '_') || '_idTextView' || p_partkey AS n FROM part)""")
def q17_resource_words(spark, t):
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_idTextView"), F.col("p_partkey").cast("string"))
    return t("part").select("p_partkey", F.array_join(X.name_words(name), " ").alias("words"))


@query(r"""SELECT lang, l AS detected, count(*) AS n FROM (SELECT lang, CASE WHEN NOT regexp_matches(text, '\p{L}') THEN NULL
WHEN regexp_matches(text, '[一-鿿]') THEN 'chinese' WHEN regexp_matches(text, '[ࠀ-一]') THEN 'japanese'
WHEN regexp_matches(text, '[가-힣]') THEN 'korean' ELSE 'english' END AS l
FROM (SELECT lang, text FROM documents UNION ALL SELECT 'x', unnest(['猫', 'かな', '한국어', '123', 'かな漢字']))) GROUP BY ALL""")
def q18_language_detect(spark, t):
    more = spark.createDataFrame([("x", s) for s in ("猫", "かな", "한국어", "123", "かな漢字")], "lang string, text string")
    d = t("documents").select("lang", "text").unionByName(more)
    return d.groupBy("lang", X.language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL)
SELECT source, lang FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1""")
def q19_mode_tie(spark, t):
    return G.mode_first(t("documents").select("source", "lang", "doc_id"), ["source"], "lang", "doc_id", "english")


@query("""SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS largest, arg_min(p_partkey, (p_size, p_partkey)) AS smallest FROM part GROUP BY p_brand""")
def q20_argmax_argmin(spark, t):
    p = t("part").select("p_brand", "p_partkey", "p_size", F.col("p_partkey").alias("tie"))
    big = G.argmax(p, ["p_brand"], "p_partkey", "p_size", "tie").select("p_brand", F.col("p_partkey").alias("largest"))
    return big.join(G.argmin(p, ["p_brand"], "p_partkey", "p_size", "tie").select("p_brand", F.col("p_partkey").alias("smallest")), "p_brand")


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_totalprice > 100000)
SELECT o_custkey, o_orderpriority, o_orderkey FROM s QUALIFY o_orderpriority = min(o_orderpriority) OVER (PARTITION BY o_custkey)""")
def q21_bucket_priority(spark, t):
    rows = t("orders").select("o_custkey", "o_orderpriority", F.when(F.col("o_totalprice") > 100000, F.col("o_orderkey")).alias("o_orderkey"))
    return G.best_bucket(rows, ["o_custkey"], "o_orderpriority", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


_PRED = """SELECT doc_id, quality, toxic, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS hq, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS ht FROM labels JOIN documents USING (doc_id)"""


def _labelled(t):
    rows = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", "quality", "toxic", (F.col("n_chars") > 300).cast("int").alias("hq"), (F.col("doc_id") % 7 == 0).cast("int").alias("ht"))


@query(f"""WITH r AS (SELECT quality * hq + toxic * ht AS tp, quality + toxic AS y, hq + ht AS p, quality = hq AND toxic = ht AS same FROM ({_PRED})),
m AS (SELECT avg(CASE WHEN p > 0 THEN tp / p ELSE 0 END) AS a, avg(CASE WHEN y > 0 THEN tp / y ELSE 0 END) AS b, avg(CAST(same AS INT)) AS c FROM r)
SELECT round(a, 6) AS precision, round(b, 6) AS recall, round(c, 6) AS accuracy, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 6) AS f1 FROM m""")
def q22_example_prf(spark, t):
    ids = lambda a, b: V.from_multi_hot(F.array(a, b))
    rows = _labelled(t).select(ids("quality", "toxic").alias("truth"), ids("hq", "ht").alias("predicted"))
    return M.example_scores(rows, "truth", "predicted").select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy", "f1")))


@query(f"""WITH l AS (SELECT 0 AS label, quality AS y, hq AS h FROM ({_PRED}) UNION ALL SELECT 1, toxic, ht FROM ({_PRED})),
s AS (SELECT label, sum(y * h) AS tp, sum((1 - y) * h) AS fp, sum(y * (1 - h)) AS fn, avg(CAST(y = h AS INT)) AS acc FROM l GROUP BY label),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM s)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, (tp + fn)::BIGINT AS support, round(acc, 6) AS accuracy FROM p""")
def q23_label_prf(spark, t):
    r = _labelled(t).select(F.posexplode(F.array(F.struct(F.col("quality").alias("y"), F.col("hq").alias("yhat")), F.struct(F.col("toxic").alias("y"), F.col("ht").alias("yhat")))).alias("label", "v"))
    m = M.label_scores(r.select("label", "v.y", "v.yhat"))
    return m.select("label", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(s, 1) - 1 AS label, unnest(s) AS v FROM (SELECT vec_id, embedding AS s FROM embeddings)),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, label DESC) AS rank FROM e)
SELECT k::INT AS k, label::INT AS label, count(*) FILTER (rank <= k) AS n FROM r, (SELECT unnest(range(1, 65)) AS k) GROUP BY ALL""")
def q24_topk_mask(spark, t):
    s = t("embeddings").select("vec_id", F.posexplode("embedding").alias("label", "score"))
    return M.top_k_masks(s, "vec_id", "label", "score", 64).groupBy("k", "label").agg(F.sum("yhat").alias("n"))


_CURVE = """SELECT quality AS y, doc_id, (doc_id * 7919 % 1000) / 1000.0 AS s FROM labels"""


def _scored(t):
    return t("labels").select("doc_id", F.col("quality").alias("y"), (F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000.0).alias("s"))


@query(f"""WITH c AS (SELECT row_number() OVER w AS k, sum(y) OVER w AS h, sum(y) OVER () AS p, count(*) OVER () AS n FROM ({_CURVE}) WINDOW w AS (ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING))
SELECT k, round(h / k, 6) AS precision, round(h / p, 6) AS recall, p::BIGINT AS p FROM c WHERE k < n AND p > 0 AND p < n""")
def q25_prec_recall_curve(spark, t):
    return M.curve(_scored(t), "s", "doc_id", "y").select("k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "p")


@query(f"""WITH r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM ({_CURVE}))
SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r""")
def q26_auc(spark, t):
    return M.auc(_scored(t), "s", "y").select(F.round("auc", 6).alias("auc"))


@query("SELECT l_returnflag, l_linenumber, round(avg(l_discount), 6) AS mean, round(var_pop(l_discount), 6) AS variance FROM lineitem GROUP BY ALL")
def q27_mean_var_runs(spark, t):
    m = M.runs_summary(t("lineitem"), ["l_returnflag", "l_linenumber"], "l_discount")
    return m.select("l_returnflag", "l_linenumber", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem),
e AS (SELECT p AS src, s AS dst FROM p UNION ALL SELECT s, p FROM p),
r AS (SELECT 'p11' AS node, 0 AS d UNION SELECT e.dst, d + 1 FROM r JOIN e ON e.src = r.node WHERE d < 4)
SELECT node, min(d) AS depth FROM r WHERE node <> 'p11' GROUP BY node""")
def q28_reachability(spark, t):
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    pairs = t("lineitem").select(k("p", "l_partkey").alias("p"), k("s", "l_suppkey").alias("s")).distinct()
    edges = pairs.selectExpr("p AS src", "s AS dst").union(pairs.selectExpr("s", "p"))
    return R.reach(edges, spark.createDataFrame([("p11",)], "start string"), most=4).select("node", "depth")


_HIER = """SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region"""


def _hierarchy(t, customers: bool = True):
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t("nation").select(k("n", "n_nationkey").alias("src"), k("r", "n_regionkey").alias("dst")).union(t("region").select(k("r", "r_regionkey"), F.lit("world")))
    return e.union(t("customer").select(k("c", "c_custkey"), k("n", "c_nationkey"))) if customers else e


_CLOSED = f"""WITH RECURSIVE e AS ({_HIER}), r AS (SELECT src AS sub, src AS super, 0 AS depth FROM e UNION SELECT 'world', 'world', 0 UNION SELECT sub, dst, depth + 1 FROM r JOIN e ON src = super)"""


@query(f"{_CLOSED} SELECT super, count(*) AS n, sum(depth)::BIGINT AS depths FROM r GROUP BY super")
def q29_closure(spark, t):
    return R.closure(_hierarchy(t)).groupBy("super").agg(F.count("*").alias("n"), F.sum("depth").alias("depths"))


@query(f"""{_CLOSED} SELECT sub, arg_min(super, (depth, super)) AS target, min(depth) AS depth FROM r
WHERE super = 'world' OR (super LIKE 'n%' AND CAST(super[2:] AS INT) % 3 = 0) OR (super LIKE 'r%' AND CAST(super[2:] AS INT) % 2 = 0) GROUP BY sub""")
def q30_dispatch_nearest(spark, t):
    closed = R.closure(_hierarchy(t))
    num = F.expr("CAST(substring(class, 2) AS INT)")
    names = _hierarchy(t, False).select(F.col("src").alias("class"))
    declares = names.where((F.col("class").startswith("n") & (num % 3 == 0)) | (F.col("class").startswith("r") & (num % 2 == 0))).union(spark.createDataFrame([("world",)], "class string")).withColumn("subsig", F.lit("f"))
    return R.dispatch(closed, declares).select("sub", "target", "depth")


@query("""SELECT 'n' || a.n_nationkey AS a, 'n' || b.n_nationkey AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN 'r' || a.n_regionkey ELSE 'world' END AS ancestor
FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5""")
def q31_lca_sibling(spark, t):
    pairs = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("a"), F.concat(F.lit("n"), (F.col("n_nationkey") + 5).cast("string")).alias("b"))
    return R.common_ancestor(R.closure(_hierarchy(t, False)), pairs).select("a", "b", "ancestor")


@query("""SELECT 'c' || c_custkey AS node, (c_custkey % 13 + c_nationkey % 7 + n_regionkey)::BIGINT AS x, (1 + 2 + 3)::BIGINT AS y FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def q32_tree_coordinates(spark, t):
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = lambda df, node, parent, left, top: df.select(F.lit(1).alias("tree"), node.alias("node"), parent.alias("parent"), left.cast("long").alias("left"), F.lit(top).cast("long").alias("top"))
    nodes = n(t("region"), k("r", "r_regionkey"), F.lit(None).cast("string"), F.col("r_regionkey"), 1)
    nodes = nodes.union(n(t("nation"), k("n", "n_nationkey"), k("r", "n_regionkey"), F.col("n_nationkey") % 7, 2))
    nodes = nodes.union(n(t("customer"), k("c", "c_custkey"), k("n", "c_nationkey"), F.col("c_custkey") % 13, 3))
    return R.absolute_positions(nodes).where(F.col("node").startswith("c")).select("node", "x", "y")


_KNN = """WITH t AS (SELECT min(vec_id) AS tid, label, embedding::DOUBLE[] AS v FROM embeddings GROUP BY label, embedding),
n AS (SELECT q.vec_id AS id, q.label AS grp, tid, v, round(list_distance(q.embedding::DOUBLE[], v), 6) AS d FROM embeddings q JOIN t USING (label) WHERE q.vec_id % 20 = 0 AND tid <> q.vec_id),
k AS (SELECT * , row_number() OVER (PARTITION BY id ORDER BY d, tid) AS rank FROM n QUALIFY rank <= 5)"""


def _near(t):
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vector"))
    return O.neighbours(e.where("id % 20 = 0"), e.withColumnRenamed("id", "tid"), 5, decimals=6, others=True)


@query(f"{_KNN} SELECT id, grp, rank::INT AS rank, tid, d AS distance FROM k")
def q33_knn(spark, t):
    return _near(t).select("id", "grp", "rank", "tid", "distance")


@query(f"{_KNN} SELECT a.id, a.grp, round(1 / avg(list_distance(a.v, b.v)), 4) AS weight FROM k a JOIN k b ON a.id = b.id AND a.rank < b.rank GROUP BY ALL")
def q34_pairwise_weight(spark, t):
    w = O.neighbourhood_weight(_near(t))
    return w.select("id", "grp", F.round("weight", 4).alias("weight"))


@query("""WITH r AS (SELECT event_id % 100 AS id, event_type AS grp, avg(value) AS score, 1 + (event_id % 100) / 50.0 AS weight, (event_id % 100) / 100.0 AS prob FROM events GROUP BY ALL)
SELECT id, round(sum(score * (0.5 * weight + 0.5 * (1 - prob))) + 0.0000123, 4) AS score FROM r GROUP BY id""")
def q35_score_fusion(spark, t):
    e = t("events").select((F.col("event_id") % 100).alias("id"), F.col("event_type").alias("grp"), "value")
    s = e.groupBy("id", "grp").agg(F.avg("value").alias("score"))
    w, p = s.select("id", "grp", (1 + F.col("id") / 50.0).alias("weight")), s.select("id", "grp", (F.col("id") / 100.0).alias("prob"))
    # off the ties of rounding, which the order of summing would decide
    return O.fuse(s, w, p).select("id", F.round(F.col("score") + 0.0000123, 4).alias("score"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY substr(md5('7|' || o_orderkey), 1, 15), o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN r < floor(n * 0.7) THEN 'train' WHEN r < floor(n * 0.7) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS part FROM r""")
def q36_shuffle_split(spark, t):
    return E.split_exact(t("orders").select("o_orderkey"), "o_orderkey", {"train": 0.7, "valid": 0.1, "test": 0.2}, 7)


@query("""SELECT event_id, array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN i = event_id % 4 OR i = user_id % 4 THEN 1 ELSE 0 END), ',') AS hot,
array_to_string(list_sort(list_distinct([event_id % 4, user_id % 4])), ',') AS ids FROM events""")
def q37_multi_hot(spark, t):
    e = t("events").select("event_id", V.multi_hot(F.array((F.col("event_id") % 4).cast("int"), (F.col("user_id") % 4).cast("int")), 4).alias("hot"))
    return e.select("event_id", joined(V.threshold(F.col("hot"), 0.5)).alias("hot"), joined(V.from_multi_hot(F.col("hot"))).alias("ids"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN 'base ' || n_name ELSE 'base' END AS param,
CASE WHEN n_regionkey IN (0, 1) THEN n_regionkey ELSE -1 END AS kind FROM nation""")
def q38_config_override(spark, t):
    k = F.col("n_nationkey") % 3
    empty = F.lit("")
    param = P.with_defaults(F.lit("base"), F.when(k == 0, F.col("n_name")).otherwise(empty), F.when(k == 1, F.col("n_name")).otherwise(empty))
    return t("nation").select("n_nationkey", param.alias("param"), P.clamp(F.col("n_regionkey"), [0, 1], -1).alias("kind"))


@query()
def q43_nms(spark, t):
    p = t("part")
    boxes = p.select("p_brand", *(F.pmod(F.xxhash64("p_partkey", F.lit(i)), F.lit(80)).cast("double").alias(c) for i, c in enumerate(("x0", "y0"))), (F.col("p_size") / 50.0).alias("score"))
    boxes = boxes.withColumns({"x1": F.col("x0") + 30, "y1": F.col("y0") + 20})
    return V.suppress(boxes.select("p_brand", "x0", "y0", "x1", "y1", "score"), "p_brand")


@query()
def q44_stem(spark, t):
    d = t("benchmark").select("item_id", X.stem_tokens(X.tokenize(F.col("text"))).alias("stems"))
    return d.select("item_id", F.array_join("stems", " ").alias("stems"))


@query()
def q45_spell(spark, t):
    words = t("documents").select(F.explode(X.tokenize(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq")).where("freq > 20")
    tokens = t("benchmark").select(F.explode(X.tokenize(F.lower("text"))).alias("token"))
    return X.correct_spelling(tokens, words)


@query()
def q46_pca_outlier(spark, t):
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vector"))
    return O.reconstruction(e.withColumnRenamed("id", "tid"), e).select("id", "grp", F.round("score", 5).alias("score"))


@query("""SELECT l_partkey AS src, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS dst FROM (SELECT DISTINCT l_partkey, l_suppkey AS s FROM lineitem) GROUP BY l_partkey""")
def q47_adjacency(spark, t):
    return G.adjacency(t("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))).select("src", joined("dst").alias("dst"))


@query("""SELECT DISTINCT p_partkey FROM part WHERE p_brand <> 'Brand#11' AND NOT starts_with(p_type, 'STANDARD')""")
def q48_library_filter(spark, t):
    rows = t("part").select("p_partkey", F.concat_ws(".", "p_type", "p_name").alias("cls"), "p_brand").where("p_brand <> 'Brand#11'")
    patterns = spark.createDataFrame([("STANDARD.*",)], "pattern string")
    return A.library_filter(rows, "cls", patterns).select("p_partkey")


from . import catalogue_files, catalogue_rows  # noqa: E402, F401  their queries register here
