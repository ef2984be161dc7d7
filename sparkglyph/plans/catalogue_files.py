"""Queries of readers and sinks: rows of the driver tables written in a format of the engine and read again, each with its SQL."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import aggregates as G
from ..operators import association as A
from ..operators import layout as L
from ..operators.scratch import folder
from ..sources import readers as S
from ..sources import sinks as K
from .catalogue import joined, query


def _text(df: DataFrame, name: str) -> str:
    """The rows' only column as lines of text files."""
    path = folder(df.sparkSession, name)
    df.write.text(path)
    return path


def _whole(rows: DataFrame, value: F.Column, name: str) -> str:
    """One file of one line: ``value``, an aggregate of all rows."""
    return _text(rows.agg(value.alias("value")).coalesce(1), name)


def _in_order(value: F.Column, key: str) -> F.Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"])


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content))
    out.close()


def _s(c: str) -> F.Column:
    return F.col(c).cast("string")


@query("SELECT p_partkey AS wid, p_name AS image, p_type || '|' || p_brand AS permissions, CASE WHEN p_partkey % 2 = 0 THEN 'h' || p_size END AS handler FROM part")
def q49_association_csv(spark, t):
    rows = t("part").select(
        F.col("p_brand").alias("apk"), F.col("p_name").alias("image"), F.col("p_partkey").alias("wid"), F.lit("w").alias("wid_name"), F.lit("l").alias("layout"), F.lit("m").alias("method"),
        F.array("p_type", "p_brand").alias("permissions"), F.concat(F.lit("h"), _s("p_size")).alias("handler"),
    )
    path = folder(spark, "association")
    K.combined(A.combine(rows.where("wid % 2 = 0"), rows.where("wid % 2 = 1").drop("handler")), path)
    return S.association_csv(spark, path).select(F.col("wid").cast("long").alias("wid"), "image", F.array_join("permissions", "|").alias("permissions"), "handler")


def _widget_file(spark, t) -> DataFrame:
    handlers = F.when(F.col("o_orderstatus") == "F", F.array(F.concat(F.lit("h"), _s("o_custkey")), F.lit("z"))).otherwise(F.array().cast("array<string>"))
    rows = t("orders").select(F.col("o_orderpriority").alias("app"), F.concat(F.lit("i"), _s("o_orderkey")).alias("image"), F.col("o_orderkey").alias("id"), F.lit("n").alias("id_name"), F.lit("l").alias("layout"), handlers.alias("handlers"))
    path = folder(spark, "widgets")
    K.image_widgets(rows, path)
    return spark.read.csv(path, sep="\t", header=True)


@query("SELECT o_orderkey AS wid, '[h' || o_custkey || '|z|]' AS handler FROM orders WHERE o_orderstatus = 'F'")
def q50_image_widget_tsv(spark, t):
    back = _widget_file(spark, t)
    return back.where(A.has_handler(F.col("Handler"))).select(F.col("WID").cast("long").alias("wid"), F.col("Handler").alias("handler"))


@query("SELECT count(DISTINCT o_orderpriority) AS files FROM orders WHERE o_orderstatus = 'F'")
def q51_files_with_handlers(spark, t):
    return A.files_with_handlers(_widget_file(spark, t), "APK", "Handler")


@query("""SELECT n_name AS image, n_nationkey::BIGINT AS id, n_name AS id_name, 'r' || n_regionkey || '.xml' AS layout, CASE WHEN n_nationkey % 2 = 0 THEN '<h' || n_nationkey || '>' ELSE '' END AS handlers FROM nation""")
def q52_gui_model(spark, t):
    n = t("nation")
    name = lambda *parts: F.concat(*(F.lit(p) if p[0] != "n" else _s(p) for p in parts))
    handlers = F.when(F.col("n_nationkey") % 2 == 0, F.array(name("<h", "n_nationkey", ">"))).otherwise(F.array().cast("array<string>"))
    view = F.struct(
        name("INFL[Button,WID[", "n_nationkey", "|", "n_name", "]1,2]3").alias("name"),
        F.array(name("DrawableID[9|drawable_", "n_name", "]1"), F.lit("DrawableID[9|color_x]1")).alias("images"),
        F.array(F.struct(F.lit("click").alias("event"), handlers.alias("handlers"))).alias("handlers"),
    )
    windows = n.groupBy("n_regionkey").agg(F.collect_list(view).alias("views")).select(F.concat(F.lit("ACT[a.B]1[LID[5|layout_r"), _s("n_regionkey"), F.lit("]2]")).alias("name"), "views")
    model = S.gui_model(spark, _whole(windows, F.to_json(F.collect_list(F.struct("name", "views"))), "gui"))
    pairs = A.associate(A.image_widgets(A.view_widgets(model)), A.widget_handlers(model))
    return pairs.select("image", "id", "id_name", "layout", joined("handlers").alias("handlers"))


@query("SELECT n_name AS image, n_nationkey::BIGINT AS id, n_name AS id_name, 'r' || n_regionkey || '.xml' AS layout FROM nation WHERE n_nationkey % 5 <> 0")
def q53_layout_tags(spark, t):
    image = lambda attribute, value: F.struct(F.lit(attribute).alias("attribute"), value.alias("value"))
    tag = F.struct(
        F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("id/"), "n_name")).alias("idName"), F.lit("Button").alias("name"),
        F.array(image("src", F.concat(F.lit("drawable/"), F.col("n_name"))), image("background", F.lit("drawable/bg"))).alias("imgs"),
    )
    files = t("nation").groupBy("n_regionkey").agg(F.collect_list(tag).alias("tags")).select(F.concat(F.lit("r"), _s("n_regionkey"), F.lit(".xml")).alias("name"), "tags")
    return A.tag_widgets(S.layout_tags(spark, _whole(files, F.to_json(F.collect_list(F.struct("name", "tags"))), "tags"))).select("image", "id", "id_name", "layout")


@query("SELECT n_regionkey AS ord, min(n_name) AS head, string_agg(n_name, ',' ORDER BY n_name) AS images FROM nation GROUP BY n_regionkey")
def q54_image_groups(spark, t):
    groups = t("nation").groupBy("n_regionkey").agg(F.min("n_name").alias("name"), F.array_sort(F.collect_list("n_name")).alias("images"))
    path = _whole(groups, F.to_json(_in_order(F.struct("name", "images"), "n_regionkey")), "groups")
    return S.image_groups(spark, path).select("ord", "head", F.array_join("images", ",").alias("images"))


@query("SELECT 'm' || p_partkey AS method, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand || ',' || p_type END AS permissions FROM part")
def q55_ragged_map(spark, t):
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("m"), _s("p_partkey"))).otherwise(F.concat_ws("\t", F.concat(F.lit("m"), _s("p_partkey")), "p_brand", "p_type"))
    return S.ragged_map(spark, _text(t("part").select(line), "map")).select("method", F.array_join("permissions", ",").alias("permissions"))


@query("SELECT 'a' || n_regionkey AS apk, n_name AS image, 'p' || n_nationkey AS permission FROM nation")
def q56_app_permission_tsv(spark, t):
    rows = t("nation").select(F.concat(F.lit("a"), _s("n_regionkey")).alias("apk"), F.col("n_name").alias("image"), F.concat(F.lit("p"), _s("n_nationkey")).alias("permission"))
    path = folder(spark, "permissions")
    K.app_permissions(rows, path)
    return S.permission_tsv(spark, path).select("apk", "image", "permission")


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def q57_stored_rows(spark, t):
    path, lines = folder(spark, "rows"), folder(spark, "lines")
    K.rows(t("part").select("p_partkey", "p_name", "p_retailprice"), path)
    K.json_lines(S.rows(spark, path), lines)
    return S.json_lines(spark, lines, "p_partkey long, p_name string, p_retailprice double")


def _strings(spark, t) -> DataFrame:
    """A string file for each region, its nations by key, the key 'twice' in two values."""
    n = t("nation").withColumn("e", F.concat(F.lit('<string name="n'), _s("n_nationkey"), F.lit('">'), "n_name", F.lit("</string>")))
    files = n.groupBy(F.concat(F.lit("r"), _s("n_regionkey")).alias("app")).agg(F.concat(F.lit('<r><string name="twice">a</string>'), F.array_join(F.collect_list("e"), ""), F.lit('<string name="twice">b</string><g><string name="deep">no</string></g></r>')).alias("value"))
    path = folder(spark, "strings")
    files.write.partitionBy("app").text(path)
    docs = S.xml_documents(spark, path).select(F.regexp_extract("file", "app=([^/]+)", 1).alias("app"), "xml")
    return S.string_resources(docs)


@query("SELECT 'r' || n_regionkey AS app, 'n' || n_nationkey AS name, n_name AS value FROM nation UNION ALL SELECT 'r' || r_regionkey, 'twice', 'b' FROM region")
def q58_string_resources(spark, t):
    return _strings(spark, t).select("app", "name", "value")


@query("""SELECT 'r' || n_regionkey AS app, n_nationkey || '.xml' AS layout, n_name || CASE WHEN n_nationkey % 2 = 0 THEN '|lit' ELSE '' END AS texts, CASE WHEN n_nationkey % 3 = 0 THEN 'ocr' ELSE '' END AS embedded, 'en' || n_regionkey AS language FROM nation""")
def q59_contextual_texts(spark, t):
    n = t("nation").select(F.concat(F.lit("r"), _s("n_regionkey")).alias("app"), F.concat(_s("n_nationkey"), F.lit(".xml")).alias("layout"), "n_name", "n_nationkey")
    seen = F.when(F.col("n_nationkey") % 2 == 0, "visible").otherwise("invisible")
    xml = F.concat(
        F.lit('<L xmlns:a="x"><T a:text="outside"/><G><B a:src="@drawable/pic"/><T a:text="@string/n'), _s("n_nationkey"), F.lit('"/><T a:text="@string/gone"/><T a:text="lit" a:visibility="'), seen, F.lit('"/></G></L>')
    )
    images = n.select("app", "layout", F.lit("pic").alias("image"))
    texts = L.layout_texts(n.select("app", "layout", xml.alias("xml")), _strings(spark, t), images)
    embedded = images.join(n.where("n_nationkey % 3 = 0").select("app", "layout"), ["app", "layout"], "left_semi").withColumn("texts", F.array(F.lit("ocr")))
    rows = L.contextual_texts(texts, embedded, images.withColumn("texts", F.array().cast("array<string>")))
    rows = L.app_language(rows, n.select("app", F.concat(F.lit("en"), F.substring("app", 2, 9)).alias("language")).distinct())
    return rows.select("app", "layout", F.array_join("layout_texts", "|").alias("texts"), F.array_join("embedded_texts", "|").alias("embedded"), "language")


@query("SELECT c_name AS src, n_name AS dst FROM customer JOIN nation ON n_nationkey = c_nationkey")
def q60_dot_graph(spark, t):
    v = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("signature")).union(t("customer").select(F.col("c_custkey") + 1000, "c_name"))
    path = folder(spark, "dot")
    K.dot(v, t("customer").select((F.col("c_custkey") + 1000).alias("src"), F.col("c_nationkey").cast("long").alias("dst")), path)
    nodes, edges = S.dot_graph(spark, path)
    name = lambda key, to: nodes.select(F.col("id").alias(key), F.col("signature").alias(to))
    return edges.select("src", "dst").join(name("src", "a"), "src").join(name("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


@query("SELECT 'r' || n_regionkey AS subclass, replace(n_name, ' ', '_') AS name, (2130706432 + n_nationkey)::BIGINT AS id FROM nation")
def q61_symbols(spark, t):
    k = F.lit(2130706432) + F.col("n_nationkey")
    value = F.when(F.col("n_nationkey") % 2 == 0, F.format_string("0x%08x", k.cast("long"))).otherwise(k.cast("string"))
    lines = t("nation").select(F.concat_ws(" ", F.lit("int"), F.concat(F.lit("r"), _s("n_regionkey")), F.replace("n_name", F.lit(" "), F.lit("_")), value))
    maps = G.symbol_maps(S.r_symbols(spark, _text(lines, "symbols")))
    return maps.select("subclass", F.explode("ids").alias("name", "id"))


@query("SELECT '<' || n_name || ': void f()>' AS signature, CASE WHEN n_nationkey % 2 = 0 THEN 'a.p' || n_nationkey END AS permission, CASE WHEN n_nationkey % 3 = 0 THEN 'SOURCE' ELSE 'SINK' END AS kind FROM nation WHERE n_regionkey < 4")
def q62_source_sink_spec(spark, t):
    head = F.when(F.col("n_regionkey") < 4, "").otherwise("%")
    permission = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" a.p"), _s("n_nationkey"))).otherwise("")
    kind = F.when(F.col("n_nationkey") % 3 == 0, " -> _SOURCE_").otherwise(" -> _SINK_")
    return S.source_sink_spec(spark, _text(t("nation").select(F.concat(head, F.lit("<"), "n_name", F.lit(": void f()>"), permission, kind)), "spec"))


@query("SELECT ['include', 'exclude', 'kill', 'method'][n_nationkey % 5 + 1] AS op, n_name AS value FROM nation WHERE n_nationkey % 5 < 4")
def q63_taint_wrapper_spec(spark, t):
    mark = F.element_at(F.array(*map(F.lit, ("^", "~", "-", "", "#"))), F.col("n_nationkey") % 5 + 1)
    return S.taint_wrapper_spec(spark, _text(t("nation").select(F.concat(mark, "n_name")), "taint"))


@query("SELECT n_name AS simple, 'android.' || n_name AS fqcn FROM nation WHERE n_regionkey <> 2")
def q64_widget_map(spark, t):
    extra = F.when(F.col("n_regionkey") == 2, ",more").otherwise("")
    return S.widget_map(spark, _text(t("nation").select(F.concat("n_name", F.lit(" , android."), "n_name", extra)), "widgets"))


@query("SELECT c_name AS app FROM customer")
def q65_line_list(spark, t):
    line = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).otherwise(F.concat("c_name", F.lit("\r")))
    return S.line_list(spark, _text(t("customer").select(line), "list")).select("app")


@query("SELECT r_name AS app FROM region WHERE r_regionkey % 2 = 0")
def q66_listing(spark, t):
    path = folder(spark, "models")
    for r in t("region").collect():  # five names of files
        _put(spark, f"{path}/{r.r_name}{'.apk.json' if r.r_regionkey % 2 == 0 else '.txt'}", b"[]")
    return S.listing(spark, path)


@query("SELECT 'app' || r_regionkey AS app, lower(r_name) AS name, 'drawable-hdpi' AS folder FROM region")
def q67_drawable_paths(spark, t):
    path = folder(spark, "apps")
    for r in t("region").collect():  # five names of files
        for place, kind in (("drawable-xhdpi", "xml"), ("drawable-hdpi", "9.png"), ("layout", "xml")):
            _put(spark, f"{path}/app{r.r_regionkey}/res/{place}/{r.r_name.lower().replace(' ', '_')}.{kind}", b"x")
    first = S.first_path(S.drawable_catalogue(spark, path), "drawable")
    return first.select("app", F.translate("name", "_", " ").alias("name"), F.regexp_extract("file", "res/([^/]+)/", 1).alias("folder"))


@query("SELECT n_name AS key, 'dir' || n_nationkey AS path, '/base' AS base, CASE WHEN n_nationkey % 2 = 0 THEN 'own' ELSE 'common more' END AS param FROM nation")
def q68_project_config(spark, t):
    own = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("relative-path"), F.concat(F.lit("dir"), _s("n_nationkey")), F.lit("override"), F.lit("own"))).otherwise(
        F.create_map(F.lit("relative-path"), F.concat(F.lit("dir"), _s("n_nationkey")), F.lit("append"), F.lit("more"))
    )
    entry = F.concat(F.to_json(F.struct("n_name")), F.to_json(own))  # {"n_name":"x"}{...}
    pair = F.regexp_replace(entry, r'^\{"n_name":("[^"]*")\}', "$1:")
    path = _whole(t("nation"), F.concat(F.lit('{"BASE_DIR":"/base","BASE_PARAM":"common",'), F.array_join(F.collect_list(pair), ","), F.lit("}")), "config")
    some = lambda k: F.coalesce(F.try_element_at("settings", F.lit(k)), F.lit(""))
    return S.project_config(spark, path).select("key", F.element_at("settings", "relative-path").alias("path"), F.element_at("base", "BASE_DIR").alias("base"), P.with_defaults(F.element_at("base", "BASE_PARAM"), some("override"), some("append")).alias("param"))


@query("SELECT CASE event_type WHEN 'signup' THEN 'BEGIN' WHEN 'click' THEN 'REP' WHEN 'purchase' THEN 'MEM' ELSE 'OTHER' END AS tag, count(*) AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY ALL")
def q69_device_log(spark, t):
    user = _s("user_id")
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("--- BEGIN "), user)).when(F.col("event_type") == "click", F.concat(F.lit("REP: "), user)).when(F.col("event_type") == "purchase", F.concat(F.lit(" allocated:  "), user)).otherwise(user)
    log = S.device_log(spark, _text(t("events").select(line), "log"))
    return log.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("value").alias("users"))


@query("SELECT '<a.' || n_name || ': void f()>' AS method, 'VIEW' || n_regionkey AS actions, 'u' || n_nationkey AS uris, 'Z,Y' AS classes FROM nation")
def q70_component_messages(spark, t):
    point = F.concat(
        F.lit('exit_points { statement: "invoke <a.'), F.col("n_name"), F.lit(': void f()>" intents { action: "VIEW'), _s("n_regionkey"), F.lit('" class: "Z" class: "Y" } uri: "u'), _s("n_nationkey"), F.lit('" }')
    )
    path = _whole(t("nation"), F.concat(F.lit('components { name: "C" '), F.array_join(F.collect_list(point), " "), F.lit(" }")), "messages")
    return G.method_intents(S.component_messages(spark, path)).select("method", *(F.array_join(c, ",").alias(c) for c in ("actions", "uris", "classes")))


@query("SELECT 'V' || n_regionkey AS gui_type, 'click' AS event, 'set' || n_nationkey AS registration, 0 AS position, 'on' || n_nationkey AS handler, 1 AS handler_position FROM nation")
def q71_listener_spec(spark, t):
    reg = F.concat(F.lit('<registration subsig="set'), _s("n_nationkey"), F.lit('" position="0"><handler subsig="on'), _s("n_nationkey"), F.lit('" position="1"/></registration>'))
    gui = t("nation").groupBy("n_regionkey").agg(F.concat(F.lit('<gui type="V'), _s("n_regionkey"), F.lit('"><event name="click">'), F.array_join(F.collect_list(reg), ""), F.lit("</event></gui>")).alias("g"))
    return S.listener_spec(spark, _whole(gui, F.concat(F.lit("<S>"), F.array_join(F.collect_list("g"), ""), F.lit("</S>")), "listeners"))


@query("SELECT 'role' || n_regionkey AS role, 'c' AS class, 's' || n_nationkey AS subsig, n_nationkey % 3 AS args FROM nation")
def q72_role_spec(spark, t):
    args = F.repeat(F.lit('<arg pos="1"/>'), F.col("n_nationkey") % 3)
    inv = F.concat(F.lit('<invocation subsig="s'), _s("n_nationkey"), F.lit('">'), args, F.lit("</invocation>"))
    role = t("nation").groupBy("n_regionkey").agg(F.concat(F.lit('<role type="role'), _s("n_regionkey"), F.lit('"><class type="c">'), F.array_join(F.collect_list(inv), ""), F.lit("</class></role>")).alias("g"))
    got = S.role_spec(spark, _whole(role, F.concat(F.lit("<S>"), F.array_join(F.collect_list("g"), ""), F.lit("</S>")), "roles"))
    return got.select("role", "class", "subsig", F.size("args").alias("args"))


@query("SELECT c_custkey AS app FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P')")
def q73_status_log(spark, t):
    path = folder(spark, "status")
    done = t("orders").select(F.col("o_custkey").alias("app"), F.when(F.col("o_orderstatus") == "P", "TIMEOUT").otherwise("DONE").alias("status"))
    K.status(done.where("status = 'DONE'"), path)
    K.status(done.where("status = 'TIMEOUT'"), path)
    return A.unhandled(t("customer").select(F.col("c_custkey").alias("app")), S.rows(spark, path), ("TIMEOUT",))


@query("SELECT count(*) AS n FROM lineitem")
def q74_progress(spark, t):
    rows, seen = K.progress(t("lineitem").select("l_orderkey"), "lines")
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "n long")


_VIEWS = """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a.TextView' WHEN 1 THEN 'a.EditText' ELSE 'a.Image' END AS class, p_name AS text, p_partkey % 7 AS w FROM part"""


def _views(t) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("a.TextView", "a.EditText", "a.Image"))), F.col("p_size") % 3 + 1)
    v = t("part").select("p_partkey", kind.alias("class"), F.col("p_name").alias("text"), (F.col("p_partkey") % 7).alias("right"))
    return v.withColumns({c: F.lit(0).cast("long") for c in ("left", "top", "pad_left", "pad_right", "pad_top", "pad_bottom")}).withColumn("bottom", F.lit(5).cast("long"))


@query(f"""SELECT p_partkey, CASE WHEN w > 0 AND class = 'a.TextView' THEN 'annotation' WHEN w > 0 AND class = 'a.EditText' THEN 'edit' END AS kind FROM ({_VIEWS})""")
def q75_view_kinds(spark, t):
    return L.view_kinds(_views(t)).select("p_partkey", "kind")


@query(f"""SELECT class || ' [0,0,' || w || ',5] ' || text AS value FROM ({_VIEWS}) WHERE w > 0 AND class = 'a.EditText' AND (contains(lower(text), 'a') OR contains(lower(text), 'part'))""")
def q76_sensitive_view_dump(spark, t):
    path = folder(spark, "views")
    K.view_dump(L.sensitive_fields(L.view_kinds(_views(t)), ["a", "part"]), path)
    return spark.read.text(path)


@query("SELECT l_partkey AS method, min(s_name) AS permission FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey")
def q77_permission_lookup(spark, t):
    path = folder(spark, "lookup")
    s = t("supplier").select("s_suppkey", F.col("s_name").alias("permission"))
    K.rows(t("lineitem").select(F.col("l_partkey").alias("method"), F.col("l_suppkey").alias("s_suppkey")).distinct().join(s, "s_suppkey").select("method", "permission"), path)
    return A.first_permission(S.permission_lookup(spark, path))


@query("SELECT r_name AS image, 'p' || r_regionkey || '|q' AS permissions FROM region")
def q78_zipped_csv(spark, t):
    body = "APK,Image,WID,WID Name,Layout,Handler,Method,Permissions\n" + "".join(f'a,{r.r_name},1,w,l,h,m,"[p{r.r_regionkey}, q]"\n' for r in t("region").collect())  # five rows
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("all.csv", body)
        z.writestr("readme", "no")
    path = folder(spark, "zip")
    _put(spark, f"{path}/all.zip", out.getvalue())
    return S.zipped_csv(spark, f"{path}/all.zip").select("image", F.array_join("permissions", "|").alias("permissions"))


@query("SELECT 'com.' || replace(r_name, ' ', '') AS class FROM region WHERE r_regionkey > 0")
def q79_archive_classes(spark, t):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for r in t("region").collect():  # five rows
            z.writestr(f"{'com' if r.r_regionkey else 'org'}/{r.r_name.replace(' ', '')}.class", b"")
            z.writestr(f"com/{r.r_name}.txt", b"")
    path = folder(spark, "jar")
    _put(spark, f"{path}/all.jar", out.getvalue())
    return S.archive_classes(spark, f"{path}/all.jar", "com.")


@query("SELECT label, metric, round(value, 6) AS value FROM (SELECT 'q' || quality AS label, 'n' AS metric, count(*)::DOUBLE AS value FROM labels GROUP BY quality UNION ALL SELECT 'q' || quality, 'toxic', avg(toxic) FROM labels GROUP BY quality)")
def q80_metric_report(spark, t):
    g = t("labels").groupBy(F.concat(F.lit("q"), _s("quality")).alias("label")).agg(F.count("*").cast("double").alias("n"), F.avg("toxic").alias("toxic"))
    rows = g.select(F.lit("label").alias("level"), "label", F.explode(F.create_map(F.lit("n"), "n", F.lit("toxic"), "toxic")).alias("metric", "value"), F.lit(None).cast("int").alias("k"))
    path = folder(spark, "report")
    K.metric_report(rows, path)
    return spark.read.parquet(f"{path}/rows").select("label", "metric", F.round("value", 6).alias("value"))


@query("SELECT '    public static final int ' || replace(n_name, ' ', '_') || ' = 0x' || printf('%08x', n_nationkey) || ';' AS value FROM nation UNION ALL SELECT '  public static final class r' || r_regionkey || ' {' FROM region UNION ALL SELECT '  }' FROM region UNION ALL SELECT unnest(['package a.b;', 'public final class R {', '}'])")
def q81_symbol_source(spark, t):
    s = t("nation").select(F.concat(F.lit("r"), _s("n_regionkey")).alias("subclass"), F.replace("n_name", F.lit(" "), F.lit("_")).alias("name"), F.col("n_nationkey").alias("id"))
    path = folder(spark, "source")
    K.symbol_source(s, "a.b", path)
    return spark.read.text(path)


@query("SELECT 'r' || n_regionkey AS app, arg_min(n_name, (-n_nationkey, n_name)) AS package FROM nation WHERE n_name <> 'CHINA' GROUP BY n_regionkey")
def q82_main_package(spark, t):
    rows = t("nation").select(F.concat(F.lit("r"), _s("n_regionkey")).alias("app"), F.col("n_name").alias("package"), F.col("n_nationkey").alias("specs"))
    return S.main_package(rows, ("CHINA",))
