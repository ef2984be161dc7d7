"""Operators on hand-made rows, with expected values worked out by hand or by brute force."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkglyph.functions import parsing as P
from sparkglyph.functions import text as X
from sparkglyph.functions import vectors as V
from sparkglyph.operators import aggregates as G
from sparkglyph.operators import association as A
from sparkglyph.operators import features as E
from sparkglyph.operators import graph as R
from sparkglyph.operators import layout as L
from sparkglyph.operators import learning as N
from sparkglyph.operators import metrics as M
from sparkglyph.operators import outlier as O
from sparkglyph.plans import association as plan
from sparkglyph.sources import readers as S
from sparkglyph.sources import sinks as K


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "name, words",
    [("hello", ["hello"]), ("ABC", ["ABC"]), ("aRGB", ["a", "RGB"]), ("tempR", ["temp", "R"]), ("idTextView", ["id", "Text", "View"]), ("ScalingStability_TestRoot", ["Scaling", "Stability", "Test", "Root"]), ("btn_GoBack", ["btn", "Go", "Back"])],
)
def test_name_words(spark, name, words):
    assert one(spark, X.name_words, name) == words


@pytest.mark.parametrize("cell, items", [("[p1]", ["p1"]), ("[p1, p2]", ["p1", "p2"]), ("['p1', 'p2', 'p1']", ["p1", "p2"]), ("[]", [""])])
def test_decode_list(spark, cell, items):
    assert one(spark, P.decode_list, cell) == items


@pytest.mark.parametrize("text, lang", [("123 !", None), ("hello", "english"), ("猫かな", "chinese"), ("かな", "japanese"), ("한국어", "korean"), (None, None)])
def test_language(spark, text, lang):
    assert one(spark, X.language, text) == lang


def test_parsers(spark):
    assert tuple(one(spark, P.widget_id, "INFL[android.widget.Button,WID[7|ok]1,2]3")) == (7, "ok")
    assert one(spark, P.widget_id, "INFL[a.B,*,2]3") is None
    assert one(spark, P.layout_name, "ACT[x]1[LID[5|layout_main]2]") == "main.xml"
    assert one(spark, P.layout_name, "ACT[x]1") == "gator"
    assert one(spark, P.drawable_name, "DrawableID[9|drawable_up]1") == "up"
    assert one(spark, P.drawable_name, "DrawableID[9|color_up]1") is None
    assert one(spark, P.class_of, "<a.B: void f()>") == "a.B"
    assert one(spark, P.decode_int, "0x7f010001") == 0x7F010001
    assert one(spark, P.api_level, "google-19") == 19 and one(spark, P.api_level, "x") == -1
    assert one(spark, P.signatures, "[<a: b>|<c: d>|]") == ["a: b", "c: d"]
    assert P.text_message("f", 'a { b: "x" c { d: 3 } } e: TRUE') == [("f", 0, "a.b", "0/1", "x"), ("f", 1, "a.c.d", "0/1/2", "3"), ("f", 2, "e", "0", "TRUE")]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("conditional", "condit"), ("electrical", "electr"), ("adjustment", "adjust"), ("probate", "probat"), ("controlling", "control"), ("is", "is")])
def test_porter(word, stem):
    assert X.porter(word) == stem


def test_tokens(spark):
    row = spark.createDataFrame([(["The cannot-do 2 the Übung a"],)], "t array<string>").select(E.text_tokens(F.col("t"), ["the"]).alias("y")).first()
    assert row.y == ["the", "can", "not", "do", "übung"]  # the capitalised stop word stays


def test_spelling(spark):
    tokens = spark.createDataFrame([("helo",), ("cat",), ("zzzzzz",)], "token string")
    vocab = spark.createDataFrame([("hello", 9), ("help", 3), ("cat", 1)], "word string, freq long")
    assert {r.token: r.corrected for r in X.correct_spelling(tokens, vocab).collect()} == {"helo": "hello", "cat": "cat", "zzzzzz": "zzzzzz"}


@pytest.fixture(scope="module")
def app(tmp_path_factory):
    d = tmp_path_factory.mktemp("app")
    for n in ("gui", "tags", "groups"):
        (d / n).mkdir()
    h1, h2 = "<a.B$1: void onClick(android.view.View)>", "<a.B$2: void onClick(android.view.View,int)>"
    view = lambda name, images, *handlers: {"name": name, "images": images, "handlers": [{"event": "click", "handlers": list(handlers)}]}
    gui = [{"name": "ACT[a.B]1[LID[5|layout_main]2]", "views": [view("INFL[Button,WID[1|ok]1,2]3", ["DrawableID[8|drawable_up]1", "DrawableID[9|color_x]1"], h1, h2), view("INFL[Button,*,2]3", ["DrawableID[8|drawable_no]1"])]}, {"name": "ACT[a.C]2", "views": [view("INFL[Button,WID[2|go]1,2]3", ["DrawableID[8|drawable_down]1"])]}]
    tags = [{"name": "main.xml", "tags": [{"id": 1, "idName": "id/ok", "name": "Button", "imgs": [{"attribute": "src", "value": "drawable/left"}, {"attribute": "background", "value": "drawable/bg"}]}, {"id": 0, "idName": None, "name": "X", "imgs": [{"attribute": "src", "value": "drawable/none"}]}]}]
    groups = [{"name": "left", "images": ["right", "down"]}]
    (d / "gui/Demo.apk.json").write_text(json.dumps(gui))
    (d / "tags/Demo.json").write_text(json.dumps(tags))
    (d / "groups/Demo.image.json").write_text(json.dumps(groups))
    return d, h1, h2


def test_association(spark, app, tmp_path):
    d, h1, h2 = app
    got = plan.image_widgets(spark, str(d / "gui/Demo.apk.json"), str(d / "tags/Demo.json"), str(d / "groups/Demo.image.json"))
    rows = {(r.app, r.image, r.id, r.id_name, r.layout, tuple(r.handlers)) for r in got.collect()}
    ok = ("Demo", 1, "ok", "main.xml", tuple(sorted([h1, h2])))
    # `down` has its own widget, but takes over that of its group's head
    assert rows == {(ok[0], image, *ok[1:]) for image in ("up", "left", "right", "down")}
    K.image_widgets(got, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True)
    assert {r.Handler for r in back.collect()} == {f"[{'|'.join(sorted([h1, h2]))}|]"}
    edges = spark.createDataFrame([(h1, "<m: a()>"), ("<m: a()>", "<m: b()>"), ("<m: b()>", "<m: a()>")], "src string, dst string")
    methods = spark.createDataFrame([(m,) for m in (h1, h2, "<m: a()>", "<m: b()>")], "method string")
    lookup = spark.createDataFrame([("<m: b()>", "android.permission.CAMERA"), ("<m: z()>", "X")], "method string, permission string")
    perms = plan.permissions(got, edges, methods, lookup)
    assert {(r.handler, r.method, tuple(r.permissions)) for r in perms.collect()} == {(h1, "<m: b()>", ("android.permission.CAMERA",))}
    K.combined(perms, str(tmp_path / "csv"))
    assert {tuple(r.permissions) for r in S.association_csv(spark, str(tmp_path / "csv")).collect()} == {("android.permission.CAMERA",)}


def test_missing_model(spark, tmp_path):
    assert S.gui_model(spark, str(tmp_path / "none.json")).count() == 0


def test_propagation_order(spark):
    pairs = spark.createDataFrame([("x", i, n, "", "") for n, i in enumerate("abcd")], "app string, image string, id long, id_name string, layout string")
    groups = spark.createDataFrame([("x", 0, "a", ["b"]), ("x", 1, "b", ["c"]), ("x", 2, "nohead", ["d"])], "app string, ord int, head string, images array<string>")
    got = {(r.image, r.id) for r in A.propagate(pairs, groups).collect()}
    assert got == {("a", 0), ("b", 0), ("c", 0), ("d", 3)}  # a later group sees the earlier overwrite


def test_groups(spark):
    rows = spark.createDataFrame([(1, ["android.permission.CAMERA", "CAMERA", "VIBRATE"]), (2, ["VIBRATE"]), (3, [""])], "i int, permissions array<string>")
    assert [tuple(r) for r in A.sensitive(rows).collect()] == [(1, ["CAMERA"])]
    assert A.group_table(spark).count() == 19


def test_readers(spark, tmp_path):
    (tmp_path / "map.tsv").write_text("m\tp1\tp2\nn\nm\tp3\n")
    assert {r.method: r.permissions for r in S.ragged_map(spark, str(tmp_path / "map.tsv")).collect()} == {"m": ["p3"], "n": []}
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", "APK,Image,WID,WID Name,Layout,Handler,Method,Permissions\na,i,1,w,l,h,m,\"[p, q]\"\n")
        z.writestr("other.csv", "no")
    assert S.zipped_csv(spark, str(tmp_path / "t.zip")).first().permissions == ["p", "q"]
    with zipfile.ZipFile(tmp_path / "c.jar", "w") as z:
        z.writestr("a/B.class", b"")
        z.writestr("a/B.txt", b"")
    assert [r["class"] for r in S.archive_classes(spark, str(tmp_path / "c.jar")).collect()] == ["a.B"]
    (tmp_path / "R.txt").write_text("int id ok 0x7f01\nint[] styleable S { 0x1, 0x2 }\n")
    assert {(r.name, r.id) for r in S.r_symbols(spark, str(tmp_path / "R.txt")).collect()} == {("ok", 0x7F01), ("S", 1)}
    (tmp_path / "s.txt").write_text("% c\n<a: b()> android.permission.X -> _SOURCE_\n<c: d()> -> _SINK_\n%<e: f()> -> _SINK_\n")
    assert {(r.signature, r.permission, r.kind) for r in S.source_sink_spec(spark, str(tmp_path / "s.txt")).collect()} == {("<a: b()>", "android.permission.X", "SOURCE"), ("<c: d()>", None, "SINK")}
    (tmp_path / "w").write_text("A,a.A\nA,b.A\nbad\n")
    assert [tuple(r) for r in S.widget_map(spark, str(tmp_path / "w")).collect()] == [("A", "a.A")]
    (tmp_path / "roles.xml").write_text('<S><role type="r"><class type="c"><invocation subsig="s"><arg pos="1"/></invocation><invocation subsig="t"/></class></role></S>')
    assert {(r.role, r["class"], r.subsig, len(r.args)) for r in S.role_spec(spark, str(tmp_path / "roles.xml")).collect()} == {("r", "c", "s", 1), ("r", "c", "t", 0)}
    (tmp_path / "listeners.xml").write_text('<S><gui type="V"><event name="click"><registration subsig="set()" position="0"><handler subsig="on()" position="1"/></registration></event></gui></S>')
    assert [tuple(r) for r in S.listener_spec(spark, str(tmp_path / "listeners.xml")).collect()] == [("V", "click", "set()", 0, "on()", 1)]
    (tmp_path / "conf.json").write_text(json.dumps({"BASE_DIR": "/b", "p": {"relative-path": "r"}}))
    row = S.project_config(spark, str(tmp_path / "conf.json")).first()
    assert row.key == "p" and row.settings == {"relative-path": "r"} and row.base == {"BASE_DIR": "/b"}
    K.dot(spark.createDataFrame([(1, "a"), (2, "b")], "id long, signature string"), spark.createDataFrame([(1, 2)], "src long, dst long"), str(tmp_path / "g"))
    v, e = S.dot_graph(spark, str(tmp_path / "g"))
    assert v.count() == 2 and [(r.src, r.dst) for r in e.collect()] == [(1, 2)]


def test_reach_cycles(spark):
    rng = np.random.default_rng(0)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 12, (18, 2))}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    got = {(r.start, r.node, r.depth) for r in R.reach(edges, spark.createDataFrame([(0,), (5,), (99,)], "start long")).collect()}
    want = set()
    for s in (0, 5, 99):
        seen, level, depth = {s}, {s}, 0
        while level:
            depth += 1
            level = {b for a, b in pairs if a in level} - seen
            seen |= level
            want |= {(s, n, depth) for n in level}
    assert got == want


def test_implicit_edges(spark):
    edges = spark.createDataFrame([("m1", "<H: boolean sendMessage(M)>"), ("m2", "<a.T: void start()>"), ("m3", "<A: void startActivity(I)>")], "src string, dst string")
    methods = spark.createDataFrame([("<K: void handleMessage(M)>",), ("<a.T: void run()>",), ("<a.N: void onCreate(android.os.Bundle)>",)], "method string")
    targets = spark.createDataFrame([("m3", 0, "a.N"), ("m3", 1, "a.Z")], "method string, ord int, class string")
    g = R.augment(edges, methods, targets)
    got = {(r.start, r.node) for r in R.reach(g, spark.createDataFrame([("m1",), ("m2",), ("m3",)], "start string")).collect()}
    assert {("m1", "<K: void handleMessage(M)>"), ("m2", "<a.T: void run()>"), ("m3", "<a.N: void onCreate(android.os.Bundle)>")} <= got


def test_drawables_and_dependence(spark):
    refs = spark.createDataFrame([("x", "a", "b"), ("x", "b", "a"), ("x", "b", "c")], "app string, name string, target string")
    files = spark.createDataFrame([("x", "c", "c.png")], "app string, name string, image string")
    got = {(r.name, r.image, tuple(r.trace)) for r in R.resolve_drawables(refs, files).collect()}
    assert got == {("a", "c.png", ("a", "b", "c")), ("b", "c.png", ("b", "c")), ("c", "c.png", ("c",))}
    flow = spark.createDataFrame([("m", 1, 2), ("m", 1, 3), ("m", 2, 4), ("m", 3, 4)], "method string, src long, dst long")
    assert {(r.branch, r.node) for r in R.control_dependence(flow).collect()} == {(1, 2), (1, 3)}


def test_layout_texts(spark):
    ns = 'xmlns:android="http://schemas.android.com/apk/res/android"'
    xml = f'<L {ns}><T android:text="@string/a"/><G><B android:src="@drawable/pic" android:visibility="invisible" android:text="no"><T android:text="lit"/></B><T android:text="@string/gone"/><T android:visibility="gone" android:text=""/></G></L>'
    layouts = spark.createDataFrame([("x", "l.xml", xml), ("x", "bad.xml", "<L><")], "app string, layout string, xml string")
    strings = S.string_resources(spark.createDataFrame([("x", '<r><string name="a">A <b>x</b></string><string name="a">B</string><g><string name="q">no</string></g></r>')], "app string, xml string"))
    assert [tuple(r) for r in strings.collect()] == [("x", "a", "B")]
    images = spark.createDataFrame([("x", "l.xml", "pic"), ("x", "l.xml", "none"), ("x", "bad.xml", "pic")], "app string, layout string, image string")
    got = {(r.layout, r.image): r.texts for r in L.layout_texts(layouts, strings, images).collect()}
    assert got == {("l.xml", "pic"): ["lit", ""], ("l.xml", "none"): ["B", "lit", ""], ("bad.xml", "pic"): []}


def test_metrics_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(0, 6)), int(rng.integers(0, 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, s double, y int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert M.auc(df, "s", "y").first().auc == pytest.approx(auc)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    want = {k: sum(y for *_, y in order[:k]) / k for k in range(1, 60)}
    assert {r.k: r.precision for r in M.curve(df, "s", "i", "y").collect()} == pytest.approx(want)
    assert M.curve(df.withColumn("y", F.lit(1)), "s", "i", "y").count() == 0
    zero = spark.createDataFrame([([1], [2])], "a array<int>, b array<int>")
    assert M.example_scores(zero, "a", "b").first().f1 == 0.0


def test_neighbours_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 4, (40, 3)).astype(float)
    rows = [(i, i % 2, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, grp int, vector array<double>")
    got = {(r.id, r.rank): (r.tid, round(r.distance, 9)) for r in O.neighbours(df, df.withColumnRenamed("id", "tid"), 3).collect()}
    for i, g, x in rows:
        seen = {}
        for j, h, y in rows:
            if h == g:
                seen.setdefault(tuple(y), j)
        best = sorted((round(float(np.linalg.norm(np.subtract(x, y))), 9), j) for y, j in seen.items())[:3]
        assert [got[i, k + 1] for k in range(len(best))] == [(j, d) for d, j in best]
    assert O.neighbourhood_weight(O.neighbours(df, df.withColumnRenamed("id", "tid"), 1)).first().weight == 1e6  # distance 0


def test_boxes(spark):
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 10.0, 0.9), ("a", 1.0, 1.0, 11.0, 11.0, 0.8), ("a", 50.0, 50.0, 60.0, 60.0, 0.7), ("b", 0.0, 0.0, 10.0, 10.0, 0.1)], "img string, x0 double, y0 double, x1 double, y1 double, score double")
    assert {(r.img, r.score) for r in V.suppress(boxes, "img").collect()} == {("a", 0.9), ("a", 0.7), ("b", 0.1)}


def test_features(spark):
    rows = spark.createDataFrame([(2, ["b", "a", "a"]), (1, ["a", "c"]), (3, [])], "k long, t array<string>")
    vocab = E.vocabulary(rows, "k", "t", 0)
    assert {r.token: r.id for r in vocab.collect()} == {"a": 2, "c": 3, "b": 4}
    assert {r.token for r in E.vocabulary(rows, "k", "t", 1).collect()} == {"a"}  # strictly more often
    small = vocab.where("token != 'c'")
    assert {r.k: r.ids for r in E.index_tokens(rows, "k", "t", small).collect()} == {1: [2, 1], 2: [4, 2, 2], 3: []}
    n = {r.part: r["count"] for r in E.split_exact(spark.range(101), "id", {"train": 7, "valid": 1, "test": 2}).groupBy("part").count().collect()}
    assert n == {"train": 70, "valid": 10, "test": 21}


def test_preprocess_and_learn(spark):
    raw = [(i, ("RGB", 32, 32, bytes(16)), ["the camera shot" if i % 2 else "send text"], [], ["btn_takePhoto" if i % 2 else "btn_sendSms"], ["android.permission.CAMERA" if i % 2 else "android.permission.SEND_SMS"]) for i in range(20)]
    raw += [(90, ("RGB", 2, 2, b""), ["x"], [], [], ["CAMERA"]), (91, None, ["x"], [], [], ["CAMERA"]), (92, ("RGB", 32, 32, b""), ["x"], [], [], ["VIBRATE"])]
    df = spark.createDataFrame(raw, "key long, img struct<mode:string,w:int,h:int,data:binary>, layout_texts array<string>, embedded_texts array<string>, resource_texts array<string>, permissions array<string>")
    rows, vocab = E.preprocess(df, "key", ["the"], 1, 8)
    got = rows.collect()
    assert sorted(r.key for r in got) == list(range(20)) and all(len(r.tokens) == 8 for r in got)
    feats = rows.withColumn("vector", N.image_features(F.col("img"), dim=4))
    camera = list(A.GROUPS).index("CAMERA")
    models = N.train_labels(feats, [camera], N.TrainConf(buckets=64))
    probs = {r.key: r.probs[0] for r in N.predict_labels(feats, models, N.TrainConf(buckets=64)).collect()}
    assert all((p > 0.5) == (k % 2 == 1) for k, p in probs.items())


def test_choices(spark):
    rows = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "b", 3), ("g", "a", 4), ("h", None, 5)], "k string, v string, o int")
    assert {r.k: r.v for r in G.mode_first(rows, ["k"], "v", "o", "english").collect()} == {"g": "b", "h": "english"}
    assert G.argmax(spark.createDataFrame([("g", "x", 2, 1), ("g", "y", 2, 0)], "k string, v string, n int, t int"), ["k"], "v", "n", "t").first().v == "y"
    known = spark.createDataFrame([("id", "a", 7)], "type string, name string, id long")
    want = spark.createDataFrame([("id", "b"), ("id", "a"), ("id", "c"), ("str", "z")], "type string, name string")
    assert {(r.type, r.name): r.id for r in G.resource_ids(want, known).collect()} == {("id", "a"): 7, ("id", "b"): 2, ("id", "c"): 3, ("str", "z"): 1}


def test_registry(spark):
    @N.client("limit")
    def limit(df, n="1"):
        return df.limit(int(n))

    assert N.run_client("limit", spark.range(9), ["n=3"]).count() == 3


def test_orchestration(spark):
    from sparkglyph.operators import orchestration as C

    files = spark.createDataFrame([("a", "x/.project"), ("a", "x/build.gradle"), ("b", "B.APK"), ("c", "readme")], "project string, file string")
    assert {r.project: r.kind for r in C.project_kind(files).collect()} == {"a": "studio", "b": "apk", "c": "unknown"}
    codes = spark.createDataFrame([(0,), (-1,), (7,)], "c int").select(C.status_name(F.col("c")).alias("s"))
    assert [r.s for r in codes.collect()] == ["DONE", "TIMEOUT", "ERROR"]
    got = C.retry(spark.range(6), [{"m": 2}, {"m": 3}], lambda d, s: d.where(F.col("id") % s["m"] == 0).withColumn("m", F.lit(s["m"])), "id")
    assert {(r.id, r.m) for r in got.collect()} == {(0, 2), (2, 2), (4, 2), (3, 3)}


def test_intents_and_boxes(spark):
    body = 'components { name: "C" exit_points { statement: "invoke <a.B: void f()>" intents { action: "VIEW" class: "Z" class: "Y" } uri: "u" } }'
    rows = spark.createDataFrame(P.text_message("f", body), "file string, ord long, path string, node string, value string")
    assert [tuple(r) for r in G.method_intents(rows).collect()] == [("<a.B: void f()>", ["VIEW"], ["u"], ["Z", "Y"])]
    boxes = spark.createDataFrame([([(5, 9), (1, 2), (0, 9)],)], "b array<struct<x0:int,y0:int>>").select(V.top_down(F.col("b")).alias("b")).first().b
    assert [tuple(b) for b in boxes] == [(1, 2), (0, 9), (5, 9)]


def test_apps_do_not_cross(spark):
    go = lambda a: f"<{a}.H: void go()>"
    pairs = spark.createDataFrame([(a, "i", 1, "w", "l", [go(a)]) for a in "ab"], "app string, image string, id long, id_name string, layout string, handlers array<string>")
    edges = spark.createDataFrame([("a", go("a"), "<v: void setOnClickListener(l)>"), ("b", go("b"), "<t.T: void start()>"), ("a", "<s.S: void x()>", "<c: CAMERA()>"), ("b", "<s.S: void x()>", "<c: SMS()>"), ("a", "<a.H2: void y()>", "<t.T: void start()>")], "app string, src string, dst string")
    methods = spark.createDataFrame([("b", "<b.L: void onClick(v)>"), ("a", "<t.T: void run()>"), ("a", "<a.L: void onClick(v)>")], "app string, method string")
    lookup = spark.createDataFrame([("<b.L: void onClick(v)>", "SEND_SMS"), ("<a.L: void onClick(v)>", "CAMERA"), ("<t.T: void run()>", "INTERNET")], "method string, permission string")
    got = {(r.apk, r.method) for r in plan.permissions(pairs, edges, methods, lookup).collect()}
    assert got == {("a", "<a.L: void onClick(v)>")}  # app b has no run() of its own, app a no listener of b's
    same = spark.createDataFrame([("a", "s", "x"), ("b", "s", "y"), ("b", "x", "z")], "app string, src string, dst string")
    starts = spark.createDataFrame([("a", "s"), ("b", "s")], "app string, start string")
    assert {(r.app, r.node) for r in R.reach(same, starts).collect()} == {("a", "x"), ("b", "y")}
    targets = spark.createDataFrame([("a", "m", 0, "C"), ("b", "m", 0, "D")], "app string, method string, ord int, class string")
    calls = spark.createDataFrame([("a", "m", "<x: void startActivity(I)>")], "app string, src string, dst string")
    known = spark.createDataFrame([(a, f"<{c}: void onCreate(android.os.Bundle)>") for a in "ab" for c in "CD"], "app string, method string")
    assert [tuple(r) for r in R.component_edges(calls, known, targets).collect()] == [("a", "m", "<C: void onCreate(android.os.Bundle)>")]


def test_no_depth_is_too_deep(spark):
    n = 130
    rows = [("t", str(i), str(i - 1) if i else None, 1, 2) for i in range(n)] + [("t", "p", "q", 1, 1), ("t", "q", "p", 1, 1), ("t", "lost", "nowhere", 1, 1)]
    nodes = spark.createDataFrame(rows, "tree string, node string, parent string, left long, top long")
    got = {r.node: (r.x, r.y, r.depth) for r in R.absolute_positions(nodes).collect()}
    assert got == {str(i): (i + 1, 2 * (i + 1), i) for i in range(n)}
    refs = spark.createDataFrame([("x", f"d{i:02d}", f"d{i + 1:02d}") for i in range(25)], "app string, name string, target string")
    files = spark.createDataFrame([("x", "d25", "d.png")], "app string, name string, image string")
    assert {r.name: len(r.trace) for r in R.resolve_drawables(refs, files).collect()} == {f"d{i:02d}": 26 - i for i in range(26)}
    pairs = spark.createDataFrame([("x", f"i{k}", k, "", "") for k in range(9)], "app string, image string, id long, id_name string, layout string")
    groups = spark.createDataFrame([("x", k, f"i{k}", [f"i{k + 1}"]) for k in range(8)], "app string, ord int, head string, images array<string>")
    assert {(r.image, r.id) for r in A.propagate(pairs, groups).collect()} == {(f"i{k}", 0) for k in range(9)}


def test_many_ties(spark):
    train = spark.createDataFrame([(999 - i, "g", [1.0, i * 1e-9]) for i in range(40)], "tid long, grp string, vector array<double>")
    query = spark.createDataFrame([(1, "g", [0.0, 0.0]), (970, "g", [0.0, 0.0])], "id long, grp string, vector array<double>")
    got = {(r.id, r["rank"]): r.tid for r in O.neighbours(query, train, 3, decimals=6).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == [960, 961, 962]
    rest = {(r.id, r["rank"]): r.tid for r in O.neighbours(query, train, 12, decimals=6, others=True).collect()}
    assert [rest[970, k] for k in range(9, 13)] == [968, 969, 971, 972] and rest[1, 11] == 970


def test_type_kinds(spark):
    edges = spark.createDataFrame([("a.B", "android.view.View"), ("a.C", "a.B"), ("a.D", "android.app.Dialog"), ("a.E", "java.lang.Object")], "src string, dst string")
    got = {(r["sub"], r.kind) for r in R.type_kinds(R.closure(edges)).collect() if r["sub"].startswith("a.")}
    assert got == {("a.B", "view"), ("a.C", "view"), ("a.D", "dialog")}


def test_running_ranks(spark):
    from sparkglyph.operators.scratch import running

    rng = np.random.default_rng(8)
    rows = [(int(k), int(o), int(v)) for k, o, v in zip(rng.integers(0, 3, 200), rng.permutation(200), rng.integers(0, 9, 200))]
    got = running(spark.createDataFrame(rows, "k int, o int, v int"), ["k"], ["o"], {"n": F.lit(1), "s": F.col("v")}, 5).collect()
    for r in got:
        before = [v for k, o, v in rows if k == r.k and o < r.o]
        assert (r.n, r.s) == (len(before), sum(before))


def test_suppression_brute_force(spark):
    rng = np.random.default_rng(4)
    boxes = [("a", float(x), float(y), float(x) + 30, float(y) + 20, i / 100) for i, (x, y) in enumerate(rng.integers(0, 120, (60, 2)))]
    left, kept = sorted(boxes, key=lambda b: -b[5]), set()
    area = lambda b: (b[3] - b[1] + 1) * (b[4] - b[2] + 1)
    while left:
        best = left.pop(0)
        kept.add(best[5])
        shared = lambda b: max(0, min(b[3], best[3]) - max(b[1], best[1]) + 1) * max(0, min(b[4], best[4]) - max(b[2], best[2]) + 1)
        left = [b for b in left if shared(b) / area(b) <= 0.3]
    got = V.suppress(spark.createDataFrame(boxes, "img string, x0 double, y0 double, x1 double, y1 double, score double"), "img")
    assert {r.score for r in got.collect()} == kept
