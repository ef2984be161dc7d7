"""Scans. Every reader returns a lazy DataFrame with a pinned schema; paths may be files, folders or globs of any store Spark reads."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing as P

ASSOCIATION = ["apk", "image", "wid", "wid_name", "layout", "handler", "method", "permissions"]
LAYOUT_TAGS = "name STRING, tags ARRAY<STRUCT<id: BIGINT, idName: STRING, imgs: ARRAY<STRUCT<attribute: STRING, value: STRING>>, name: STRING>>"
GUI_MODEL = "name STRING, views ARRAY<STRUCT<handlers: ARRAY<STRUCT<event: STRING, handlers: ARRAY<STRING>>>, images: ARRAY<STRING>, name: STRING>>"
IMAGE_GROUPS = "name STRING, images ARRAY<STRING>"


def _stem(path: str = "_metadata.file_path") -> F.Column:
    return F.regexp_extract(F.col(path), r"([^/]+?)(?:\.apk)?(?:\.image)?\.[A-Za-z0-9]+$", 1)


def association_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """SRC-01: eight string columns by position, the last decoded to an array."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ASSOCIATION])
    rows = spark.read.csv(path, header=header, schema=schema, quote='"', escape='"', enforceSchema=True)
    return rows.withColumn("permissions", P.decode_list(F.col("permissions")))


def zipped_csv(spark: SparkSession, path: str, columns: list[str] = ASSOCIATION) -> DataFrame:
    """SRC-02: CSV inside zip archives: the member named as the archive, else with .csv, else the only one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                stem = re.sub(r"\.zip$", "", file.rsplit("/", 1)[-1])
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    member = next((n for n in (stem, f"{stem}.csv") if n in names), names[0] if len(names) == 1 else None)
                    if member is None:
                        raise ValueError(f"{file}: no member {stem}, {stem}.csv, nor a single one")
                    rows = csv.reader(io.TextIOWrapper(z.open(member), "utf-8", newline=""))
                    next(rows, None)
                    while part := [r for _, r in zip(range(10_000), rows)]:
                        yield pd.DataFrame([(r + [None] * len(columns))[: len(columns)] for r in part], columns=columns)

    schema = ", ".join(f"{c} STRING" for c in columns)
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
    return rows.withColumn(columns[-1], P.decode_list(F.col(columns[-1])))


def permission_tsv(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-03: per-app tab-separated files, columns taken by name, so that an extra column cannot shift them."""
    return spark.read.csv(folder, sep="\t", header=True, pathGlobFilter="*.csv")


def ragged_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04: `method TAB p1 TAB p2 ...`; the last line of a method wins."""
    parts = F.split("value", "\t")
    lines = numbered_lines(spark, path).where(F.col("value") != "")
    rows = lines.select("file", "line", parts[0].alias("method"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("permissions"))
    return rows.groupBy("method").agg(F.max_by("permissions", F.struct("file", "line")).alias("permissions"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value: lines with their order, files whole."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    return text.select("file", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", "value"))


def layout_tags(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: app, layout, id, id_name, tag, attribute, value: one row per image of a tag."""
    raw = spark.read.json(path, schema=LAYOUT_TAGS, multiLine=True).select(_stem().alias("app"), F.col("name").alias("layout"), F.explode("tags").alias("t"))
    return raw.select("app", "layout", F.col("t.id").alias("id"), F.col("t.idName").alias("id_name"), F.col("t.name").alias("tag"), F.explode("t.imgs").alias("i")).select(
        "app", "layout", "id", "id_name", "tag", "i.attribute", "i.value"
    )


def gui_model(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: app, window, view, images, handlers (event, handlers). A missing file is an empty table."""
    try:
        raw = spark.read.json(path, schema=GUI_MODEL, multiLine=True)
        raw = raw.select(_stem().alias("app"), F.col("name").alias("window"), F.explode("views").alias("v"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], f"app STRING, window STRING, v STRUCT<{_view_fields()}>")
    return raw.select("app", "window", F.col("v.name").alias("view"), "v.images", "v.handlers")


def _view_fields() -> str:
    return "handlers: ARRAY<STRUCT<event: STRING, handlers: ARRAY<STRING>>>, images: ARRAY<STRING>, name: STRING"


def image_groups(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: app, ord, head, images; ord is the group's order in its file."""
    text = spark.read.text(path, wholetext=True).select(_stem().alias("app"), F.from_json("value", f"ARRAY<STRUCT<{IMAGE_GROUPS.replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY')}>>").alias("g"))
    return text.select("app", F.posexplode("g").alias("ord", "g")).select("app", "ord", F.col("g.name").alias("head"), "g.images")


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: app names, one a line; carriage returns end lines too."""
    return numbered_lines(spark, path).where(F.trim("value") != "").select("line", F.trim("value").alias("app"))


def listing(spark: SparkSession, path: str, suffix: str = ".apk.json") -> DataFrame:
    """SRC-09: names in a folder that end in the suffix, without it. No content is read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.where(F.col("path").endswith(suffix)).select(F.regexp_extract("path", rf"([^/]+){re.escape(suffix)}$", 1).alias("app"))


def xml_documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: file, name, xml: whole documents, for functions.xml and operators.layout."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("xml"))


def string_resources(docs: DataFrame) -> DataFrame:
    """SRC-11: (app, xml) -> (app, name, value): direct `string` children of the root, leading text only, the later name wins."""
    from ..functions.xml import element_table

    nodes = element_table(docs, ["app"])
    strings = nodes.where((F.col("tag") == "string") & (F.col("depth") == 1)).select("app", F.element_at("attrs", "name").alias("name"), F.col("text").alias("value"), "node")
    return strings.groupBy("app", "name").agg(F.max_by("value", "node").alias("value"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: path and bytes; a path that is missing is an empty table."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path STRING, content BINARY")


def rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: stored rows. Parquet takes the place of pickles, which are never loaded."""
    return spark.read.parquet(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-14: one JSON value a line; nothing is evaluated as code."""
    return spark.read.schema(schema).json(path)


def component_messages(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: text-format messages, flattened: file, field path, value, in order. `a { b: "x" }` gives path a.b."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    schema = "file STRING, ord BIGINT, path STRING, node STRING, value STRING"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, body in zip(batch["file"], batch["text"]):
                yield pd.DataFrame(P.text_message(file, body or ""), columns=["file", "ord", "path", "node", "value"])

    return text.mapInPandas(run, schema)


def permission_lookup(spark: SparkSession, source: str, **jdbc: str) -> DataFrame:
    """SRC-16: (method, permission), read once: a Parquet path, or a table name with JDBC options."""
    if not jdbc:
        return spark.read.parquet(source)
    return spark.read.format("jdbc").options(dbtable=source, **jdbc).load()


def source_sink_spec(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: signature, permission (null if none), kind (SOURCE, SINK); % starts a comment."""
    text = spark.read.text(path).where(~F.ltrim("value").startswith("%") & F.col("value").rlike(r"->\s*_(SOURCE|SINK)_"))
    sig = F.regexp_extract("value", r"^\s*(<.*>)\s*\S*\s*->", 1)
    perm = F.regexp_extract("value", r">\s+([\w.]+)\s*->", 1)
    return text.select(sig.alias("signature"), F.nullif(perm, F.lit("")).alias("permission"), F.regexp_extract("value", r"_(SOURCE|SINK)_", 1).alias("kind"))


def taint_wrapper_spec(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: op (include, exclude, kill, method) and value."""
    text = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
    op = F.when(F.col("v").startswith("^"), "include").when(F.col("v").startswith("~"), "exclude").when(F.col("v").startswith("-"), "kill").otherwise("method")
    return text.select(op.alias("op"), F.when(op == "method", F.col("v")).otherwise(F.expr("substring(v, 2)")).alias("value"))


def _typed_nodes(spark: SparkSession, path: str) -> DataFrame:
    from ..functions.xml import element_table

    return element_table(xml_documents(spark, path).select("file", "xml"), ["file"])


def _up(nodes: DataFrame, tag: str, keep: dict[str, str]) -> DataFrame:
    """Path and attributes (`keep` names them) of the elements with a tag."""
    return nodes.where(F.col("tag") == tag).select("file", F.col("path").alias(f"{tag}_path"), *(F.element_at("attrs", a).alias(n) for a, n in keep.items()))


def listener_spec(spark: SparkSession, path: str) -> DataFrame:
    """SRC-19: gui_type, event, registration, position, handler, handler_position."""
    n = _typed_nodes(spark, path)
    gui = _up(n, "gui", {"type": "gui_type"})
    event = _up(n, "event", {"name": "event"})
    reg = _up(n, "registration", {"subsig": "registration", "position": "position"})
    h = _up(n, "handler", {"subsig": "handler", "position": "handler_position"})
    out = h
    for level, frame in (("registration", reg), ("event", event), ("gui", gui)):
        below = {"registration": "handler", "event": "registration", "gui": "event"}[level]
        out = out.withColumn(f"{level}_path", F.regexp_replace(f"{below}_path", r"/\d+$", "")).join(frame, ["file", f"{level}_path"])
    return out.select("gui_type", "event", "registration", F.col("position").cast("int"), "handler", F.col("handler_position").cast("int"))


def role_spec(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: role, class, subsig, args (array of attribute maps)."""
    n = _typed_nodes(spark, path)
    role, cls = _up(n, "role", {"type": "role"}), _up(n, "class", {"type": "class"})
    inv = _up(n, "invocation", {"subsig": "subsig"})
    arg = n.where(F.col("tag") == "arg").groupBy("file", F.regexp_replace("path", r"/\d+$", "").alias("invocation_path")).agg(F.collect_list("attrs").alias("args"))
    out = inv.join(arg, ["file", "invocation_path"], "left").withColumn("class_path", F.regexp_replace("invocation_path", r"/\d+$", ""))
    out = out.join(cls, ["file", "class_path"]).withColumn("role_path", F.regexp_replace("class_path", r"/\d+$", "")).join(role, ["file", "role_path"])
    return out.select("role", "class", "subsig", F.coalesce("args", F.array().cast("array<map<string,string>>")).alias("args"))


def widget_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC-21: simple, fqcn; lines of other than two fields are left out, the first line of a name wins."""
    parts = F.split("value", ",")
    lines = numbered_lines(spark, path).where(F.size(parts) == 2).select("file", "line", F.trim(parts[0]).alias("simple"), F.trim(parts[1]).alias("fqcn"))
    return lines.groupBy("simple").agg(F.min_by("fqcn", F.struct("file", "line")).alias("fqcn"))


def r_symbols(spark: SparkSession, path: str) -> DataFrame:
    """SRC-22: type, subclass, name, id: the first value only, hexadecimal or decimal; braces and commas of arrays are dropped."""
    parts = F.split(F.trim(F.regexp_replace("value", "[{},]", " ")), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) >= 4).select(parts[0].alias("type"), parts[1].alias("subclass"), parts[2].alias("name"), parts[3].alias("v"))
    return rows.select("type", "subclass", "name", P.decode_int(F.col("v")).alias("id"))


def project_config(spark: SparkSession, path: str) -> DataFrame:
    """SRC-23: key, settings (map) and base (map of the BASE_* entries), one row per project."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    base = F.map_filter("m", lambda k, _: k.startswith("BASE_"))
    rows = text.select(base.alias("base"), F.explode(F.map_filter("m", lambda k, _: ~k.startswith("BASE_"))).alias("key", "v"))
    return rows.select("key", F.from_json("v", "map<string,string>").alias("settings"), "base")


def archive_classes(spark: SparkSession, path: str, package: str = "") -> DataFrame:
    """SRC-24: distinct dotted names of .class entries of zip archives, of one package if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame({"entry": [n for n in z.namelist() if n.endswith(".class")]}, dtype=str)

    entries = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "entry STRING")
    name = F.translate(F.regexp_replace("entry", r"\.class$", ""), "/", ".")
    return entries.select(name.alias("class")).where(F.col("class").startswith(package)).distinct()


def device_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC-25: file, line, tag (BEGIN, REP, THREAD, END, MEM, ...) and value of each line of a log."""
    return numbered_lines(spark, path).select("file", "line", *P.log_tags(F.col("value")))


def drawable_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """SRC-26: file, app, folder, name, kind of every file below res/*drawable*; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    pattern = r"([^/]+)/res/([^/]*drawable[^/]*)/([^/]+?)(?:\.9)?\.([A-Za-z0-9]+)$"
    got = files.where(F.col("file").rlike(pattern))
    return got.select("file", *(F.regexp_extract("file", pattern, i + 1).alias(c) for i, c in enumerate(("app", "folder", "name", "kind"))))


def first_path(catalogue: DataFrame, prefix: str) -> DataFrame:
    """SRC-27: the first path by name of each (app, name) among folders with the prefix."""
    return catalogue.where(F.col("folder").startswith(prefix)).groupBy("app", "name").agg(F.min("file").alias("file"))


def main_package(packages: DataFrame, skipped: tuple[str, ...] = ("android", "com.htc")) -> DataFrame:
    """SRC-28: of (app, package, specs), the package with the most specs, the skipped ones aside; ties by name. Decoding is external."""
    return packages.where(~F.col("package").isin(*skipped)).groupBy("app").agg(F.min_by("package", F.struct(-F.col("specs"), F.col("package"))).alias("package"))


def dot_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (file, id, signature) and edges (file, src, dst) of DOT files."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    vertex = r'^\s*(\d+)\s*\[\s*label="(.*)"\s*\]'
    edge = r"^\s*(\d+)\s*->\s*(\d+)"
    get = lambda p, i: F.regexp_extract("value", p, i)
    v = lines.where(F.col("value").rlike(vertex)).select("file", get(vertex, 1).cast("long").alias("id"), get(vertex, 2).alias("signature"))
    e = lines.where(F.col("value").rlike(edge)).select("file", get(edge, 1).cast("long").alias("src"), get(edge, 2).cast("long").alias("dst"))
    return v, e


def published_rows(spark: SparkSession, path: str) -> DataFrame:
    """Image-widget rows whose last cell holds unquoted commas: split into six parts at most."""
    parts = F.split("value", ",", 6)
    names = ["app", "image", "id", "id_name", "layout", "handler"]
    lines = spark.read.text(path).where(~F.col("value").startswith("APK,") & (F.size(parts) == 6))
    return lines.select(*(parts[i].alias(c) for i, c in enumerate(names))).withColumn("id", F.col("id").cast("long"))
