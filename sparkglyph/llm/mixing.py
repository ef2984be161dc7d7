"""Mixing sources to target weights by a low-discrepancy schedule.

Points of the golden-ratio sequence are mapped through the sources' cumulative
shares to a schedule of slots, slots are ranked within their source, and each
takes the block of that rank from the source's shuffled stream of words. A
stream repeats when its target exceeds it.

Ranks and stream positions are prefix sums in two levels (within chunks, then
over chunks), so a source may hold any share of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK_WORDS = 4096
#: The golden-ratio lattice: multiples of STEP modulo 2^BITS.
BITS = 40
STEP = round((math.sqrt(5) - 1) / 2 * 2**BITS) | 1
SLOT_CHUNK = 1 << 16
MAX_REPEATS = 3


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size): weight and target of each source, and sid, its place in code-point order, null last.

    Weights are 1, 2, 3 and again. Capped sources are the first by cap over
    weight: walking them in that order, the level of the rest is known from
    running sums, and the first source above its level and all after it are not
    capped. One row per source goes through one sort.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(by_name).cast("long") - 1).withColumn("weight", (F.col("sid") % 3 + 1).cast("double"))
    s = s.withColumn("cap", MAX_REPEATS * F.col("source_size").cast("double"))
    ranked = every.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(whole)
    rest = F.sum("weight").over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest)
    s = s.withColumn("free", F.col("cap") >= F.col("level") * F.col("weight"))
    level = F.min_by("level", F.struct(F.when(F.col("free"), 0).otherwise(1), F.col("cap") / F.col("weight"), F.col("sid"))).over(whole)
    s = s.withColumn("water", F.when(F.max("free").over(whole), level).otherwise(F.lit(float("inf"))))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return s.select("source", "source_size", "sid", "weight", target.alias("target"))


def schedule(spark: SparkSession, sources: DataFrame, n_sources: int, n_slots: int, block: int) -> DataFrame:
    """One row per slot: slot, sid, rank.

    sources: sid, slots (blocks wanted). A slot is a golden-ratio point; the
    interval of cumulative slots it falls into is its source. Where the points
    give a source more slots than it wants, the surplus is void; where they give
    fewer, the missing ones follow at the end.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("sid")
    lo = F.coalesce(F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sources.where(F.col("slots") > 0).withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col("slots"))
    cells = max(1024, 4 * n_sources)
    spans = spans.selectExpr(
        "sid", f"lo / {float(n_slots)} AS a", f"hi / {float(n_slots)} AS b",
        f"explode(sequence(CAST(floor(lo / {float(n_slots)} * {cells}) AS BIGINT), CAST(least(ceil(hi / {float(n_slots)} * {cells}), {cells - 1}) AS BIGINT))) AS cell",
    )
    half, mask = BITS // 2, (1 << (BITS // 2)) - 1
    n = F.col("slot")
    high = F.shiftright(n, half).bitwiseAND(F.lit(mask)) * F.lit(STEP & mask)
    point = F.pmod(n.bitwiseAND(F.lit(mask)) * F.lit(STEP) + F.shiftleft(high.bitwiseAND(F.lit(mask)), half), F.lit(1 << BITS)) / float(1 << BITS)
    slots = spark.range(0, n_slots, 1, max(1, min(4096, -(-n_slots // SLOT_CHUNK)))).select(F.col("id").alias("slot")).withColumn("u", point)
    slots = slots.withColumn("cell", F.floor(F.col("u") * cells))
    spans = C.broadcast_if_small(spans, cells + n_sources, 40)
    drawn = slots.join(spans, "cell").where((F.col("u") >= F.col("a")) & (F.col("u") < F.col("b"))).select("slot", "sid", F.expr(f"slot div {SLOT_CHUNK}").alias("chunk"))
    by = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = drawn.withColumn("r", F.row_number().over(inside) - 1).join(by.select("sid", "chunk", "before"), ["sid", "chunk"])
    ranked = ranked.select("slot", "sid", (F.col("r") + F.col("before")).alias("rank"))
    ranked = ranked.join(C.broadcast_if_small(sources.select("sid", "slots"), n_sources, 16), "sid").where(F.col("rank") < F.col("slots"))
    drawn_n = by.groupBy("sid").agg(F.sum("n").alias("n"))
    missing = sources.join(drawn_n, "sid", "left").where(F.col("slots") > F.coalesce("n", F.lit(0)))
    missing = missing.select("sid", F.explode(F.sequence(F.coalesce("n", F.lit(0)), F.col("slots") - 1)).alias("rank"))
    missing = missing.select((F.lit(n_slots) + F.xxhash64("sid", "rank").bitwiseAND(F.lit((1 << 40) - 1))).alias("slot"), "sid", "rank")
    return ranked.select("slot", "sid", "rank").unionByName(missing)


#: Repeated rows are gathered in so many parts, so that no array holds more than this share of them.
SALTS = 4096


def mix(docs: DataFrame, keys: list[str], source: str = "source", block: int = BLOCK_WORDS, seed: int = 5, row: str | None = None) -> DataFrame:
    """Pieces of documents in the mix, one row per document, repeat and slot it lies in.

    Returns ``keys`` (and ``row``, a column that numbers the rows, where given),
    size, source, source_size, target, start (its place in the source's stream),
    and for documents taken: slot, rank, epoch (0 for the first pass over the
    stream), at (first word of the piece in its document), n (words). Documents
    of which nothing is taken have one row with n = 0.

    Null texts have size 0; null sources form one source, the last in order;
    repeated rows are separate documents, which stand side by side in the
    stream; an empty table gives an empty result; sources without words have
    target 0. Reruns agree: order comes from hashes of the keys alone.
    """
    spark = docs.sparkSession
    own = [row] if row else []
    inner = docs.select(*keys, *own, F.col(source).alias("source"), C.n_words(F.col("text")).alias("size"))
    inner = C.materialize(inner, "mix-sizes")
    sums = inner.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = C.materialize(targets(sums.select("source", "source_size")), "mix-targets")
    plan = plan.withColumn("take", F.least(F.floor(F.col("target") + 0.5), MAX_REPEATS * F.col("source_size")).cast("long"))
    plan = plan.withColumn("slots", F.expr(f"(take + {block - 1}) div {block}"))
    totals = plan.agg(F.count("*").alias("sources"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).first()
    n_docs = inner.count()

    # the shuffled stream of each source: chunks by hash, documents by hash within them; repeated rows go as one until they have their places
    chunks = max(64, n_docs // 20_000)
    h = F.xxhash64(*keys, "size", F.lit(seed))
    named = C.broadcast_if_small(plan.withColumnRenamed("source", "plan_source"), totals.sources, 120)
    salt = F.pmod(F.xxhash64(row), F.lit(SALTS)) if row else F.lit(0)
    alike = inner.groupBy(*keys, "source", "size", salt.alias("salt")).agg(F.count("*").alias("copies"), *([F.array_sort(F.collect_list(row)).alias("rows")] if row else []))
    d = alike.join(named, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    d = d.withColumn("h", h).withColumn("chunk", F.pmod(F.shiftrightunsigned("h", 20), F.lit(chunks)).cast("int"))
    words = F.col("size") * F.col("copies")
    by = d.groupBy("sid", "chunk").agg(F.sum(words).alias("words"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select("sid", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "chunk").orderBy("h", *keys, "salt").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    d = d.join(C.broadcast_if_small(by, totals.sources * chunks, 32), ["sid", "chunk"])
    copies = F.posexplode("rows").alias("copy", row) if row else F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    d = d.select("*", copies).withColumn("start", F.col("start") + F.col("before") + F.col("copy") * F.col("size"))
    keys = [*keys, *own]
    stream = C.materialize(d.select(*keys, "size", "source", "source_size", "target", "start", "sid", "take"), "mix-stream")
    C.discard(inner)
    d = stream

    # where a document lies in the stream's passes, and in blocks
    cols = [*keys, "size", "source", "source_size", "target", "start"]
    lies = d.where((F.col("size") > 0) & (F.col("start") < F.col("take")))
    lies = lies.withColumn("epoch", F.explode(F.expr("sequence(0L, (take - 1 - start) div source_size)")))
    lies = lies.withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("take")))
    lies = lies.withColumn("rank", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})")))
    first = F.greatest("a", F.col("rank") * block)
    lies = lies.select(*cols, "sid", "rank", "epoch", (first - F.col("a")).alias("at"), (F.least("b", (F.col("rank") + 1) * block) - first).alias("n"))
    slots = schedule(spark, plan.select("sid", "slots"), totals.sources, max(1, totals.slots), block)
    taken = lies.join(slots, ["sid", "rank"]).select(*cols, "slot", "rank", "epoch", "at", "n")
    idle = d.where((F.col("size") == 0) | (F.col("start") >= F.col("take")))
    none = [F.lit(None).cast("long").alias(c) for c in ("slot", "rank", "epoch", "at")]
    return taken.unionByName(idle.select(*cols, *none, F.lit(0).cast("long").alias("n")))


def digest(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    pieces = mix(docs.select("doc_id", "text", "source"), ["doc_id"], block=block)
    # documents with words have places of their own in their source's stream; the rest have one row each
    some = pieces.where(F.col("n") > 0).groupBy("source", "start").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("n").alias("taken")
    )
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    return some.select(cols).unionByName(pieces.where(F.col("n") == 0).select("doc_id", "size", "source_size", "target", F.col("n").alias("taken")))


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: a row with the columns of ``docs`` for each pass that takes the document.

    A pass that ends within a document cuts its text after the last word taken;
    n_chars, where present, follows. Null, empty and blank texts have no words
    and are not taken; null ids and sources pass through; repeated rows are
    separate documents; an empty table gives an empty result; columns of any
    other name pass through. Rows are numbered once, in a written copy, and what
    the mix takes is joined on that number, so texts are shuffled once.
    """
    at = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    inner = C.materialize(docs.withColumnsRenamed(at).withColumn("row", F.monotonically_increasing_id()), "mix-docs")
    keyed = inner.select("row", F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), F.col(at["source"]).alias("source"))
    keyed = keyed.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    pieces = mix(keyed, ["doc_id", "text_hash"], block=block, row="row")
    passes = pieces.where(F.col("n") > 0).groupBy(F.col("row").alias("m_row"), "epoch").agg(F.first("size").alias("m_size"), F.sum("n").alias("m_n"))
    both = inner.join(passes.drop("epoch"), F.col("row") == F.col("m_row"))
    text = F.col(at["text"])
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(C.WS_CLASS + "*" + C.NOT_WS_CLASS + "+"), F.lit(0)), F.lit(1), F.col("m_n").cast("int")), "")
    both = both.withColumn("new", F.when(F.col("m_n") < F.col("m_size"), cut).otherwise(text))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("new").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("m_n") < F.col("m_size"), F.length("new").cast(docs.schema[c].dataType)).otherwise(F.col(at[c])).alias(c))
        else:
            out.append(F.col(at[c]).alias(c))
    return both.select(*out)
