"""Near-duplicates by min-max hashing.

Each permutation gives two values of a document's shingles, the least and the
greatest, so half the hash evaluations fill a signature. Bands of minima and
bands of maxima bring candidates together; every link is confirmed on the full
shingle sets.

Documents with equal sets form a class at once and go on as one. In a bucket of
a band, members are compared with the bucket's first member, the one with the
smallest share of shingles of its own; what is linked forms components. Members
of different components that share a bucket are compared further only where
bounds on their intersection allow a link, so a large group of near copies
costs its size, not its square. The bounds are exact: they drop no link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected
from .flat import give_back, pieces

PERMUTATIONS = 120
#: 20 bands of minima and 20 of maxima, 6 rows each: a pair at 0.8 is missed once in 190,000 times.
ROWS = 6
WORD_CACHE = 200_000
#: Members of a group that are held against its hub in one task, about.
HUB_MEMBERS = 500


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words, A-Z in lower case."""
    got = text.lower().split()  # bytes: A-Z only, and white space is the space and the control characters 9 to 13
    n = len(got)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, got), np.uint64, n)
    k = min(width, n)
    x = np.full(n - k + 1, 1469598103934665603 + k, np.uint64)
    for i in range(k):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i])
    return np.unique(x)


def _permutations(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def bands(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each band of minima, then of maxima."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(a), np.uint64)
    for i in range(0, len(x), 1024):
        p = x[i : i + 1024, None] * a + b
        np.minimum(low, p.min(axis=0), out=low)
        np.maximum(high, p.max(axis=0), out=high)
    both = np.concatenate([low, high]).reshape(-1, ROWS)
    h = np.arange(len(both), dtype=np.uint64)
    for r in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + both[:, r])
    return h.view(np.int64)


def _digest(x: np.ndarray) -> bytes | None:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None


def _node(set_hash: str = "set_hash") -> Column:
    """The number by which a set goes: half of its hash. Ids would not do, since one id may stand on several texts."""
    return F.conv(F.hex(F.substring(set_hash, 1, 8)), 16, -10).cast("long")


def signatures(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (null without shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        a, b = _permutations(seed)
        for batch in batches:
            n, digest, band = [], [], []
            for _, _, data, at in pieces(batch.column("text")):
                raw = data.tobytes()
                for i, j in zip(at, at[1:]):
                    x = shingles(raw[i:j], width, words)
                    n.append(len(x))
                    digest.append(_digest(x))
                    band.append(bands(x, a, b) if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_hash", "bands"]
            )
        give_back()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, width: int) -> DataFrame:
    """rep and shingle set of the wanted sets (rep, doc_id), from whole texts of the documents named."""
    ids = wanted.select("doc_id").distinct()
    texts = docs.join(C.broadcast_if_small(ids, n_wanted, 24), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for _, _, data, at in pieces(batch.column("text"), 1 << 20):
                raw = data.tobytes()
                got = [shingles(raw[i:j], width, words) for i, j in zip(at, at[1:])]
                names = [_digest(x) for x in got]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([x.view(np.int64) for x in got], pa.list_(pa.int64()))], names=["set_hash", "shingles"])

    got = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "set_hash binary, shingles array<long>")
    # an id may stand on other texts too, and on repeated rows
    got = got.where("set_hash IS NOT NULL").withColumn("rep", _node()).join(C.broadcast_if_small(wanted.select("rep"), n_wanted, 24), "rep", "left_semi")
    return got.groupBy("rep").agg(F.first("shingles").alias("shingles"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    pairs = C.materialize(pairs, "dedup-pairs")
    both = pairs.join(sets.selectExpr("rep AS a", "shingles AS x"), "a").join(sets.selectExpr("rep AS b", "shingles AS y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")
    links = C.materialize(links, "dedup-links")
    C.discard(pairs)
    return links


def _shared(sets: DataFrame) -> DataFrame:
    """(rep, shared): how many shingles of each set are in another one as well; no intersection is larger."""
    lone = sets.select("rep", F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("k"), F.min("rep").alias("rep")).where("k = 1")
    lone = lone.groupBy("rep").agg(F.count("*").alias("lone"))
    return sets.select("rep", F.size("shingles").alias("n")).join(lone, "rep", "left").select("rep", (F.col("n") - F.coalesce("lone", F.lit(0))).cast("long").alias("shared"))


def _open_pairs(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and could still be links.

    A bucket's largest component is its main one; members of open buckets gather
    by main component, and each is held against that component's hub, its most
    central member. The intersection of two members is at most what the smaller
    has of the hub, plus the shingles beyond the hub that both have; the latter
    are counted by a join on the shingle itself. Pairs below the needed size go.
    """
    here = members.select("bucket", "rep", "n", "shared").join(comp.selectExpr("id AS rep", "component AS c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    here = C.materialize(here, "dedup-open")
    parts = here.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("parts")).where("parts > 1").selectExpr("bucket", "m.c AS main")
    group = C.materialize(here.join(main, "bucket").select("main", "rep", "n", "shared", "c").distinct(), "dedup-open")
    hubs = group.groupBy("main").agg(
        F.min_by("rep", F.when(F.col("c") == F.col("main"), F.struct(1 - F.col("shared") / F.col("n"), F.col("rep")))).alias("hub"), F.expr(f"CAST(ceil(count(*) / {HUB_MEMBERS}) AS INT)").alias("parts")
    )
    hubs = C.materialize(hubs, "dedup-hubs")
    # a hub's set stands in as many copies as its members take tasks
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    mine = group.join(hubs, "main").withColumn("part", part).join(sets.selectExpr("rep", "shingles AS x"), "rep")
    theirs = hubs.join(sets.selectExpr("rep AS hub", "shingles AS y"), "hub").select("main", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = mine.join(theirs, ["main", "part"])
    extra = F.array_except("x", "y")
    # sets of sizes further apart than the similarity allows never meet: classes of size, a little wider than that, and the ones beside them
    size = f"CAST(floor(ln(n) / (1.001 * ln(100 / {percent}D))) AS INT)" if percent < 100 else "CAST(n AS INT)"
    held = C.materialize(held.select("main", "rep", "n", "c", extra.alias("extra"), (F.col("n") - F.size(extra)).alias("k"), F.expr(size).alias("size")), "dedup-held")
    C.discard(here)
    few = held.where("c != main").selectExpr("main", "rep AS a", "n AS an", "c AS ac", "k AS ak", "extra AS ax", "size")
    rest = held.selectExpr("main", "rep AS b", "n AS bn", "c AS bc", "k AS bk", "extra AS bx", "size")
    apart = "ac != bc AND (bc = main OR a < b)"
    enough = f"100 * {{i}} >= {percent} * (an + bn - {{i}})"
    near = few.drop("ax").withColumn("size", F.explode(F.array(*(F.col("size") + i for i in (-1, 0, 1)))))
    plain = near.join(rest.drop("bx"), ["main", "size"]).where(apart).where(enough.format(i="least(ak, bk)"))
    more = few.withColumn("h", F.explode("ax")).drop("ax", "size").join(rest.withColumn("h", F.explode("bx")).drop("bx", "size"), ["main", "h"]).where(apart)
    more = more.groupBy("main", "a", "b").agg(*(F.first(c).alias(c) for c in ("an", "bn", "ak", "bk")), F.count("*").alias("e")).where(enough.format(i="(least(ak, bk) + e)"))
    return plain.select("a", "b").union(more.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, seed: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents link when 100 * common >= percent * united shingles; component_id
    is the smallest doc_id reachable, and its document alone is kept. Texts of
    fewer words than ``width`` have their whole sequence as one shingle. Null,
    empty and blank texts have no shingles and link with nothing. Repeated rows
    share id and set, and so everything; an id that stands on several texts is
    several documents, each in its own component. Rows with a null id link with
    nothing and are kept. An empty table gives an empty result; other columns
    are ignored.
    """
    docs = docs.select("doc_id", "text")
    sig = C.materialize(signatures(docs, width, seed), "dedup-signatures")
    has = F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull()
    classes = sig.where(has).groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = C.materialize(classes.withColumn("rep", _node()).drop("set_hash"), "dedup-classes")
    entries = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    # buckets of two classes or more, and the sets of those in them
    entries = entries.select("rep", "n", F.xxhash64("band", "key").alias("bucket"))
    full = C.materialize(entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket"), "dedup-buckets")
    # nearly all entries are alone in their buckets: where the others' buckets are few, these go to the entries, which are not dealt and sorted
    first_members = C.materialize(entries.join(C.broadcast_if_small(full, full.count(), 24), "bucket"), "dedup-members")
    C.discard(full)
    wanted = C.materialize(classes.select("rep", "doc_id").join(first_members.select("rep").distinct(), "rep"), "dedup-ids")
    sets = C.materialize(_sets(docs, wanted, wanted.count(), width), "dedup-sets")
    members = first_members.join(_shared(sets), "rep")
    # the first of a bucket is the member with the smallest share of shingles of its own
    first = members.groupBy("bucket").agg(F.min(F.struct((1 - F.col("shared") / F.col("n")).alias("own"), "rep", "n", "shared")).alias("f"))
    members = C.materialize(members.join(first, "bucket"), "dedup-members")
    C.discard(first_members, wanted)
    # what sizes and shared shingles allow: an intersection of two sets is within the shared shingles of either
    fits = f"100 * least({{a}}k, {{b}}k) >= {percent} * ({{a}}n + {{b}}n - least({{a}}k, {{b}}k)) AND 100 * least({{a}}n, {{b}}n) >= {percent} * greatest({{a}}n, {{b}}n)"
    against = members.selectExpr("bucket", "rep AS a", "n AS an", "shared AS ak", "f.rep AS b", "f.own AS own", "f.n AS bn", "f.shared AS bk").where("a != b").where(fits.format(a="a", b="b"))

    # each class against the best first member of its buckets, then against all of them that are not yet one with it
    pairs = against.groupBy("a").agg(F.min_by("b", F.struct("own", "b")).alias("b"))
    links = _confirm(pairs, sets, percent)
    tried = pairs
    for step in ("firsts", "rest"):
        if links is not None:
            comp = C.materialize(connected(links), "dedup-components")
        if step == "firsts":
            pairs = against.join(comp.selectExpr("id AS a", "component AS ac"), "a", "left").join(comp.selectExpr("id AS b", "component AS bc"), "b", "left")
            pairs = pairs.where("coalesce(ac, a) != coalesce(bc, b)").select("a", "b").distinct()
        else:
            pairs = _open_pairs(members, comp, sets, percent)
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
        tried = tried.union(pairs)
        # what is known of the components stands for the links before
        more = _confirm(pairs, sets, percent)
        links = None if more.isEmpty() else comp.selectExpr("id AS a", "component AS b").union(more)
    if links is not None:
        comp = C.materialize(connected(links), "dedup-components")
    C.discard(members, sets)
    found = classes.select("rep", "doc_id").join(comp.selectExpr("id AS rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = C.materialize(found.join(least, "component").select("rep", "component_id"), "dedup-found")
    known = sig.where(has).select("doc_id", "n_shingles", _node().alias("rep")).join(found, "rep").select("doc_id", "n_shingles", "component_id")
    rest = sig.where(~has).selectExpr("doc_id", "n_shingles", "doc_id AS component_id")
    return known.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, seed: int = 3) -> DataFrame:
    """The documents kept, with all their columns.

    A document stays when its id is the smallest of its component; all rows that
    repeat a kept id stay, as they are one document. Null, empty and blank texts
    and rows with a null id have no copies and stay; an empty table gives an
    empty result; columns of any other name pass through.
    """
    found = near_duplicates(docs, width, percent, seed).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
