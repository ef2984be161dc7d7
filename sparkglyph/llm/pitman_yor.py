"""Hierarchical Pitman-Yor language model.

A token is drawn in two steps: the class of the next word given the two words
before it, then the word given its class. Both are Pitman-Yor restaurants. Class
contexts form a hierarchy: the restaurant of the word before (by its class) and
of the one before that (its class folded to FOLDED values) has that of the word
before alone as its parent, which has the one without context, which has a
uniform base.

Seating is sampled by Gibbs sweeps. In a sweep the dishes of a restaurant take
turns: all customers of a dish leave and sit down again one after another, given
the tables of all other dishes as they now stand. The draw is exact at every
size: while a dish has t tables, the customer who opens the next one is found by
a beta-geometric waiting time instead of a coin for every customer. Predictive
probabilities are averaged over the last sweeps.

Each class has a word restaurant. Its base is diffuse, an infinite stock of
spellings, so all customers of a word share one table and nothing is left to
sample: a word has its discounted count, and what discounts free, with the
strength, is the chance of any word never seen.

Classes are hashes of a word's last bytes, so there are N_CTX restaurants of
N_DISH dishes at most, whatever the corpus: that table is the one thing that is
broadcast, at 16 MB. Word counts grow with the corpus and are never collected;
texts meet the words' probabilities by a join, but for a bounded number of very
frequent words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .flat import pieces

#: The end of a text, a token that no word equals. Its class, 0, also stands before a text.
END = b"\n"
FOLDS, HELD_OUT = 5, 1
#: Sweeps, and how many of the last states are averaged.
CLASS_SWEEPS, CLASS_KEPT = 4, 2
STRENGTH = 1.0
#: Words that every task holds to spare the join, at most.
FREQUENT = 1 << 17
#: Distinct words a task counts before it hands them on.
COUNTED = 300_000
SUFFIX = 3
CLASS_CACHE = 400_000

N_DISH = 512
FOLDED = 16
N_CTX = FOLDED * N_DISH
_PARENT = (N_CTX - 1, N_DISH - 1, 0)  # masks of a context of two classes, of one, of none


class Classes(dict):
    """Class of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CLASS_CACHE:
            self.clear()
        k = self[word] = 0 if word == END else zlib.crc32(word[-SUFFIX:]) % (N_DISH - 1) + 1
        return k


def contexts(classes: np.ndarray) -> np.ndarray:
    """Keys (context * N_DISH + class) of the tokens of one text, whose last is the end."""
    one, two = np.zeros_like(classes), np.zeros_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    return ((two % FOLDED) * N_DISH + one) * N_DISH + classes


def seat(customers: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that the customers of one dish of each restaurant open, sitting down one after another.

    parent: the parent's probability of the dish; others: tables of the
    restaurant's other dishes. With n customers at t tables, the next one opens a
    table with odds (STRENGTH + discount * (others + t)) * parent to n - discount * t.
    Until one does, only n changes, so the wait is geometric in a beta draw.
    """
    t = (customers > 0).astype(np.float64)
    n = t.copy()
    here = np.flatnonzero(customers > 1)
    while len(here):
        w = np.maximum((STRENGTH + discount * (others[here] + t[here])) * parent[here], 1e-300)
        q = rng.beta(w, n[here] - discount * t[here])
        with np.errstate(divide="ignore", over="ignore"):
            wait = np.floor(np.log(1 - rng.random(len(here))) / np.log1p(-np.minimum(q, 1 - 1e-16))) + 1
        at = n[here] + wait
        opens = at <= customers[here]  # False also where the wait is endless
        here, at = here[opens], at[opens]
        t[here] += 1
        n[here] = at
        here = here[at < customers[here]]
    return t


def sweep(ctx: np.ndarray, c: np.ndarray, t: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Seats all dishes anew, those of a restaurant in turn; restaurants are independent given their parents. ctx is sorted."""
    t = t.copy()
    tables = np.bincount(ctx, weights=t, minlength=int(ctx[-1]) + 1 if len(ctx) else 0)
    first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(ctx)])
    for turn in range(int(size.max(initial=0))):
        k = first[size > turn] + turn
        others = tables[ctx[k]] - t[k]
        t[k] = seat(c[k], parent[k], others, discount, rng)
        tables[ctx[k]] = others + t[k]
    return t


def discount_of(ones: float, twos: float) -> float:
    """From the numbers of dishes with one and two customers; 0 where none has a single one."""
    return float(np.clip(ones / max(ones + 2 * twos, 1.0), 0.0, 0.95))


def class_model(keys: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """Averaged log10 probability of each class after each context, (N_CTX, N_DISH).

    keys: context * N_DISH + class; counts: customers.
    """
    keys = keys.astype(np.int64)
    levels = []
    k, c = keys, counts.astype(np.float64)
    for mask in _PARENT:
        full = ((k // N_DISH) & mask) * N_DISH + k % N_DISH
        k, inv = np.unique(full, return_inverse=True)
        levels.append({"key": k, "ctx": k // N_DISH, "up": None, "t": np.minimum(np.bincount(inv, weights=c, minlength=len(k)), 1.0)})
        levels[-1]["c"] = np.bincount(inv, weights=c, minlength=len(k))
        if len(levels) > 1:
            levels[-2]["up"] = inv
        c = levels[-1]["t"]
    discounts = [discount_of((v["c"] == 1).sum(), (v["c"] == 2).sum()) for v in levels]
    total = np.zeros((N_CTX, N_DISH), np.float32)
    kept = 0
    rng = np.random.default_rng(seed)
    for turn in range(CLASS_SWEEPS):
        # top down: predictive probabilities given the seating
        p = np.full((1, N_DISH), 1.0 / N_DISH)
        above = [None] * len(levels)
        for depth in range(len(levels) - 1, -1, -1):
            v, d, mask = levels[depth], discounts[depth], _PARENT[depth]
            size = mask + 1
            above[depth] = p[(v["ctx"] & _PARENT[depth + 1]) if depth + 1 < len(levels) else np.zeros(len(v["key"]), np.int64), v["key"] % N_DISH]
            n, t = np.bincount(v["ctx"], weights=v["c"], minlength=size), np.bincount(v["ctx"], weights=v["t"], minlength=size)
            share = ((STRENGTH + d * t) / (STRENGTH + n)).astype(np.float32)
            rows = np.arange(size) & (_PARENT[depth + 1] if depth + 1 < len(levels) else 0)
            q = p.astype(np.float32)[rows] * share[:, None]
            q.ravel()[v["key"]] += ((v["c"] - d * v["t"]) / (STRENGTH + n[v["ctx"]])).astype(np.float32)
            p = q
        if turn >= CLASS_SWEEPS - CLASS_KEPT:
            total += p
            kept += 1
        # bottom up: seat each level's customers, whose tables are the customers above
        for depth, v in enumerate(levels):
            if depth:
                below = levels[depth - 1]
                v["c"] = np.bincount(below["up"], weights=below["t"], minlength=len(v["key"]))
                v["t"] = np.minimum(v["t"], v["c"])
            v["t"] = sweep(v["ctx"], v["c"], v["t"], above[depth], discounts[depth], rng)
    if not kept or not len(keys):
        return np.full((N_CTX, N_DISH), -np.log10(N_DISH), np.float32)
    return np.log10(np.maximum(total / kept, 1e-30))


def count(docs: DataFrame) -> DataFrame:
    """Counts in rows with learn = true: of words (word, n; 0 where only others have them) and of class contexts (key, n; word null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, other, classes = Counter(), Counter(), Classes()
        keys, sums, loose = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merge() -> None:
            nonlocal keys, sums
            new = np.concatenate([keys, *loose])
            n = np.concatenate([sums, np.ones(len(new) - len(keys), np.int64)])
            keys, inv = np.unique(new, return_inverse=True)
            sums = np.bincount(inv, weights=n, minlength=len(keys)).astype(np.int64)
            loose.clear()

        def flush() -> pa.RecordBatch:
            words = [*learned, *(w for w in other if w not in learned)]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.nulls(len(words), pa.int64()), pa.array([learned[w] for w in words], pa.int64())], names=["word", "key", "n"])
            learned.clear()
            other.clear()
            return out

        waiting = 0
        for batch in batches:
            learn = batch.column("learn").to_pylist()
            for lo, hi, data, at in pieces(batch.column("text")):
                raw = data.tobytes()
                for i in range(hi - lo):
                    got = raw[at[i] : at[i + 1]].lower().split()
                    got.append(END)
                    if learn[lo + i]:
                        learned.update(got)
                        loose.append(contexts(np.fromiter(map(classes.__getitem__, got), np.int64, len(got))))
                        waiting += len(got)
                    else:
                        other.update(got)
                if len(learned) + len(other) > COUNTED:
                    yield flush()
                if waiting > 2_000_000:
                    merge()
                    waiting = 0
        merge()
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(sums)], names=["word", "key", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text"), "learn").mapInArrow(run, "word binary, key long, n long")
    return rows.groupBy("word", "key").agg(F.sum("n").alias("n"))


def word_model(counts: DataFrame) -> tuple[DataFrame, int]:
    """counts: (word, n). Returns (word, c, base, lp): log10 probabilities of each word, lp given its class; and the training tokens."""
    r = counts.agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long")), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
    n, types, ones, twos = (int(x or 0) for x in r)
    discount = discount_of(ones, twos)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes()
        for batch in batches:
            k = pa.array([classes[w] for w in batch.column("word").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("word"), k, batch.column("n")], names=["word", "k", "c"])

    words = C.materialize(counts.select("word", "n").mapInArrow(classed, "word binary, k long, c long"), "lm-classes")
    totals = np.zeros((N_DISH, 2))
    for r in words.groupBy("k").agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).collect():  # a row for each class
        totals[r[0]] = r[1:]

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, c = batch.column("k").to_numpy(), batch.column("c").to_numpy()
            customers, tables = totals[k, 0], totals[k, 1]
            p = np.where(c > 0, c - discount, STRENGTH + discount * tables) / (STRENGTH + customers)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(np.log10(p))], names=["word", "c", "lp"])

    base = F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (types + 1)))
    return words.mapInArrow(likely, "word binary, c long, lp double").select("word", "c", base.alias("base"), "lp"), n


def _frequent(words: DataFrame) -> dict[bytes, tuple[float, float]]:
    """The most frequent words, FREQUENT at most: all whose count's class of a quarter octave fits."""
    cls = F.floor(F.log2(F.col("c").cast("double")) * 4).cast("int")
    sizes = words.where("c > 1").groupBy(cls.alias("cls")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    least, so_far = None, 0
    for r in sorted(sizes, key=lambda r: -r.cls):
        if so_far + r.n > FREQUENT:
            break
        so_far, least = so_far + r.n, r.least
    if least is None:
        return {}
    got = words.where(F.col("c") >= least).select("word", "base", "lp").toArrow()
    return {w: (b, p) for w, b, p in zip(got["word"].to_pylist(), got["base"].to_pylist(), got["lp"].to_pylist())}


def score(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from rows outside the held-out fold (crc32 of the id as text; a null
    id counts as an empty text). Null and empty texts have the end token alone.
    Repeated rows all count and are each scored; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    held = C.crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    counts = C.materialize(count(docs.select("text", (~F.col("held_out")).alias("learn"))), "lm-counts")
    cells = counts.where("word IS NULL").select("key", "n").toArrow().sort_by("key")  # N_CTX * N_DISH rows at most
    table = spark.sparkContext.broadcast(class_model(cells["key"].to_numpy(), cells["n"].to_numpy().astype(np.float64), seed))
    words, n = word_model(counts.where("word IS NOT NULL"))
    words = C.materialize(words, "lm-words")
    frequent = spark.sparkContext.broadcast(_frequent(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, after, classes = frequent.value, table.value.ravel(), Classes()
        index = {w: i for i, w in enumerate(held)}
        logs = np.array([*held.values(), (0.0, 0.0)]).reshape(-1, 2)
        none = len(held)
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for lo, hi, data, at in pieces(batch.column("text"), 1 << 21):
                raw = data.tobytes()
                rows, rare_key, rare_word, rare_n = [], [], [], []
                for i in range(hi - lo):
                    got = raw[at[i] : at[i + 1]].lower().split()
                    got.append(END)
                    x = np.fromiter(map(index.get, got, repeat(none)), np.int64, len(got))
                    base, lp = logs[x].sum(axis=0)
                    lp += after[contexts(np.fromiter(map(classes.__getitem__, got), np.int64, len(got)))].sum(dtype=np.float64)
                    rest = Counter(got[j] for j in np.flatnonzero(x == none))
                    rows.append((len(got), len(got) - rest.total(), base, lp))
                    rare_key += [keys[lo + i]] * len(rest)
                    rare_word += rest.keys()
                    rare_n += rest.values()
                m, k = hi - lo, len(rare_key)
                a = np.array(rows, np.float64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*keys[lo:hi], *rare_key], pa.int64()),
                        pa.concat_arrays([batch.column("doc_id").slice(lo, m), pa.nulls(k, pa.int64())]),
                        pa.concat_arrays([batch.column("held_out").slice(lo, m), pa.nulls(k, pa.bool_())]),
                        pa.array([None] * m + rare_word, pa.binary()),
                        pa.array(np.concatenate([a[:, 0].astype(np.int64), np.array(rare_n, np.int64)])),
                        pa.array(np.concatenate([a[:, 1].astype(np.int64), np.zeros(k, np.int64)])),
                        pa.array(np.concatenate([a[:, 2], np.zeros(k)])),
                        pa.array(np.concatenate([a[:, 3], np.zeros(k)])),
                    ],
                    names=["key", "doc_id", "held_out", "word", "n", "known", "base", "lp"],
                )

    # `key` numbers the rows within this one pass, whose result is written
    inner = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "held_out", F.col("text").cast("binary").alias("text"))
    parts = C.materialize(inner.mapInArrow(run, "key long, doc_id long, held_out boolean, word binary, n long, known long, base double, lp double"), "lm-parts")
    whole = parts.where("word IS NULL").select("key", "doc_id", "held_out", F.col("n").alias("n_tokens"), "known", "base", "lp")
    rare = parts.where("word IS NOT NULL").select("key", "word", "n").join(words, "word")
    rare = rare.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("r_known"), F.sum(F.col("n") * F.col("base")).alias("r_base"), F.sum(F.col("n") * F.col("lp")).alias("r_lp")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.join(rare, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("r_known")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("r_base")).alias("base_score"), (F.col("lp") + zero("r_lp")).alias("score"),
    )
