"""Toxicity by a convolutional text classifier trained in numpy.

Words and their first letters are hashed to embeddings; filters of widths 1, 2
and 3 slide over the words of a whole text and are max-pooled into a logistic
output. Thresholds are calibrated by language, the language being guessed from
the hashed words alone, on every labelled document that may be learned from: each
is scored by a network fitted on the other folds. Scores are shifted so that each
language's threshold lies at 0.3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .flat import Adam, pieces

BUCKETS = 1 << 16
PREFIXES = (4, 6)
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
THRESHOLD = 0.3
#: Bound of the sample that the network is fitted on: documents, half of them toxic where there are as many.
TRAIN_DOCS = 8_000
FOLDS, HELD_OUT = 4, 2
#: Networks fitted for calibration, each without a fold.
CAL_FOLDS = 5
#: Toxic documents that the pooled histogram counts as beside a language's own.
POOLED = 20
#: Histograms of logits: bins to a unit, and the logit that they reach.
BINS, REACH = 32, 32

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, 0x100000001B3, np.uint64))])


_CLASS = np.zeros(256, np.uint8)  # 1: part of a word
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def hashed_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: hashed ids of the word and its prefixes, (words, 1 + prefixes); and the offsets of each text's words.

    Words are runs of ASCII letters and digits and of non-ASCII bytes, in lower
    case for ASCII and Latin-1 letters.
    """
    n = len(data)
    if not n:
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), np.zeros(len(at), np.int64)
    low = _FOLD[data]
    after_c3 = np.zeros(n, bool)
    after_c3[1:] = data[:-1] == 0xC3
    upper = after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low = np.where(upper, low + 32, low)
    inside = _CLASS[data].astype(bool)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = at[:-1][np.diff(at) > 0]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), np.zeros(len(at), np.int64)
    index = np.cumsum(begin) - 1
    where = np.arange(n) - starts[np.maximum(index, 0)]
    power = _powers(64)[where % 64]
    part = np.where(inside & (index >= 0), (low.astype(np.uint64) + np.uint64(1)) * power, np.uint64(0))
    ids = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    for k, cut in enumerate((None, *PREFIXES)):
        h = np.add.reduceat(part if cut is None else np.where(where < cut, part, np.uint64(0)), starts)
        ids[:, k] = ((h ^ np.uint64(k)) * _MULT >> np.uint64(48)).astype(np.int32)
    return ids, np.searchsorted(starts, at).astype(np.int64)


class WordCnn:
    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.used = np.array([[j < w for w in WIDTHS for _ in range(FILTERS)] for j in range(3)])
        self.p = {
            "emb": rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
            "filt": (rng.normal(0, 0.5, (3, DIM, n)) * self.used[:, None, :]).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.3, n).astype(np.float32),
            "out_bias": np.full(1, -1.0, np.float32),
        }
        self.langs: list[str] = []
        self.lang_words = np.zeros((BUCKETS, 1), np.float32)
        self.shift = np.zeros(1)

    def _conv(self, e: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Filter outputs at each word; words beyond a text's end add nothing."""
        conv = e @ self.p["filt"][0]
        for j in (1, 2):
            if len(e) > j:
                more = e[j:] @ self.p["filt"][j]
                for i in range(1, j + 1):
                    ends = at[1:] - i
                    ends = ends[(ends >= 0) & (ends < len(more))]
                    more[ends] = 0
                conv[:-j] += more
        return conv

    def _embed(self, ids: np.ndarray) -> np.ndarray:
        e = self.p["emb"].take(ids[:, 0], axis=0)
        for k in range(1, ids.shape[1]):
            e += self.p["emb"].take(ids[:, k], axis=0)
        return e

    def _pooled(self, conv: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at) - 1, conv.shape[1]), np.float32)
        full = np.flatnonzero(np.diff(at) > 0)
        if len(full):
            out[full] = np.maximum.reduceat(conv, at[full], axis=0)
        return out

    def logits(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        pooled = self._pooled(self._conv(self._embed(ids), at), at) + self.p["bias"]
        return (np.maximum(pooled, 0) @ self.p["out"] + self.p["out_bias"]).astype(np.float64)

    def fit(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 11) -> "WordCnn":
        """texts: hashed words of each document."""
        rng = np.random.default_rng(seed)
        dense = Adam({k: v for k, v in self.p.items() if k != "emb"}, rate)
        scale = np.full((BUCKETS, 1), 1e-6, np.float32)  # Adagrad for the embeddings, which few rows of a step touch
        n = len(self.p["bias"])
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                mine = [texts[r] for r in rows]
                at = np.concatenate([[0], np.cumsum([len(t) for t in mine])])
                ids = np.concatenate(mine)
                if not len(ids):
                    continue
                e = self._embed(ids)
                conv = self._conv(e, at)
                pooled = self._pooled(conv, at)
                best = np.zeros((len(mine), n), np.int64)
                for r in range(len(mine)):
                    if at[r + 1] > at[r]:
                        best[r] = at[r] + conv[at[r] : at[r + 1]].argmax(axis=0)
                z = pooled + self.p["bias"]
                h = np.maximum(z, 0)
                g = (1 / (1 + np.exp(-np.clip(h @ self.p["out"] + self.p["out_bias"], -30, 30))) - y[rows]) / len(rows)
                back = np.outer(g, self.p["out"]) * (z > 0)
                filt = np.zeros_like(self.p["filt"])
                e_grad: list[tuple[np.ndarray, np.ndarray]] = []
                for j in range(3):
                    pos = best + j
                    ok = (pos < at[1:, None]) & self.used[j]
                    pos = np.minimum(pos, len(ids) - 1)
                    b = np.where(ok, back, 0)
                    filt[j] = np.einsum("rfd,rf->df", e[pos], b)
                    hit = np.flatnonzero(b.ravel())
                    e_grad.append((pos.ravel()[hit], b.ravel()[hit, None] * self.p["filt"][j].T[np.tile(np.arange(n), len(rows))[hit]]))
                where = np.concatenate([p for p, _ in e_grad])
                grad = np.concatenate([v for _, v in e_grad])
                if len(where):
                    keys = ids[where].ravel()
                    uniq, inv = np.unique(keys, return_inverse=True)
                    total = np.zeros((len(uniq), DIM), np.float32)
                    np.add.at(total, inv, np.repeat(grad, ids.shape[1], axis=0))
                    scale[uniq] += (total * total).mean(axis=1, keepdims=True)
                    self.p["emb"][uniq] -= 0.1 * total / np.sqrt(scale[uniq])
                dense.step({"filt": filt, "bias": back.sum(0), "out": h.T @ g, "out_bias": np.array([g.sum()])})
        return self

    def fit_langs(self, texts: list[np.ndarray], langs: list[str | None]) -> None:
        """Naive Bayes over hashed words: guesses a text's language from its words alone."""
        self.langs = sorted({x for x in langs if x is not None}) or ["?"]
        counts = np.full((BUCKETS, len(self.langs)), 0.1)
        for t, lang in zip(texts, langs):
            if lang is not None:
                np.add.at(counts[:, self.langs.index(lang)], t[:, 0], 1)
        self.lang_words = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def guess(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        run = np.concatenate([np.zeros((1, self.lang_words.shape[1])), np.cumsum(self.lang_words.take(ids[:, 0], axis=0), axis=0, dtype=np.float64)])
        return (run[at[1:]] - run[at[:-1]]).argmax(axis=1)

    def calibrate(self, counts: np.ndarray) -> None:
        """For each language, the logit that splits the classes best (F1), in the middle of its gap.

        counts: documents by language, class and bin of the logit. Those of all languages weigh as POOLED toxic ones beside each language's own.
        """

        def split(counts: np.ndarray) -> float:
            full = np.flatnonzero(counts.sum(axis=0))[::-1]
            taken, hit = counts.sum(axis=0)[full].cumsum(), counts[1, full].cumsum()
            k = int((2 * hit / (taken + counts[1].sum())).argmax())
            low = full[k + 1] + 1 if k + 1 < len(full) else full[k]
            return float((full[k] + low) / 2 / BINS - REACH)

        both = counts.sum(axis=0)
        toxic = both[1].sum()
        self.shift = np.array([split(c + both * (POOLED / toxic)) if toxic else 0.0 for c in counts])

    def scores(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.logits(ids, at) - self.shift[self.guess(ids, at)] + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _histograms(docs: DataFrame, marks: DataFrame, model: WordCnn, others: list[WordCnn]) -> np.ndarray:
    """Labelled documents by guessed language, class and bin of the logit that the network fitted without their fold gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, n = batch.column("fold").to_numpy(), batch.num_rows
            lang, bins = np.zeros(n, np.int32), np.zeros(n, np.int32)
            for lo, hi, data, at in pieces(batch.column("text"), 1 << 20):
                ids, to = hashed_words(data, at)
                lang[lo:hi] = model.guess(ids, to)
                for k in np.unique(fold[lo:hi]):
                    rows = np.flatnonzero(fold[lo:hi] == k)
                    mine = np.concatenate([ids[to[i] : to[i + 1]] for i in rows])
                    z = others[k].logits(mine, np.concatenate([[0], np.cumsum(to[rows + 1] - to[rows])]))
                    bins[lo + rows] = np.clip((z + REACH) * BINS, 0, 2 * REACH * BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(bins)], names=["doc_id", "guess", "bin"])

    got = docs.where("doc_id IS NOT NULL").select("doc_id", _fold().alias("fold"), F.col("text").cast("binary").alias("text"))
    got = got.mapInArrow(run, "doc_id long, guess int, bin int").join(marks, "doc_id")
    out = np.zeros((max(1, len(model.langs)), 2, 2 * REACH * BINS))
    for r in got.groupBy("guess", "toxic", "bin").count().collect():  # a row for each bin at most
        out[r.guess, int(r.toxic > 0), r.bin] += r["count"]
    return out


def _fold() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(CAL_FOLDS)).cast("int")


def _words_of(docs: DataFrame) -> DataFrame:
    """Hashed words of whole texts as bytes, for the training sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for _, _, data, at in pieces(batch.column("text")):
                ids, to = hashed_words(data, at)
                got += [ids[a:b].astype(np.uint16).tobytes() for a, b in zip(to, to[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("toxic"), batch.column("fold"), pa.array(got, pa.binary())], names=["doc_id", "lang", "toxic", "fold", "ids"])

    return docs.select("doc_id", "lang", "toxic", _fold().alias("fold"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, lang string, toxic int, fold int, ids binary")


def train(docs: DataFrame, labels: DataFrame, seed: int = 11) -> WordCnn | None:
    """Fits on a bounded, reproducible sample of the labelled documents given and calibrates on all of them.

    A document labelled both ways counts as toxic. None when either class is missing among the documents.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    parts = 1_000_000
    share = F.when(F.col("toxic") == 1, min(parts, TRAIN_DOCS // 2 * parts // n[1])).otherwise(min(parts, TRAIN_DOCS // 2 * parts // n[0]))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts)) < share)
    drawn = C.broadcast_if_small(drawn, TRAIN_DOCS, 40)
    rows = _words_of(docs.join(drawn, "doc_id")).collect()  # TRAIN_DOCS rows or a little over
    if len({r.toxic for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.ids))
    texts = [np.frombuffer(r.ids, np.uint16).reshape(-1, 1 + len(PREFIXES)).astype(np.int32) for r in rows]
    y = np.array([r.toxic for r in rows], np.float64)
    model = WordCnn(seed).fit(texts, y, seed=seed)
    model.fit_langs(texts, [r.lang for r in rows])
    fold = np.array([r.fold for r in rows])
    others = []
    for k in range(CAL_FOLDS):
        rest = np.flatnonzero(fold != k)
        others.append(WordCnn(seed).fit([texts[i] for i in rest], y[rest], seed=seed))
    model.calibrate(_histograms(docs, marks, model, others))
    return model


def score(docs: DataFrame, labels: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Labels are learned only from rows outside the held-out fold (crc32 of the id
    as text; a null id counts as an empty text and has no label). Null, empty and
    wordless texts get the score of a text without words; null labels are not
    learned; with no label of either class every score is 0. Repeated rows are
    each scored; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "lang")
    held = C.crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT
    model = train(docs.where(~held), labels.where(~held), seed)
    inner = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    if model is None:
        return inner.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.scores(*hashed_words(data, at)) for _, _, data, at in pieces(batch.column("text"), 1 << 20)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return inner.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
