"""Language ID by a byte convolutional network trained in numpy.

Filters of widths 2, 3 and 4 slide over the bytes of a text, are max-pooled over
fixed-length windows and feed a softmax over the languages; a document's
languages share its bytes as its windows say. The windows cover the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .flat import Adam, give_back, pieces, softmax

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 256
#: Bounds of the sample that the network is fitted on: documents a language, documents in all, windows a document.
DOCS_PER_LANG, DOCS_IN_ALL, WINDOWS_PER_DOC = 600, 12_000, 5
FOLDS, HELD_OUT = 4, 2


def _shifted(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The byte at each position and the three after it, 0 beyond the end of its text."""
    out = [data]
    for k in (1, 2, 3):
        b = np.zeros_like(data)
        b[:-k] = data[k:]
        for j in range(1, k + 1):
            at = ends - j
            b[at[at >= 0]] = 0
        out.append(b)
    return out


class ByteCnn:
    """Filters as byte tables: table j holds what the byte at distance j adds to each filter."""

    def __init__(self, langs: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        n = FILTERS * len(WIDTHS)
        self.used = np.array([[j < w for w in WIDTHS for _ in range(FILTERS)] for j in range(max(WIDTHS))])
        self.p = {
            "table": (rng.normal(0, 0.3, (4, 256, n)) * self.used[:, None, :]).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.3, (n, len(langs))).astype(np.float32),
            "out_bias": np.zeros(len(langs), np.float32),
        }

    def fit(self, windows: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 7) -> "ByteCnn":
        """windows: (n, WINDOW) bytes, 0 beyond a text's end."""
        rng = np.random.default_rng(seed)
        adam = Adam(self.p, rate)
        n = len(self.p["bias"])
        x = np.concatenate([windows, np.zeros((len(windows), 3), np.uint8)], axis=1)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                rows = order[i : i + batch]
                b, b_y = x[rows], y[rows]
                conv = sum(self.p["table"][j][b[:, j : j + WINDOW]] for j in range(4))
                best = conv.argmax(axis=1)  # (batch, filters)
                pooled = np.take_along_axis(conv, best[:, None, :], axis=1)[:, 0] + self.p["bias"]
                h = np.maximum(pooled, 0)
                g = softmax(h @ self.p["out"] + self.p["out_bias"])
                g[np.arange(len(rows)), b_y] -= 1
                g /= len(rows)
                back = (g @ self.p["out"].T) * (pooled > 0)
                table = np.zeros_like(self.p["table"])
                cols = np.broadcast_to(np.arange(n), best.shape)
                for j in range(4):
                    np.add.at(table[j], (np.take_along_axis(b, best + j, axis=1), cols), back * self.used[j])
                adam.step({"table": table, "bias": back.sum(0), "out": h.T @ g, "out_bias": g.sum(0)})
        return self

    def prepare(self) -> None:
        """Tables over pairs of bytes, so that scoring takes two lookups a position."""
        t = self.p["table"]
        self.pair = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in (0, 2)]

    def shares(self, data: np.ndarray, at: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
        """Share of each language in each text, from bytes and offsets; zeros for empty texts."""
        lengths = np.diff(at)
        b0, b1, b2, b3 = _shifted(data, at[1:])
        i01 = b0.astype(np.int32) * 256 + b1
        i23 = b2.astype(np.int32) * 256 + b3
        count = -(-lengths // WINDOW)
        doc = np.repeat(np.arange(len(lengths)), count)
        first = np.cumsum(count) - count
        start = at[doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
        stop = np.append(start[1:], len(data))
        total = np.zeros((len(lengths), len(self.langs)))
        i = 0
        while i < len(start):
            k = max(i + 1, int(np.searchsorted(stop, start[i] + chunk, side="right")))
            lo, hi = start[i], stop[k - 1]
            conv = self.pair[0].take(i01[lo:hi], axis=0)
            conv += self.pair[1].take(i23[lo:hi], axis=0)
            h = np.maximum(np.maximum.reduceat(conv, start[i:k] - lo, axis=0) + self.p["bias"], 0)
            p = softmax(h @ self.p["out"] + self.p["out_bias"])
            np.add.at(total, doc[i:k], p * (stop[i:k] - start[i:k])[:, None])
            i = k
        return total / np.maximum(lengths, 1)[:, None]


def train(docs: DataFrame, learnable, seed: int = 7) -> ByteCnn | None:
    """Fits the network on windows of a bounded, reproducible sample of the ``learnable`` labelled documents.

    The sample is balanced: about DOCS_PER_LANG documents of each language,
    fewer when there are over DOCS_IN_ALL / DOCS_PER_LANG languages. None when
    there is nothing to learn from.
    """
    good = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in good.groupBy("lang").count().collect()}
    if not counts:
        return None
    want = min(DOCS_PER_LANG, max(1, DOCS_IN_ALL // len(counts)))
    parts = 1_000_000
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(parts, -(-want * parts // n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts))
    steps = F.greatest(F.lit(1), F.floor(F.length("text") / WINDOWS_PER_DOC))
    cut = F.array(*(F.substring("text", (steps * k + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_PER_DOC)))
    rows = good.where(draw < share).select("lang", "doc_id", F.filter(cut, lambda x: x.rlike(r"\p{L}")).alias("cut")).collect()  # DOCS_IN_ALL rows or a little over
    rows.sort(key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0, r.cut))
    langs = sorted(counts)
    got = [(x.encode()[:WINDOW], langs.index(r.lang)) for r in rows for x in r.cut]
    windows = np.zeros((len(got), WINDOW), np.uint8)
    for i, (x, _) in enumerate(got):
        windows[i, : len(x)] = np.frombuffer(x, np.uint8)
    return ByteCnn(langs, seed).fit(windows, np.array([y for _, y in got], np.int64), seed=seed)


def predict(docs: DataFrame, model: ByteCnn | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus lang_pred and score; keep must not hold these names.

    A text column that is kept goes to Python once.

    Texts that are null or have no letter get `und` with score 0; so do all when
    there is no model.
    """
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    source = text if text in keep else "__bytes"
    own = [] if text in keep else [F.col(text).cast("binary").alias("__bytes")]
    inner = docs.select(*keep, *own, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = inner.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.prepare()
        for batch in batches:
            shares = [model.shares(data, at) for _, _, data, at in pieces(batch.column(source))]
            p = np.concatenate(shares) if shares else np.zeros((0, len(model.langs)))
            letter = batch.column("__letter").to_numpy(zero_copy_only=False).astype(bool)
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            langs = np.array([*model.langs, "und"], object)[np.where(letter, best, len(model.langs))]
            score = np.where(letter, p.max(axis=1) if len(p) else 0, 0.0).clip(0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])
            del batch
            give_back()

    return inner.mapInArrow(run, schema)


def identify(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Learns only from rows outside the held-out fold (crc32 of the id as text; a
    null id counts as an empty text). Null languages are not learned; null,
    empty and letterless texts are `und`; repeated rows are each predicted; an
    empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "lang")
    held = C.crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT
    model = train(docs, ~held, seed)
    return predict(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
