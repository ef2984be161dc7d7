"""From text and permissions to indexed features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from . import association as A
from .scratch import running

PAD, UNK = 0, 1


def icon_shape(img: Column, least: int, ratio: float) -> Column:
    """FLT-07: an image that is there, large enough, and not too narrow."""
    w, h = img["w"], img["h"]
    return img.isNotNull() & (w >= least) & (h >= least) & (w / h <= ratio) & (h / w <= ratio)


def ocr_guard(img: Column, texts: Column, ratio: float = 10) -> Column:
    """FLT-08: no texts for images that are missing or too narrow."""
    return F.when(icon_shape(img, 1, ratio), texts).otherwise(F.array().cast("array<string>"))


def text_tokens(texts: Column, stop: list[str]) -> Column:
    """SF-07: letters, tokens of two letters or more, stop words out, lower case."""
    return X.drop_short(X.drop_stop_words(X.tokenize(F.array_join(texts, " ")), stop), 1)


def concat_texts(*tokens: Column) -> Column:
    """SET-03: bag union, order kept."""
    return F.concat(*tokens)


def raw_vocabulary(rows: DataFrame, tokens: str) -> DataFrame:
    """AGG-07: distinct tokens."""
    return rows.select(F.explode(tokens).alias("token")).distinct()


def vocabulary(rows: DataFrame, key: str, tokens: str, min_support: int) -> DataFrame:
    """AGG-06, WIN-05: (token, id): tokens that occur more often than ``min_support``, numbered from 2 in the order first seen.

    Only the vocabulary itself is sorted, not the occurrences, and in ranges.
    """
    seen = rows.select(key, F.posexplode(tokens).alias("pos", "token"))
    counts = seen.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(key, "pos")).alias("first")).where(F.col("n") > min_support)
    ranked = running(counts.select("token", "first"), [], ["first"], {"id": F.lit(1)})
    return ranked.select("token", (F.col("id") + 2).cast("int").alias("id"))


def index_tokens(rows: DataFrame, key: str, tokens: str, vocab: DataFrame) -> DataFrame:
    """JN-08: token ids in order, unknown ones as UNK."""
    seen = rows.select(key, F.posexplode_outer(tokens).alias("pos", "token"))
    ids = seen.join(vocab, "token", "left")
    pairs = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK)).alias("id"))))
    return ids.groupBy(key).agg(F.transform(F.array_sort(pairs), lambda x: x["id"]).alias("ids"))


def label_ids(names: Column) -> Column:
    """WIN-06: labels by their place."""
    return F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("id")))


def encode_labels(labels: Column, names: list[str]) -> Column:
    """Names to sorted ids; names that are not labels are dropped."""
    at = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return F.array_sort(F.filter(F.transform(labels, lambda x: F.try_element_at(at, x)), lambda i: i.isNotNull()))


def split_exact(rows: DataFrame, key: str, ratios: dict[str, float], seed: int = 0) -> DataFrame:
    """SRT-04, SF-26: parts of exactly floor(n * ratio) rows in a seeded order; the last takes the rest.

    Rows get their rank from counts of ranges of the order and a sort within each
    range; there are as many ranges as shuffle partitions.
    """
    total = sum(ratios.values())
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    rows = running(rows.withColumn("__h", h), [], ["__h", key], {"__rank": F.lit(1)})
    rows = rows.withColumn("__n", F.lit(rows.count()))
    part, at = F.lit(list(ratios)[-1]), 0.0
    edges = []
    for name, ratio in list(ratios.items())[:-1]:
        edges.append((name, ratio / total))
    out, low = part, F.lit(0)
    for name, ratio in edges:
        high = low + F.floor(F.col("__n") * F.lit(ratio))
        out = F.when((F.col("__rank") >= low) & (F.col("__rank") < high), name).otherwise(out)
        low = high
    return rows.withColumn("part", out).drop("__h", "__n", "__rank")


def preprocess(rows: DataFrame, key: str, stop: list[str], min_support: int, length: int, least: int = 5, ratio: float = 10) -> tuple[DataFrame, DataFrame]:
    """ML-01: raw triples (key, img, layout_texts, embedded_texts, resource_texts, permissions) to (key, img, tokens, labels), and the vocabulary.

    Labels are permission groups; rows without one, or with an unfit image, go.
    """
    rows = A.sensitive(rows).where(icon_shape(F.col("img"), least, ratio))
    texts = [text_tokens(F.col(c), stop) for c in ("layout_texts", "embedded_texts")]
    words = F.transform(F.flatten(F.transform("resource_texts", X.name_words)), F.lower)
    rows = rows.withColumn("tokens", concat_texts(*texts, X.drop_short(words, 2)))
    vocab = vocabulary(rows, key, "tokens", min_support)
    ids = index_tokens(rows, key, "tokens", vocab)
    out = rows.drop("tokens").join(ids, key).select(key, "img", V.pad(F.col("ids"), length).alias("tokens"), encode_labels(F.col("permissions"), list(A.GROUPS)).alias("labels"))
    return out, vocab
