"""Text functions. Column expressions wherever SQL can say it; stemming and spelling run over distinct tokens only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAMEL = r"(?<=\p{javaLowerCase})(?=\p{javaUpperCase})"
#: Contractions that a word tokenizer takes apart even without apostrophes: fixed values.
CONTRACTIONS = {"cannot": ["can", "not"], "gimme": ["gim", "me"], "gonna": ["gon", "na"], "gotta": ["got", "ta"], "lemme": ["lem", "me"], "wanna": ["wan", "na"]}


def split_underscore(x: Column) -> Column:
    """SF-01."""
    return F.split(x, "_")


def split_camel(x: Column) -> Column:
    """SF-02: at switches from lower to upper case."""
    return F.split(x, CAMEL)


def name_words(x: Column) -> Column:
    """SF-03: words of a resource name."""
    return F.flatten(F.transform(split_underscore(x), split_camel))


def letters_only(x: Column) -> Column:
    """SF-04: everything but letters becomes a space."""
    return F.regexp_replace(x, r"[^\p{L}]", " ")


def tokenize(x: Column) -> Column:
    """SF-05: tokens of the letters of a text, contractions taken apart."""
    raw = F.filter(F.split(x, r"\P{L}+"), lambda t: t != "")
    table = F.create_map(*[v for k, ws in CONTRACTIONS.items() for v in (F.lit(k), F.array(*map(F.lit, ws)))])
    apart = F.flatten(F.transform(raw, lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), F.array(t))))
    return F.when(x.rlike(f"(?i)({'|'.join(CONTRACTIONS)})"), apart).otherwise(raw)


def drop_short(tokens: Column, threshold: int) -> Column:
    """FLT-10: tokens longer than the threshold."""
    return F.filter(tokens, lambda t: F.length(t) > threshold)


def only_short(tokens: Column, threshold: int) -> Column:
    """FLT-10: the removed side."""
    return F.filter(tokens, lambda t: F.length(t) <= threshold)


def drop_stop_words(tokens: Column, stop: list[str]) -> Column:
    """FLT-11: stop words go by their exact form, then the rest is lower-cased, so capitalised stop words stay."""
    words = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    return F.transform(F.filter(tokens, lambda t: ~F.array_contains(words, t)), F.lower)


def language(x: Column) -> Column:
    """SF-16, SF-17: null without letters, then chinese, japanese, korean, english by the scripts seen, in this order."""
    return (
        F.when(~x.rlike(r"\p{L}"), None)
        .when(x.rlike(r"[一-鿿]"), "chinese")
        .when(x.rlike(r"[ࠀ-一]"), "japanese")
        .when(x.rlike(r"[가-힣]"), "korean")
        .when(x.isNotNull(), "english")
    )


def ascii_only(x: Column) -> Column:
    """SF-16: no letter beyond ASCII."""
    return ~x.rlike(r"[\p{L}&&[^\x00-\x7f]]")


def translate(rows: DataFrame, column: str, translator: Callable[[str], str | None] | None = None) -> DataFrame:
    """SF-18, EXT-06: translates distinct non-ASCII texts by a plug-in and joins them back, lower-cased.

    ASCII texts pass. Results in capitals alone or still beyond ASCII are null.
    Without a translator other texts stay as they are.
    """
    if translator is None:
        return rows
    todo = rows.where(~ascii_only(F.col(column))).select(F.col(column).alias("__text")).distinct()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(translator)

    got = todo.withColumn("__got", run("__text"))
    ok = ascii_only(F.col("__got")) & (F.col("__got") != F.upper("__got"))
    out = rows.join(got, rows[column] == got["__text"], "left")
    new = F.when(F.col("__text").isNull(), F.col(column)).when(ok, F.lower("__got"))
    return out.select(*(new.alias(c) if c == column else F.col(c) for c in rows.columns))


_VOWEL = "aeiou"


def _cons(w: str, i: int) -> bool:
    return w[i] not in _VOWEL and not (w[i] == "y" and i > 0 and _cons(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1) and w[-1] not in "wxy"


#: Suffix rules of the published Porter algorithm, steps 2 to 4: fixed values.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(word: str) -> str:
    """SF-06: the published Porter stemmer, on lower-case words; words of one or two letters stay."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and _has_vowel(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        s = max((s for s in rules if w.endswith(s)), key=len, default=None)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    s = max((s for s in STEP4 if w.endswith(s)), key=len, default=None)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)][-1:] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _double(w) and w[-1] == "l" and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_tokens(tokens: Column) -> Column:
    """SF-06, SF-07: stems of an array of tokens, in Arrow batches, each distinct token of a batch once."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for s in batches:
            if len(known) > 200_000:
                known.clear()
            out = []
            for row in s:
                for t in row if row is not None else ():
                    if t not in known:
                        known[t] = porter(t)
                out.append(None if row is None else [known[t] for t in row])
            yield pd.Series(out)

    return F.pandas_udf(run, "array<string>")(tokens)


def correct_spelling(tokens: DataFrame, vocabulary: DataFrame, distance: int = 2) -> DataFrame:
    """SF-08: (token, corrected) of distinct tokens: itself if known, else the most frequent known word within the distance.

    Ties go to the nearer, then to the first by name; without candidates the
    token stays. vocabulary: (word, freq). Candidates share a deletion variant
    of up to ``distance`` letters (symmetric deletes), so tokens and words meet in
    an equi-join instead of a comparison of all pairs.
    """
    variants = _deletions(distance)
    known = vocabulary.groupBy("word").agg(F.sum("freq").alias("freq"))
    tokens = tokens.select("token").distinct()
    unknown = tokens.join(known.withColumnRenamed("word", "token"), "token", "left_anti")
    a = unknown.select("token", F.explode(variants("token")).alias("v"))
    b = known.select("word", "freq", F.explode(variants("word")).alias("v"))
    pairs = a.join(b, "v").select("token", "word", "freq").distinct().withColumn("d", F.levenshtein("token", "word", distance)).where(F.col("d").between(0, distance))
    best = pairs.groupBy("token").agg(F.min_by("word", F.struct(-F.col("freq"), F.col("d"), F.col("word"))).alias("best"))
    return tokens.join(best, "token", "left").select("token", F.coalesce("best", "token").alias("corrected"))


def _deletions(distance: int):
    def of(word: str) -> list[str]:
        out = level = {word}
        for _ in range(distance):
            level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
            out = out | level
        return sorted(out)

    def run(s: pd.Series) -> pd.Series:
        return s.map(of)

    return F.pandas_udf(run, "array<string>")
