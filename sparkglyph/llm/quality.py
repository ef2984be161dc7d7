"""Host-level quality rules, in DataFrame functions only.

Every document gets counts and rule failures; failures are added up by host,
the hosts' failure rates are shrunk towards an empirical beta prior, and the
verdict on each host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def measures(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of every whole text.

    Null and blank texts count 0 throughout. Rows are neither merged nor dropped.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select("doc_id", F.col(host_col).alias("host"), text.alias("text"), C.words(F.col("text")).alias("w"))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(C.NOT_WS_CLASS))
    second = first.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.instr("text", "\n") > 0, lines).alias("lines"),
        F.when(F.size("w") > WINDOW, F.transform("w", lambda x: F.xxhash64(x))).alias("wh"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("wh") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("wh", i, WINDOW)))
    third = second.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols",
        F.coalesce(F.size("lines"), F.when(F.col("n_words") > 0, 1).otherwise(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.when(F.col("wh").isNotNull(), windows).alias("win"),
    )
    pairs = F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    fourth = third.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.size(F.array_distinct("win")) < F.size("win"), pairs).alias("s"),
    )
    return fourth.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        # windows that stand twice or more, by position; then the words they cover
        F.expr(f"""
            coalesce(aggregate(
                array_sort(transform(
                    filter(s, (x, j) -> (j > 0 AND s[greatest(j - 1, 0)].h = x.h)
                                     OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = x.h)),
                    x -> x.p)),
                named_struct('last', CAST(-{WINDOW} AS INT), 'n', 0L),
                (a, p) -> named_struct('last', p, 'n', a.n + least({WINDOW}, p - a.last)),
                a -> a.n), 0L)""").alias("n_repeat_words"),
    )


def host_quality(
    docs: DataFrame, host_col: str = "source", min_words: int = 20, max_repeat_pct: int = 30, max_host_rate: float = 0.5
) -> DataFrame:
    """Counts, rule results and the verdict of every document.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_pct``
    percent of them in repeated windows. A document also fails a rule of its host
    when over a third of its lines repeat earlier ones, or symbols outnumber
    words. A host whose shrunk failure rate exceeds ``max_host_rate`` loses all
    its documents; one whose rate exceeds the prior's mean loses those that fail
    any rule; on other hosts only base failures go.

    Documents without a host are judged by the base rules alone (host_rate null). Null or empty
    texts have 0 words and fail; repeated rows are judged and returned each;
    an empty table gives an empty result; other columns are ignored.
    """
    m = C.materialize(measures(docs, host_col), "quality")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    fails = base | (F.col("n_symbols") > F.col("n_words")) | (3 * F.col("n_dup_lines") > F.col("n_lines"))
    m = m.withColumns({"base_failed": base, "rule_failed": fails})
    hosts = m.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("f")
    )
    hosts = C.materialize(hosts, "quality-hosts")
    # method of moments over hosts: mean rate, and variance beyond what binomial counts explain
    t = hosts.agg(
        F.count("*").alias("h"), F.sum("n").alias("n"), F.sum("f").alias("f"),
        F.sum(F.col("f") * F.col("f") / F.col("n")).alias("q"),
    ).first()
    mean = (t.f / t.n) if t.n else 0.0
    spread = max(((t.q / t.n) - mean * mean) - mean * (1 - mean) * t.h / t.n, 1e-6) if t.n else 1.0
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)
    rate = (F.col("f") + mean * strength) / (F.col("n") + strength)
    # shrinking never moves a rate across the prior's mean, so the side it lies on is told by whole numbers
    doubtful = F.col("f").cast("decimal(38,0)") * F.lit(t.n or 0) > F.col("n").cast("decimal(38,0)") * F.lit(t.f or 0)
    verdicts = C.broadcast_if_small(hosts.select("host", rate.alias("host_rate"), doubtful.alias("doubtful")), t.h, 200)
    rejected = F.coalesce("host_rate", F.lit(0.0)) > max_host_rate
    return m.join(verdicts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected & ~(F.col("rule_failed") & F.coalesce("doubtful", F.lit(False)))).alias("kept"),
    )


def oracle_sql() -> str:
    """The same in DuckDB's SQL, for the defaults of ``host_quality``."""
    return r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
    win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s
            FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
    rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
    cov AS (SELECT r, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY r),
    ln AS (SELECT r, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) - count(DISTINCT l) AS BIGINT) AS n
           FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
           WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
    m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
                 CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                 coalesce(ln.n, 0) AS n_dup_lines, coalesce(ln.lines, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
          FROM d JOIN w USING (r) LEFT JOIN ln USING (r) LEFT JOIN cov USING (r)),
    f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                 n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols > n_words
                 OR 3 * n_dup_lines > n_lines AS rule_failed FROM m),
    hosts AS (SELECT host, count(*) AS n, sum(CAST(rule_failed AS BIGINT)) AS f FROM f WHERE host IS NOT NULL GROUP BY host),
    t AS (SELECT count(*) AS h, sum(n) AS n, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS q FROM hosts),
    k AS (SELECT mean, least(greatest(mean * (1 - mean)
                 / greatest(q - mean * mean - mean * (1 - mean) * h / n, 1e-6) - 1, 1.0), 1e6) AS s FROM t),
    v AS (SELECT host, (f + mean * s) / (n + s) AS rate, f * (SELECT sum(n) FROM hosts) > n * (SELECT sum(f) FROM hosts) AS doubtful FROM hosts, k)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce(rate, 0) <= 0.5 AND NOT (rule_failed AND coalesce(doubtful, false)) AS kept
    FROM f LEFT JOIN v USING (host)
    """
