"""Secret scans in DataFrame functions only.

Three kinds of spans follow fixed patterns (assign, access, hex). A battery of
randomness tests finds further spans (random). For every long token the encoding
is inferred (the smallest alphabet that holds its symbols), and three statistics
are taken: chi-squared of the alphabet's uniformity, runs of character classes,
and the serial correlation of symbol values.

A token is a discovery when the three together are not what ordinary text would
show: their one-sided p-values under text are combined by Fisher's method, and
Benjamini-Hochberg holds the share of false discoveries within each class of
length. What text shows is measured on all tokens of the corpus just too short
to be tested (NEAR to LEAST - 1 symbols). Tokens that the battery rejects as
random in their own alphabet (repetitions, counting, paths) are no discoveries.

Random letters of one case have no runs to tell them from words; they are found
only where they are very long.

All positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# greedy runs: a run that is too short can hold no longer match, so the least length may stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens tested have LEAST symbols; those from NEAR on show what text looks like.
NEAR, LEAST = 16, 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{NEAR},}}={{0,2}}"
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}

#: Symbols by value in each encoding; single-case ones are read in the case given.
ALPHABETS = {
    16: "0123456789abcdef",
    26: "abcdefghijklmnopqrstuvwxyz",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    36: "0123456789abcdefghijklmnopqrstuvwxyz",
    62: "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: What text is taken to show before any is seen, and the tokens that this counts as: chances that two and that three
#: of a token's symbols agree, that neighbours differ in character class, and the variance of the serial correlation.
PRIOR = {"pair": 0.065, "triple": 0.0060, "switch": 0.05, "serial": 0.0, "serial_sq": 0.06}
PRIOR_TOKENS = 20
#: p-value below which a test rejects a token as random in its alphabet.
PATTERNED = 1e-4
BLOCK = 128
#: Width of the bins of Fisher's statistic.
BIN = 0.5


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds m_<kind>: all matches as arrays of (s, e, x, v); v is the second group for assign.

    Starts are prefix sums over the gaps and matches before, in blocks, so the
    work stays linear in the number of matches.
    """
    df = df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("t"))
    df = df.selectExpr(*keep, "t", *(f"split(t, {_q(p)}, -1) AS g_{k}" for k, p in PATTERNS.items()))
    df = df.selectExpr(
        *keep, "t",
        *(f"g_{k}" for k in KINDS),
        *(f"CASE WHEN size(g_{k}) > 1 THEN regexp_extract_all(t, {_q(p)}, 0) ELSE CAST(array() AS array<string>) END AS h_{k}" for k, p in PATTERNS.items()),
        f"CASE WHEN size(g_assign) > 1 THEN regexp_extract_all(t, {_q(ASSIGN)}, 2) ELSE CAST(array() AS array<string>) END AS v_assign",
    )
    cols = [*keep, "t", "v_assign"]
    step = [f"transform(h_{k}, (x, i) -> CAST(length(g_{k}[i]) + length(x) AS BIGINT)) AS l_{k}" for k in KINDS]
    df = df.selectExpr(*cols, *(f"g_{k}" for k in KINDS), *(f"h_{k}" for k in KINDS), *step)
    block = [
        f"CASE WHEN size(l_{k}) = 0 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, (size(l_{k}) - 1) div {BLOCK}),"
        f" j -> aggregate(slice(l_{k}, CAST(j * {BLOCK} + 1 AS INT), {BLOCK}), 0L, (a, x) -> a + x)) END AS b_{k}"
        for k in KINDS
    ]
    carry = [*cols, *(f"{c}_{k}" for c in "ghl" for k in KINDS)]
    df = df.selectExpr(*carry, *block)
    df = df.selectExpr(
        *carry, *(f"CASE WHEN size(b_{k}) = 0 THEN b_{k} ELSE transform(b_{k}, (x, j) -> aggregate(slice(b_{k}, 1, j), 0L, (a, y) -> a + y)) END AS p_{k}" for k in KINDS)
    )
    start = (
        "p_{k}[CAST(i div %d AS INT)] + aggregate(slice(l_{k}, CAST((i div %d) * %d + 1 AS INT), CAST(i %% %d AS INT)), 0L, (a, y) -> a + y)"
        " + length(g_{k}[i])" % (BLOCK, BLOCK, BLOCK, BLOCK)
    )
    made = [
        f"CASE WHEN size(p_{k}) = 0 THEN NULL ELSE transform(transform(h_{k}, (x, i) -> named_struct('s', {start.format(k=k)}, 'x', x,"
        f" 'v', {'v_assign[i]' if k == 'assign' else 'x'})), m -> named_struct('s', m.s, 'e', m.s + length(m.x), 'x', m.x, 'v', m.v)) END AS m_{k}"
        for k in KINDS
    ]
    return df.selectExpr(*keep, "t", *made)


def _battery(df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds base (spans of the fixed kinds) and tests: the statistics of each token that overlaps none of them.

    n: symbols. pair, triple: ordered pairs and triples of equal symbols.
    switch: neighbours of different character class. serial: correlation of
    neighbours' values. uniform, runs, lag: z of the three tests under
    randomness in the token's alphabet.
    """
    base = [f"transform(coalesce(m_{k}, array()), m -> named_struct('s', m.s, 'e', m.e, 'k', {i}, 'v', m.v))" for i, k in enumerate(KINDS[:3])]
    df = df.selectExpr(*keep, "t", f"filter(concat({', '.join(base)}), m -> m.k > 0 OR length(m.v) >= 6) AS base", "m_random")
    tok = "translate(m.x, '-_=', '+/')"
    one_case = f"({tok} = lower({tok}) OR {tok} = upper({tok}))"
    k = f"""CASE WHEN {one_case} AND {tok} RLIKE '^[0-9a-fA-F]+$' THEN 16 WHEN {one_case} AND {tok} RLIKE '^[a-zA-Z]+$' THEN 26
        WHEN {tok} RLIKE '^[A-Z2-7]+$' THEN 32 WHEN {one_case} AND {tok} RLIKE '^[a-zA-Z0-9]+$' THEN 36
        WHEN {tok} RLIKE '^[a-zA-Z0-9]+$' THEN 62 ELSE 64 END"""
    df = df.selectExpr(
        *keep, "t", "base",
        f"""CASE WHEN m_random IS NULL THEN NULL ELSE
            transform(filter(m_random, m -> NOT exists(base, b -> b.s < m.e AND m.s < b.e)),
                m -> named_struct('s', m.s, 'e', m.e, 'x', {tok}, 'k', {k})) END AS c""",
    )
    sym = "CASE m.k " + " ".join(f"WHEN {n} THEN '{a}'" for n, a in ALPHABETS.items()) + " END"
    df = df.selectExpr(
        *keep, "t", "base",
        f"""transform(c, m -> named_struct('s', m.s, 'e', m.e, 'k', m.k, 'n', CAST(length(m.x) AS DOUBLE),
            'v', transform(split(if(m.k IN (16, 26, 36), lower(m.x), m.x), ''), y -> CAST(locate(y, {sym}) AS DOUBLE)),
            'c', transform(split(m.x, ''), y -> CASE WHEN y BETWEEN 'a' AND 'z' THEN 1 WHEN y BETWEEN 'A' AND 'Z' THEN 2 ELSE 3 END),
            'f', transform(array_distinct(split(m.x, '')), y -> CAST(length(m.x) - length(replace(m.x, y, '')) AS DOUBLE)))) AS c""",
    )
    df = df.selectExpr(
        *keep, "t", "base",
        """transform(c, m -> named_struct('s', m.s, 'e', m.e, 'k', m.k, 'n', m.n,
            'pair', aggregate(m.f, 0D, (a, y) -> a + y * (y - 1)),
            'triple', aggregate(m.f, 0D, (a, y) -> a + y * (y - 1) * (y - 2)),
            'mean', aggregate(m.v, 0D, (a, y) -> a + y) / m.n,
            'sq', aggregate(m.v, 0D, (a, y) -> a + y * y),
            'up', aggregate(m.v, 0D, (a, y) -> a + if(y > m.k / 2, 1D, 0D)),
            'pairs', aggregate(m.v, named_struct('prev', CAST(NULL AS DOUBLE), 'runs', 1D, 'lag', 0D),
                (a, y) -> named_struct('prev', y, 'runs', a.runs + if(a.prev IS NOT NULL AND (a.prev > m.k / 2) != (y > m.k / 2), 1D, 0D),
                                       'lag', a.lag + coalesce(a.prev * y, 0D))),
            'ends', m.v[0] + m.v[size(m.v) - 1],
            'switch', aggregate(m.c, named_struct('prev', 0, 'n', 0D),
                (a, y) -> named_struct('prev', y, 'n', a.n + if(a.prev NOT IN (0, y), 1D, 0D))).n)) AS c""",
    )
    uniform = "((m.k / m.n * (m.pair + m.n) - m.n - (m.k - 1)) / sqrt(2 * (m.k - 1) * (m.n - 1) / m.n))"
    ups = "(2 * m.up * (m.n - m.up))"
    runs = f"coalesce((m.pairs.runs - {ups} / m.n - 1) / nullif(sqrt(greatest({ups} * ({ups} - m.n) / (m.n * m.n * (m.n - 1)), 0)), 0), 9D)"
    # sum of (v_i - mean)(v_i+1 - mean) over neighbours, over the sum of squares
    serial = "coalesce((m.pairs.lag - m.mean * (2 * m.n * m.mean - m.ends) + (m.n - 1) * m.mean * m.mean) / nullif(m.sq - m.n * m.mean * m.mean, 0), 1D)"
    return df.selectExpr(
        *keep, "t", "base",
        f"""transform(coalesce(c, array()), m -> named_struct('s', m.s, 'e', m.e, 'n', m.n, 'pair', m.pair, 'triple', m.triple, 'switch', m.switch,
            'serial', {serial}, 'uniform', {uniform}, 'runs', {runs}, 'lag', {serial} * sqrt(m.n))) AS tests""",
    )


def _text(tested: DataFrame) -> dict[str, float]:
    """What text shows, from all tokens of NEAR to LEAST - 1 symbols, with PRIOR counted as PRIOR_TOKENS more."""
    m = tested.select(F.explode("tests").alias("m")).where(f"m.n < {LEAST}")
    sums = {"pair": "m.pair", "triple": "m.triple", "switch": "m.switch", "serial": "m.serial", "serial_sq": "m.serial * m.serial"}
    of = {"pair": "m.n * (m.n - 1)", "triple": "m.n * (m.n - 1) * (m.n - 2)", "switch": "m.n - 1", "serial": "1D", "serial_sq": "1D"}
    got = m.agg(*(F.sum(F.expr(x)).alias(c) for c, x in sums.items()), *(F.sum(F.expr(x)).alias(f"of_{c}") for c, x in of.items())).first().asDict()
    weight = {"pair": NEAR * (NEAR - 1), "triple": NEAR * (NEAR - 1) * (NEAR - 2), "switch": NEAR - 1, "serial": 1, "serial_sq": 1}
    return {c: ((got[c] or 0.0) + PRIOR[c] * w * PRIOR_TOKENS) / ((got[f"of_{c}"] or 0.0) + w * PRIOR_TOKENS) for c, w in weight.items()}


def _fisher(text: dict[str, float]) -> str:
    """Fisher's statistic of the three tests of a token m against text: large where text would not show them."""
    p2, p3 = text["pair"], max(text["triple"], text["pair"] ** 2)
    sd = f"sqrt(2 * m.n * (m.n - 1) * {p2 * (1 - p2)!r}D + 4 * m.n * (m.n - 1) * (m.n - 2) * {p3 - p2 * p2!r}D)"
    uniform = f"((m.n * (m.n - 1) * {p2!r}D - m.pair) / {sd})"
    runs = f"((m.switch - (m.n - 1) * {text['switch']!r}D) / sqrt((m.n - 1) * {text['switch'] * (1 - text['switch'])!r}D))"
    var = max(text["serial_sq"] - text["serial"] ** 2, 1e-6) * (NEAR + LEAST - 1) / 2
    toward = 1.0 if text["serial"] < 0 else -1.0  # where randomness lies from what text shows
    serial = f"((m.serial - {text['serial']!r}D) * {toward}D / sqrt({var!r}D / m.n))"
    # upper tails of the normal distribution to seven digits (rational approximation of the error function, fixed values)
    t = "1 / (1 + 0.3275911 * abs(z) / sqrt(2D))"
    half = "0.5 * y.t * (0.254829592 + y.t * (-0.284496736 + y.t * (1.421413741 + y.t * (-1.453152027 + y.t * 1.061405429)))) * exp(-y.z * y.z / 2)"
    tail = f"greatest(if(y.z >= 0, {half}, 1 - {half}), 1e-300D)"
    return f"aggregate(transform(array({uniform}, {runs}, {serial}), z -> named_struct('z', z, 't', {t})), 0D, (a, y) -> a - 2 * ln({tail}))"


def _patterned() -> str:
    """One of the three tests rejects the token m as random in its alphabet."""
    z = 3.719  # upper tail of PATTERNED
    return f"(m.uniform > {z + 1} OR abs(m.runs) > {z} OR abs(m.lag) > {z})"  # chi-squared has the longer tail


def _thresholds(counts: list, q: float) -> dict[int, float]:
    """Benjamini-Hochberg on binned statistics by stratum of length: the least statistic of discoveries.

    A discovery's bound on p is that of its bin's lower edge (a chi-squared tail
    of six degrees), so binning only makes it stricter. Patterned tokens stay in
    the number of tests.
    """
    out = {}
    for stratum in {r.stratum for r in counts}:
        mine = sorted(((r.bin, r.n) for r in counts if r.stratum == stratum), reverse=True)
        tests, found = sum(n for _, n in mine), 0
        for b, n in mine:
            if b < 0:
                break
            found += n
            half = b * BIN / 2
            if tests * math.exp(-half) * (1 + half + half * half / 2) <= q * found:
                out[stratum] = b * BIN
    return out


def scan(docs: DataFrame, keep: list[str], q: float = 0.01, text: bool = False) -> DataFrame:
    """``keep`` columns, t (the text, null as empty) if wanted, and spans: array of (s, e, k) by start, then kind.

    k indexes KINDS. Null and empty texts have no spans; repeated rows are each
    scanned; an empty table gives an empty result; texts are scanned whole.
    """
    cols = [*keep, "t"] if text else keep
    tested = _battery(_spans(docs, keep), keep).select(*cols, "base", "tests")
    tested = C.materialize(tested, "secrets")
    bins = f"CAST(CASE WHEN {_patterned()} THEN -1 ELSE floor({_fisher(_text(tested))} / {BIN}) END AS INT)"
    tested = tested.withColumn("found", F.expr(f"transform(filter(tests, m -> m.n >= {LEAST}), m -> named_struct('s', m.s, 'k', 3, 'e', m.e, 'n', m.n, 'bin', {bins}))"))
    stratum = F.floor(F.log2(F.col("m.n"))).cast("int")
    counts = tested.select(F.explode("found").alias("m")).groupBy(stratum.alias("stratum"), F.col("m.bin").alias("bin")).agg(F.count("*").alias("n"))
    limits = _thresholds(counts.collect(), q)  # a few thousand rows at most: length classes by bins
    least = "CASE " + " ".join(f"WHEN m.n >= {2**s} AND m.n < {2 ** (s + 1)} THEN {x}D" for s, x in sorted(limits.items())) + " ELSE 1e9D END" if limits else "1e9D"
    return tested.selectExpr(
        *cols,
        f"""array_sort(concat(transform(base, m -> named_struct('s', m.s, 'k', m.k, 'e', m.e)),
            transform(filter(found, m -> m.bin * {BIN} >= {least}), m -> named_struct('s', m.s, 'k', m.k, 'e', m.e)))) AS spans""",
    )


def _joined(spans: str) -> str:
    names = "CASE m.k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    return f"concat_ws(',', transform({spans}, m -> concat_ws(':', {names}, CAST(m.s AS STRING), CAST(m.e AS STRING))))"


def digest(docs: DataFrame, q: float = 0.01) -> DataFrame:
    """One row per document: counts by kind, a hash of the base spans, all spans, and the number found by the battery.

    Null and empty texts have no spans; null ids stay null; repeated rows are
    each scanned; an empty table gives an empty result; other columns are ignored.
    """
    kind = lambda i: f"CAST(size(filter(spans, m -> m.k = {i})) AS BIGINT)"
    base = _joined("filter(spans, m -> m.k < 3)")
    return scan(docs.select("doc_id", "text"), ["doc_id"], q).selectExpr(
        "doc_id", f"{kind(0)} AS n_assign", f"{kind(1)} AS n_access", f"{kind(2)} AS n_hex",
        f"sha2({base}, 256) AS base_sha256", f"{_joined('spans')} AS spans", f"{kind(3)} AS n_random",
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", q: float = 0.01) -> DataFrame:
    """The documents with every span replaced by ``mask``; n_chars, where present, follows the text.

    Documents without spans stay as they are, null texts included; repeated rows
    are each masked; null ids and columns of any other name pass through; an
    empty table gives an empty result. Texts are written once on the way.
    """
    own = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    keep = [v for c, v in own.items() if c != "text"] + ["had_text"]
    inner = docs.withColumnsRenamed(own).withColumnRenamed(own["text"], "text").withColumn("had_text", F.col("text").isNotNull())
    fold = f"""aggregate(spans, named_struct('out', '', 'at', 0L),
        (a, m) -> if(m.e <= a.at, a, named_struct(
            'out', concat(a.out, if(m.s >= a.at, concat(substring(t, CAST(a.at + 1 AS INT), CAST(m.s - a.at AS INT)), '{mask}'), '')), 'at', m.e)),
        a -> concat(a.out, substring(t, CAST(a.at + 1 AS INT))))"""
    found = scan(inner, keep, q, text=True).selectExpr(*keep, f"CASE WHEN NOT had_text THEN NULL WHEN size(spans) = 0 THEN t ELSE {fold} END AS new_text", "size(spans) > 0 AS changed")
    out = []
    for c, v in own.items():
        if c == "text":
            out.append(F.col("new_text").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("changed"), F.length("new_text").cast(docs.schema[c].dataType)).otherwise(F.col(v)).alias(c))
        else:
            out.append(F.col(v).alias(c))
    return found.select(*out)
