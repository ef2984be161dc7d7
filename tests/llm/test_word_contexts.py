"""The language model after real words."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkglyph.llm import pitman_yor, queries, word_contexts


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_words_before_decide(spark, tmp_path):
    """Words of one class of endings are told apart, as the word before and as the one before that."""
    texts = {i: t for i, t in enumerate(["zzpha red", "yypha blue", "zzpha mid gold", "yypha mid salt"] * 200)}
    ask = ["zzpha red", "zzpha blue", "yypha blue", "yypha red", "zzpha mid gold", "zzpha mid salt", "yypha mid salt", "yypha mid gold"]
    ids = [i for i in range(10_000, 11_000) if held(i)][: len(ask)]
    rows = [*texts.items(), *zip(ids, ask)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in queries.op5_lm_scoring(spark, str(tmp_path)).collect()}
    right = [got[i] for i in ids[::2]]
    wrong = [got[i] for i in ids[1::2]]
    assert all(a > b + 1 for a, b in zip(right, wrong))


def test_counts_and_edges(spark, monkeypatch):
    monkeypatch.setattr(word_contexts, "OWN", 8)  # most words through the word restaurants
    monkeypatch.setattr(word_contexts, "BUCKET", 500)  # several buckets and sections
    monkeypatch.setattr(word_contexts, "CHUNK", 300)
    monkeypatch.setattr(word_contexts, "DEST", 4)
    rng = np.random.default_rng(4)
    vocab = [f"w{int(x)}" for x in rng.zipf(1.4, 400) % 3000] + ["The", "the", "É"]
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 60))))) for i in range(200)] + [(900, None), (901, ""), (None, "the the"), (7, "again w1"), (7, "again w1")]
    rows += [(next(i for i in range(1000, 2000) if held(i)), "never seen at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(word_contexts.score(df).collect(), key=lambda r: (r.doc_id or -1, r.n_tokens))
    tokens = [(i, [w.encode().lower() for w in (t or "").split()] + [pitman_yor.END]) for i, t in rows]
    out = lambda i: held("" if i is None else i)
    counts = Counter(w for i, t in tokens if not out(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, sorted(tokens, key=lambda x: (x[0] or -1, len(x[1])))):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, out(i), len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) and r.score < 0
    again = sorted(word_contexts.score(df).collect(), key=lambda r: (r.doc_id or -1, r.n_tokens))
    assert got == again
    assert word_contexts.score(df.limit(0)).count() == 0
    # nothing to learn from
    alone = word_contexts.score(df.where("doc_id = 1000000 OR text = 'never seen at all'")).collect()
    assert len(alone) == 1 and alone[0].n_known == 0 and alone[0].train_tokens == 0


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    n = 4000
    u, v, dish = rng.integers(0, 5, n), rng.integers(0, 6, n), rng.zipf(1.3, n) % 30
    learn = np.r_[np.ones(n, np.int64), np.zeros(31, np.int64)]
    u, v, dish = (np.concatenate(x).astype(np.uint64) for x in ((u, np.full(31, 2)), (v, np.full(31, 3)), (dish, np.arange(31))))
    base = np.r_[rng.random(30), 0.5]
    lp = word_contexts.score_bucket(np.zeros(n + 31, np.int64), v, u, dish, learn, (base / base.sum())[dish.astype(int)], rng)
    assert (10 ** lp[n:]).sum() == pytest.approx(1)
    # diffuse: dish 30 stands for all words never seen; one of the others may be among them
    lp, word, count = word_contexts.score_bucket(np.zeros(n + 31, np.int64), v, u, dish, learn, None, rng)
    seen = count[word[n:]] > 0
    assert (10 ** lp[n:][seen]).sum() + 10 ** lp[-1] == pytest.approx(1) and not seen[-1]
    assert count[word[n]] == (dish[:n] == dish[n]).sum()


def test_seats_one_by_one():
    def plain(c, parent, others, d, rng):
        t = 1
        for n in range(1, c):
            w = (pitman_yor.STRENGTH + d * (others + t)) * parent
            t += rng.random() < w / (n - d * t + w)
        return t

    rng, draw = np.random.default_rng(0), random.Random(1)
    for c, parent, others, d in ((2, 0.1, 3, 0.6), (30, 0.5, 2, 0.8), (300, 0.02, 40, 0.5), (300, 0.9, 0, 0.1)):
        draws = 2000
        want = np.array([plain(c, parent, others, d, rng) for _ in range(draws)])
        one = np.array([word_contexts._alone(c, parent, others, d, draw) for _ in range(draws)])
        many = word_contexts.seat(np.full(draws, float(c)), np.full(draws, parent), np.full(draws, float(others)), d, rng, draw)
        for got in (one, many):
            assert (got >= 1).all() and (got <= c).all()
            assert got.mean() == pytest.approx(want.mean(), abs=5 * (want.std() + 1e-9) / math.sqrt(draws) + 1e-9)


def test_blocks_come_back():
    rng = np.random.default_rng(3)
    hashes, cls = rng.integers(0, 2**48, 5000, dtype=np.uint64), rng.integers(0, 512, 5000)
    for n in (1, 40, 3000):
        doc = np.sort(rng.integers(0, 2**33, n))
        u, v, w = rng.integers(0, 5000, (3, n)).astype(np.uint32)
        d, (a, b, k), (ka, kb) = word_contexts._unpack(word_contexts._pack(np.cumsum(doc % 9), [u, v, cls[w]], 2, hashes, cls), 3, 2)
        assert (d == np.cumsum(doc % 9)).all() and (a == hashes[u]).all() and (b == hashes[v]).all() and (k == cls[w]).all() and (ka == cls[u]).all() and (kb == cls[v]).all()
        d, (a, b, c), k = word_contexts._unpack(word_contexts._pack(np.cumsum(doc % 9), [u, v, w], 3, hashes, cls), 3, 3)
        assert (a == hashes[u]).all() and (b == hashes[v]).all() and (c == hashes[w]).all() and (k[2] == cls[w]).all()


def test_common_words_shorten_blocks():
    rng = np.random.default_rng(6)
    common = word_contexts.Common([f"w{i}".encode() for i in range(4000)])
    hashes, cls = rng.integers(0, 2**48, 5000, dtype=np.uint64), rng.integers(0, 512, 5000)
    ranks = np.r_[rng.permutation(4001), np.full(999, -1)]
    hashes[:4001], cls[:4001] = common.hashes[ranks[:4001]], common.classes[ranks[:4001]]
    u, v, w = rng.integers(0, 5000, (3, 3000)).astype(np.uint32)
    doc = np.arange(3000)
    for cols, named in (([u, v, cls[w]], 2), ([u, v, w], 3)):
        plain, short = (word_contexts._pack(doc, cols, named, hashes, cls, r) for r in (None, ranks))
        d, (a, b, c), k = word_contexts._unpack(short, 3, named, common)
        assert (d == doc).all() and (a == hashes[u]).all() and (b == hashes[v]).all() and (c == (cls[w] if named == 2 else hashes[w])).all()
        assert all((x == cls[y]).all() for x, y in zip(k, (u, v)) if named == 2) and (named == 2 or (k[2] == cls[w]).all())
        assert len(short) < 0.75 * len(plain)


def test_common_words_and_cells(spark, monkeypatch):
    monkeypatch.setattr(word_contexts, "RANGE", 1 << 12)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 200) % 500) for _ in range(40)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = Counter(w.encode() for t in texts for w in (t or "").split())
    order = sorted(counts, key=lambda w: (-counts[w], w))
    common = word_contexts.common_words(df)
    assert list(common.rank) == [pitman_yor.END, *order]
    cells = Counter()
    k = {w: int(common.classes[i]) for w, i in common.rank.items()}
    for t in texts:
        row = [0, 0, *(k[w.encode()] for w in (t or "").split()), 0]
        cells.update(((u % pitman_yor.FOLDED) * pitman_yor.N_DISH + v) * pitman_yor.N_DISH + w for u, v, w in zip(row, row[1:], row[2:]))
    got = word_contexts.class_cells(df, common)
    assert list(zip(got["key"].to_pylist(), got["n"].to_pylist())) == sorted(cells.items())
    # where the steps of counts do not fit, those with a class of their own remain
    monkeypatch.setattr(word_contexts, "OWN", 8)
    monkeypatch.setattr(word_contexts, "COMMON", 3)
    ties = spark.createDataFrame([("d c b a f e h g j i",)], "text string")
    assert list(word_contexts.common_words(ties).rank) == [pitman_yor.END, *(bytes([x]) for x in b"abcdefg")]


def test_waits_take_few_draws():
    class Coins:  # nothing but plain random numbers
        def __init__(self):
            self.draw, self.drawn = random.Random(5), 0

        def random(self):
            self.drawn += 1
            return self.draw.random()

    coins = Coins()
    tables = [word_contexts._alone(1_000_000, 1e-3, 500, 0.5, coins) for _ in range(200)]
    assert min(tables) >= 1 and coins.drawn < 200 * 30 + 3 * sum(tables)
    rng = np.random.default_rng(1)
    want = []
    for _ in range(2000):
        t = 1
        for n in range(1, 400):
            w = (pitman_yor.STRENGTH + 0.95 * (3 + t)) * 0.5
            t += rng.random() < w / (n - 0.95 * t + w)
        want.append(t)
    got = [word_contexts._alone(400, 0.5, 3, 0.95, coins) for _ in range(2000)]
    assert np.mean(got) == pytest.approx(np.mean(want), abs=5 * np.std(want) * math.sqrt(2 / 2000))
