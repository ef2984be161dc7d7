"""Tokens of the language model as numbers."""

import random
import zlib

import numpy as np
import pyarrow as pa

from sparkglyph.llm import pitman_yor, word_contexts


def numbered(texts, common):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    (got,) = word_contexts._chunks(iter([batch]), common, [])
    return got


def test_numbers_classes_and_hashes():
    draw = random.Random(1)
    texts = [None, b"", b"  ", b"A b", b"x" * 200 + b" \x00 \x00\x00", b"y" * 64 + b" " + b"y" * 65, "É Z\x0bq".encode()]
    texts += [bytes(draw.choice(b" \t\n\x08\x0e\x1fabAZ\xff\x00") for _ in range(draw.randrange(40))) for _ in range(300)]
    common = word_contexts.Common([b"a", b"b"])
    u, v, w, doc, n, (hashes, cls, ranks), _ = numbered(texts, common)
    names, at = {}, 0
    for i, t in enumerate(texts):
        row = [*(t or b"").lower().split(), pitman_yor.END]
        assert n[i] == len(row)
        for j, x in enumerate(row):
            k = w[at]
            assert names.setdefault(x, k) == k and doc[at] == i
            assert (v[at], u[at]) == (w[at - 1] if j else 0, w[at - 2] if j > 1 else 0)
            rank = common.rank.get(x, -1)
            assert ranks[k] == rank and cls[k] == (rank if rank >= 0 else word_contexts.OWN + zlib.crc32(x[-3:]) % (pitman_yor.N_DISH - word_contexts.OWN))
            assert rank < 0 or hashes[k] == common.hashes[rank]
            at += 1
    assert at == len(w) and len(set(names.values())) == len(names) == len({int(hashes[k]) for k in names.values()}) and hashes.max() < 1 << 48


def test_short_words_take_no_calls_of_their_own(monkeypatch):
    """Only words longer than LONG are hashed one by one."""
    called, plain = [], word_contexts.hashlib.blake2b
    monkeypatch.setattr(word_contexts.hashlib, "blake2b", lambda x, **more: (called.append(bytes(x)), plain(x, **more))[1])
    long = b"z" * (word_contexts.LONG + 1)
    numbered([b" ".join(b"w%d" % i for i in range(1000)) + b" " + long], word_contexts.Common([b"w1"]))
    assert called == [long]


def test_one_sort_for_few_dishes():
    rng = np.random.default_rng(2)
    restaurant, dish = rng.integers(0, 2**63, 50, dtype=np.uint64)[rng.integers(0, 50, 3000)], rng.integers(0, 30, 3000)
    for few in (True, False):
        at, cell, ctx = word_contexts._cells(restaurant, dish, few)
        assert (np.diff(ctx) >= 0).all() and (restaurant[at][cell] == restaurant).all() and (dish[at][cell] == dish).all()
        assert len(at) == len(set(zip(restaurant.tolist(), dish.tolist()))) and len(set(zip(ctx.tolist(), restaurant[at].tolist()))) == len(set(restaurant.tolist())) == ctx[-1] + 1
