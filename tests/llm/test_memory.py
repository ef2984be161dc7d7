"""What stages hold in memory."""

import weakref

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from sparkglyph.llm import common, minhash, packing


def test_texts_go_to_python_once(spark):
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate([("the river runs cold", "en"), ("el agua corre", "es")] * 20)] + [(99, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = P.language(spark, docs, "")
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "__bytes" not in plan
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 40 and all(got[i].text == rows[i][1] and got[i].lang == rows[i][2] for i in got)


def test_few_full_buckets_go_to_the_entries(spark, monkeypatch):
    """Entries alone in their buckets are neither dealt nor sorted, unless the others' buckets are many."""
    rows = [(i, f"a{i // 2} b{i // 2} c{i // 2} d e f g h" + " i" * (i % 2)) for i in range(40)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plans, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, tag: (plans.append((tag, df._jdf.queryExecution().analyzed().toString())), write(df, tag))[1])
    found = lambda: sorted(map(tuple, minhash.near_duplicates(docs, 2, 80).collect()))
    members = lambda: next(p for tag, p in plans if tag == "dedup-members")
    got = found()
    assert "strategy=broadcast" in members()
    plans.clear()
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert found() == got and "strategy=broadcast" not in members()
    assert any(r[0] != r[2] for r in got)


def test_tokens_keep_few_short_words(spark, monkeypatch):
    """Tables of ids end at twice their size, do without long words, and change no id; no batch is held while the next one is read."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    words = packing._Words(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    monkeypatch.setattr(packing.Tokens, "__init__", lambda self, path: setattr(self, "words", words))
    often = "the River, runs cold; \u00e9t\u00e9 \u6c34"
    texts = [f"{often} word{i}x {'ab' * 200 + str(i)} {often}" for i in range(200)]
    want = [np.array([*words.tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in texts]

    class Docs:
        select = lambda self, *cols: self
        mapInArrow = lambda self, run, schema: run

    def batches():
        for i in range(0, 200, 50):
            held = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 50)), pa.array(range(50)), pa.array([t.encode() for t in texts[i : i + 50]])], names=["doc_id", "text_hash", "text"])]
            left = weakref.ref(held[0])
            yield held.pop()
            assert left() is None

    n, crc = [], []
    for out in packing.tokenize(Docs(), 4096, None)(batches()):
        n += out.column("tokens").to_pylist()
        crc += out.column("rest_crc").to_pylist()
    assert n == [len(x) for x in want] and crc == [packing.zlib.crc32(x.tobytes()) for x in want]
    tables = [words, words.old, words.parts, words.old_parts]
    assert all(0 < len(t) <= 50 for t in tables[:3]) and len(words.old_parts) <= 50
    assert max(len(k) for t in tables for k in t) < 100
    assert b"River," in words or b"River," in words.old
