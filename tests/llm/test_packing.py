"""Ids of long columns, whose distinct words are spelled together."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkglyph.llm import packing


class Docs:
    select = lambda self, *cols: self
    mapInArrow = lambda self, run, schema: run


@pytest.fixture
def words(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    words = packing._Words(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    monkeypatch.setattr(packing.Tokens, "__init__", lambda self, path: setattr(self, "words", words))
    return words


def ids(words, text):
    return np.array([*words.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def made(n):
    dice = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZéßÉÞñ"
    return ["".join(dice.choices(letters, k=dice.randint(2, 12))) + dice.choice(["", "", ",", "...", "7x42"]) for _ in range(n)]


def test_words_of_long_columns_are_spelled_together(spark, words, monkeypatch):
    taken = []

    class Parts:
        findall = lambda self, s, f=packing._PARTS.findall: taken.append(s) or f(s)

    monkeypatch.setattr(packing, "_PARTS", Parts())
    texts = [" ".join(made(9_000)), "the end", *(" ".join(made(9_000)[i::50]) for i in range(50))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(52)), pa.array(range(52)), pa.array([t.encode() for t in texts])], names=["doc_id", "text_hash", "text"])
    (out,) = packing.tokenize(Docs(), 1 << 20, None)(iter([batch]))
    assert out.column("rest_crc").to_pylist() == [packing.zlib.crc32(ids(words, t)) for t in texts]
    assert not taken  # before, once for each new word


@pytest.mark.parametrize(("chunk", "piece", "cache"), [(1 << 24, 1 << 20, 150_000), (700, 90, 40), (1, 1, 5)])
def test_ids_of_odd_words_in_long_columns(words, monkeypatch, chunk, piece, cache):
    for name, value in (("CHUNK", chunk), ("PIECE", piece), ("FEW", 0), ("CACHE_WORDS", cache)):
        monkeypatch.setattr(packing, name, value)
    odd = ["don't", "'sit", "l'Été,\"'ll\"", "a<|b", "<", "|", "<|endoftext|>x", "<|ENDOFTEXT|>", "3×4", "÷", "A×B÷", "ÀÞßÿÖ", "²ª", "Дом7", "水水", "éÅ", "x\x01Y", "a B", "\x7f",
           "\x1c\x85", "12ab34", "!!??", "$5.00", "\U0001f600É", "İ", "A" * 60, "É" * 60, "-9" * 40]
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", *odd, *(f" {a}  {b}\n" for a, b in zip(odd, odd[1:])), " ".join(odd), None, " ".join(made(300)), *made(40), "Ã", ""]
    column = pa.array([None if t is None else t.encode() for t in texts])
    for part in (column, column.slice(3, 50), column.slice(0, 1), column.slice(2, 2)):
        got = [bytes(x) for run in packing.Tokens(None).of_column(part) for x in run]
        # the tokenizer parts words at other white space by itself, and words are all it sees of a text
        assert got == [b"".join(ids(words, w.decode())[:-4] for w in (t or b"").split()) + b"\x01\0\0\0" for t in part.to_pylist()]
    assert all(len(t) <= cache for t in (words, words.old, words.parts, words.old_parts))
    assert not any(len(k) > packing.CACHE_LENGTH for k in [*words.parts, *words.old_parts])


def test_bytes_that_are_not_utf8(words, monkeypatch):
    texts = [b"a\xc3", b"\xa9b", b"\xc3\xc3\xa9", b"x\x80\x80", b"\xff", b"\xc3", b"\xa9"]
    column = pa.array([*texts, b" ".join(texts)])
    monkeypatch.setattr(packing, "FEW", 0)
    got = [bytes(x) for run in packing.Tokens(None).of_column(column) for x in run]
    assert got == packing.Tokens(None).of(column.to_pylist())
    assert got[:-1] == [ids(words, t.decode("utf-8", "replace")) for t in texts]


def test_frequent_parts_stay_when_a_table_is_full(words, monkeypatch):
    for name, value in (("CHUNK", 1 << 16), ("FEW", 0), ("CACHE_WORDS", 100)):
        monkeypatch.setattr(packing, name, value)
    often, seen = ["river", "cold", "stone"], []
    model = words.model

    class Model:
        tokenize = lambda self, s: seen.append(s) or model.tokenize(s)

    words.model = Model()
    letters = "abcdefghij"
    for k in range(6):
        rare = ["q" + letters[k] + letters[i // 100] + letters[i // 10 % 10] + letters[i % 10] for i in range(300)]
        list(packing.Tokens(None).of_column(pa.array([" ".join([*often, *rare, *often]).encode()])))
    assert [seen.count(w) for w in often] == [1, 1, 1]
