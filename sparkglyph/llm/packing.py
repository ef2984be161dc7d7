"""Packing documents into fixed windows by non-negative least squares.

Every document is tokenized once. Its full windows stand alone; what remains has
a length below the window. Shallow combinations of such lengths that fill a
window exactly are enumerated, the times each is used are solved against the
histogram of lengths by non-negative least squares and rounded down, and what is
left over is packed greedily end to end, cut where a window is full. The last
window's rest is cut into powers of two, which take no padding.

Only the histogram of lengths (as many rows as the window is long) reaches the
driver. Documents find their place in a length by ranks that are counted in
chunks, so no length, however frequent, lands in one task.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .flat import buffers, give_back, pieces

WINDOW = 2048
#: Combinations of three lengths are enumerated over so many of the most frequent lengths.
TRIPLE_LENGTHS = 96
END_ID = 1
#: Words, and parts of words, that a table of ids takes in before it is the old one; a Python worker keeps two tables of each.
CACHE_WORDS = 150_000
#: Words and parts of more bytes or letters are not kept.
CACHE_LENGTH = 48
#: Bytes of text that a worker takes apart at once.
PIECE = 1 << 20
#: Bytes of text whose distinct words are spelled together; in columns under the latter each word is looked up by itself.
CHUNK, FEW = 1 << 22, 1 << 16


def _tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of these characters alone (ASCII and Latin-1 letters) are taken apart here as the tokenizer does it.
_SIMPLE = re.compile("[!-~\u00c0-\u00ff]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the rest from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LETTER, _DIGIT, _OTHER, _ODD = range(4)


def _kinds() -> np.ndarray:
    """Kinds of bytes as ``_SIMPLE`` and ``_PARTS`` have them; the apostrophe, which begins parts of its own, is odd."""
    kind = np.full(256, _ODD, np.uint8)
    kind[33:127], kind[ord("'")] = _OTHER, _ODD
    kind[48:58] = _DIGIT
    kind[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
    return kind


_KIND = _kinds()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _binary(data: np.ndarray, start: np.ndarray) -> pa.LargeBinaryArray:
    """What lies in ``data`` from each start to the next."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data))), pa.py_buffer(data)])


def _cut(data: np.ndarray, at: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of texts, and how many each text has; words end at the space and the control characters 9 to 13."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = at[:-1][np.diff(at) > 0]
    first[cut] = inside[cut]
    count = np.diff(np.searchsorted(np.flatnonzero(first), at))
    return _binary(data[inside], np.flatnonzero(first[inside])), count


def _parts(words: pa.LargeBinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Parts of words in lower case, how many each word has, and which words are odd: these are left whole, as they are.

    Odd are those that ``_SIMPLE`` does not match, and those that may hold a
    special token or a part with an apostrophe.
    """
    data, at = buffers(words)
    kind, low = _KIND[data], _LOWER[data]
    odd = kind == _ODD
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    lead, tail = data == 0xC3, (data & 0xC0) == 0x80
    if lead.any() or tail.any():  # Latin-1 letters of two bytes
        odd[1:] |= lead[:-1] != tail[1:]
        odd[at[:-1]] |= tail[at[:-1]]
        odd[at[1:] - 1] |= lead[at[1:] - 1]
        odd |= tail & ((data == 0x97) | (data == 0xB7))  # the signs of multiplication and division
        low = np.where(tail & (data < 0x9F), low | 0x20, low)
    first = kind == _DIGIT
    first[1:] |= kind[1:] != kind[:-1]
    odd_word = np.zeros(len(words), bool)
    if odd.any():
        odd_word = np.logical_or.reduceat(odd, at[:-1])
        whole = np.repeat(odd_word, np.diff(at))
        low, first = np.where(whole, data, low), first & ~whole
    first[at[:-1]] = True
    start = np.flatnonzero(first)
    return _binary(low, start), np.diff(np.searchsorted(start, at)), odd_word


def _gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``n`` items of ``flat`` from ``start`` on, of each of ``which``, end to end."""
    size = n[which]
    end = np.cumsum(size)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start[which] - end + size, size)]


class _Words(dict):
    """Ids of words, as bytes, put together from those of their parts.

    A full table is kept as the old one; words that come again move on to the
    new one, the others go when that is full in turn.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()
        self.old, self.parts, self.old_parts = {}, {}, {}

    def _letters(self, part: str) -> str:
        return part.encode().decode("latin-1").translate(self.letters)

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.old_parts.get(part)
            if ids is None:
                ids = _bytes([t.id for t in self.model.tokenize(part if part.isascii() else self._letters(part))])
            if len(part) <= CACHE_LENGTH:
                if len(self.parts) >= CACHE_WORDS:
                    self.old_parts, self.parts = self.parts, {}
                self.parts[part] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            s = word.decode("utf-8", "replace")
            if _SIMPLE.fullmatch(s) and "<|" not in s and "\u00d7" not in s:
                ids = b"".join(map(self.part, _PARTS.findall(s.lower())))
            else:
                ids = _bytes(self.tokenizer.encode(s, add_special_tokens=False).ids)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.old = self.copy()
                self.clear()
            self[word] = ids
        return ids

    def _parts_ids(self, spelled: list[str]) -> list[bytes]:
        """Ids of distinct parts, the most frequent last: these stay when a table is full."""
        known, old, tokenize = self.parts, self.old_parts, self.model.tokenize
        ids = [known.get(p) or old.get(p) for p in spelled]
        new = [i for i, x in enumerate(ids) if x is None]
        flat, ends = array("I"), array("Q", [0])
        for i in new:
            p = spelled[i]
            flat.extend([t.id for t in tokenize(p if p.isascii() else self._letters(p))])
            ends.append(4 * len(flat))
        raw = np.array(flat, "<u4").tobytes()
        for i, a, b in zip(new, ends, ends[1:]):
            ids[i] = raw[a:b]
        fresh = [i for i, p in enumerate(spelled) if len(p) <= CACHE_LENGTH and p not in known]
        if len(known) + len(fresh) <= CACHE_WORDS:
            known.update((spelled[i], ids[i]) for i in fresh)
        else:
            short = [i for i, p in enumerate(spelled) if len(p) <= CACHE_LENGTH][-CACHE_WORDS:]
            self.old_parts, self.parts = known, {spelled[i]: ids[i] for i in short}
        return ids

    def spell(self, words: pa.LargeBinaryArray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, where each word's begin, and how many it has."""
        parts, count, odd_word = _parts(words)
        parts = parts.dictionary_encode()
        number, first = parts.indices.to_numpy(), np.cumsum(count) - count
        odd = np.zeros(len(parts.dictionary), bool)
        odd[number[first[odd_word]]] = True
        order = np.lexsort((np.bincount(number, np.repeat(times, count)), odd))  # the most frequent last
        simple = len(odd) - int(odd.sum())
        ids = self._parts_ids(parts.dictionary.take(pa.array(order[:simple])).cast(pa.large_string()).to_pylist())
        ids += map(self.__getitem__, parts.dictionary.take(pa.array(order[simple:])).to_pylist())
        n = np.zeros(len(odd), np.int64)
        n[order] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.zeros(len(odd), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        flat = _gather(np.array(memoryview(b"".join(ids)).cast("I"), "<u4"), start, n, number)
        ends = np.append(0, np.cumsum(n[number]))[np.append(first, len(number))]
        return flat, ends[:-1], np.diff(ends)


class Tokens:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, the end id included.

    The tokenizer drops white space, lower-cases, and takes runs of letters,
    single digits and runs of other characters each by itself. Words' ids are
    looked up, new words are put together from their parts' ids, and only new
    parts go through the tokenizer's model. Words of other alphabets, or with
    the special tokens in them, go through the whole tokenizer. Of long columns
    each distinct word of a chunk is taken apart once, all of them together.
    """

    def __init__(self, path: str | None) -> None:
        import tokenizers

        file = _tokenizer_path(path)
        kept = tokenizers.__dict__.setdefault("_sparkglyph_words", {})  # outlives a task in its worker
        if file not in kept:
            kept[file] = _Words(tokenizers.Tokenizer.from_file(file))
        self.words = kept[file]

    def of(self, texts: list[bytes]) -> list[bytes]:
        # words end at the space and the control characters 9 to 13
        find, end = self.words.__getitem__, np.array([END_ID], "<u4").tobytes()
        return [b"".join(map(find, t.split())) + end for t in texts]

    def of_column(self, column: pa.Array) -> Iterator[list[bytes | memoryview]]:
        """Ids of all texts of a column, in runs."""
        for lo, hi, data, at in pieces(column, CHUNK):
            if len(data) < FEW:
                raw = data.tobytes()
                yield self.of([raw[a:b] for a, b in zip(at, at[1:])])
            else:
                yield from self._of_many(column.slice(lo, hi - lo))

    def _of_many(self, column: pa.Array) -> Iterator[list[memoryview]]:
        cut = [_cut(data, at) for _, _, data, at in pieces(column, PIECE)]
        if not any(len(w) for w, _ in cut):
            yield self.of([b""] * len(column))
            return
        words = pa.chunked_array([w for w, _ in cut]).dictionary_encode().combine_chunks()  # one dictionary for all of it
        number, dictionary = words.indices.to_numpy(), words.dictionary
        counts, end = [n for _, n in cut], len(dictionary)
        del cut, words
        flat, start, n = self.words.spell(dictionary, np.bincount(number, minlength=end))
        flat, start, n = np.append(flat, np.uint32(END_ID)), np.append(start, len(flat)), np.append(n, 1)
        at = 0
        for count in counts:
            stop = np.cumsum(count)
            which = np.insert(number[at : at + stop[-1]], stop, end)  # the end id follows each text
            ids = _gather(flat, start, n, which).astype("<u4", copy=False).view(np.uint8).data
            to = 4 * np.append(0, np.cumsum(n[which])[stop + np.arange(len(stop))])
            yield [ids[a:b] for a, b in zip(to, to[1:])]
            at += stop[-1]


def tokenize(docs: DataFrame, window: int, path: str | None) -> DataFrame:
    """doc_id, text_hash, tokens, full_crcs (of the full windows), rest (tokens after them), rest_crc."""
    inner = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        for batch in batches:
            n, full, rest, crc = [], [], [], []
            for ids in chain.from_iterable(tokens.of_column(batch.column("text"))):
                k = len(ids) // 4 // window
                n.append(len(ids) // 4)
                full.append([zlib.crc32(ids[4 * window * i : 4 * window * (i + 1)]) for i in range(k)])
                rest.append(len(ids) // 4 - k * window)
                crc.append(zlib.crc32(ids[4 * window * k :]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.int32()), pa.array(crc, pa.int64())],
                names=["doc_id", "text_hash", "tokens", "full_crcs", "rest", "rest_crc"],
            )
            batch = ids = n = full = rest = crc = None  # nothing of it stays while the next one is read
            give_back()

    return inner.mapInArrow(run, "doc_id long, text_hash long, tokens long, full_crcs array<long>, rest int, rest_crc long")


def combinations(hist: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths that occur and add up to the window."""
    here = np.flatnonzero(hist)
    found = {tuple(sorted((int(a), window - int(a)))) for a in here if hist[window - a]}
    often = here[np.argsort(-hist[here], kind="stable")][:TRIPLE_LENGTHS]
    for i, a in enumerate(often):
        for b in often[i:]:
            c = window - int(a) - int(b)
            if c > 0 and hist[c]:
                found.add(tuple(sorted((int(a), int(b), c))))
    return sorted(found)


def solve(hist: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares of the uses of each combination against the histogram, by coordinate descent; rounded down to what is there."""
    x = np.zeros(len(combos))
    left = hist.astype(float).copy()
    parts = [[(a, combo.count(a)) for a in dict.fromkeys(combo)] for combo in combos]
    norm = [sum(m * m for _, m in p) for p in parts]
    for _ in range(sweeps):
        moved = 0.0
        for j, p in enumerate(parts):
            step = max(-x[j], sum(m * left[a] for a, m in p) / norm[j])
            if step:
                x[j] += step
                for a, m in p:
                    left[a] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    uses, there = np.zeros(len(combos), np.int64), hist.astype(np.int64).copy()
    for rounding in (np.floor, lambda v: np.full_like(v, np.inf)):  # rounded, then whatever whole uses still fit
        for j in np.argsort(-x, kind="stable"):
            most = min(there[a] // m for a, m in parts[j])
            k = int(min(most, rounding(x)[j] - uses[j])) if rounding is np.floor else int(most)
            if k > 0:
                uses[j] += k
                for a, m in parts[j]:
                    there[a] -= m * k
    return uses


def plan(hist: np.ndarray, window: int) -> tuple[list[tuple], np.ndarray, int]:
    """Rows (rest, first rank, rank after the last, first sequence, offset); ranks used of each length; sequences used."""
    combos = combinations(hist, window)
    uses = solve(hist, combos) if combos else np.zeros(0, np.int64)
    rows, used, sequence = [], np.zeros(window, np.int64), 0
    for combo, k in zip(combos, uses):
        if k:
            at = 0
            for a in combo:
                rows.append((int(a), int(used[a]), int(used[a] + k), sequence, at))
                used[a] += k
                at += a
            sequence += int(k)
    return rows, used, sequence


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty and hold the end id alone; repeated rows are each
    packed; null ids stay null; an empty table gives an empty result; other
    columns are ignored; texts are tokenized whole.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    t = C.materialize(tokenize(docs, window, tokenizer), "pack")
    found = t.groupBy("rest").agg(F.count("*").alias("n"), F.sum(F.size("full_crcs")).alias("full")).collect()  # a row per length below the window
    hist, full = np.zeros(window + 1, np.int64), np.zeros(window, np.int64)
    for r in found:
        hist[r.rest], full[r.rest] = r.n, r.full
    total = int(hist.sum())
    hist[0] = 0
    slots, used, n_combo = plan(hist, window)
    lengths = np.arange(window)
    over = (hist[:window] - used) * lengths
    over_base = np.cumsum(over) - over
    n_over = int(over.sum())
    main = n_over // window * window
    tail, edges = n_over - main, [main]
    for k in range(window.bit_length(), -1, -1):
        if tail >> k & 1:
            edges.append(edges[-1] + (1 << k))
    full_base = n_combo + main // window + len(edges) - 1 + np.cumsum(full) - full

    # ranks within a length: chunks are counted, their rows numbered, the counts before them added
    chunks = max(64, total // 50_000)
    t = t.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(chunks)).cast("int")).withColumn("n_full", F.size("full_crcs"))
    by = t.groupBy("rest", "chunk").agg(F.count("*").alias("n"), F.sum("n_full").alias("full"))
    before = Window.partitionBy("rest").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select("rest", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full_before"))
    inside = Window.partitionBy("rest", "chunk").orderBy("doc_id", "text_hash")
    rows = t.withColumn("rank", F.row_number().over(inside) - 1).withColumn("full_in", F.coalesce(F.sum("n_full").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by = C.broadcast_if_small(by, window * chunks, 40)
    rows = rows.join(by, ["rest", "chunk"]).withColumn("rank", (F.col("rank") + F.col("n_before")).cast("long"))
    per_length = spark.createDataFrame(
        [(int(a), int(used[a]), int(over_base[a]), int(full_base[a])) for a in range(window)], "rest int, used long, over_base long, full_base long"
    )
    rows = rows.join(F.broadcast(per_length), "rest")  # `window` rows
    rows = C.materialize(
        rows.select("doc_id", "text_hash", "tokens", "rest", "rank", "full_crcs", "rest_crc", (F.col("full_before") + F.col("full_in") + F.col("full_base")).cast("long").alias("first_full"),
                    "used", (F.col("over_base") + (F.col("rank") - F.col("used")) * F.col("rest")).alias("at")),
        "pack-ranks",
    )

    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = rows.where(F.size("full_crcs") > 0).select(
        "doc_id", F.posexplode("full_crcs").alias("i", "ids_crc32"), F.col("tokens").alias("doc_tokens"), "first_full"
    ).select("doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first_full") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    slot = spark.createDataFrame(slots, "length int, lo long, hi long, first long, offset long")
    combined = (
        rows.where((F.col("rest") > 0) & (F.col("rank") < F.col("used")))
        .join(F.broadcast(slot), (F.col("rest") == F.col("length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))  # a few thousand rows, bounded by the window
        .select("doc_id", (F.col("tokens") - F.col("rest")).alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
    )

    # the greedy rest: end to end, cut at the edges of windows
    edge_list = "array(" + ",".join(f"{e}L" for e in edges) + ")"
    cut = f"""array_sort(array_distinct(concat(array(at, at + rest),
        transform(filter(sequence((at div {window}) * {window}, ((at + rest) div {window}) * {window}, {window}L), e -> e > at AND e < at + rest AND e < {main}L), e -> CAST(e AS BIGINT)),
        filter({edge_list}, e -> e > at AND e < at + rest))))"""
    loose = rows.where((F.col("rest") > 0) & (F.col("rank") >= F.col("used"))).withColumn("cut", F.expr(cut))
    loose = loose.withColumn("part", F.expr("transform(sequence(0, greatest(size(cut) - 2, 0)), i -> named_struct('a', get(cut, i), 'n', get(cut, i + 1) - get(cut, i)))"))
    crcs = _cut_crcs(docs, loose.where(F.size("part") > 1), main // window + len(edges), tokenizer)
    loose = loose.join(C.broadcast_if_small(crcs, main // window + len(edges), 120), ["rest", "rank"], "left")
    place = f"CASE WHEN p.a < {main}L THEN {n_combo}L + p.a div {window} ELSE {n_combo + main // window}L + size(filter({edge_list}, e -> e <= p.a)) - 1 END"
    from_ = f"CASE WHEN p.a < {main}L THEN p.a % {window} ELSE p.a - array_max(filter({edge_list}, e -> e <= p.a)) END"
    loose = loose.select("*", F.posexplode("part").alias("i", "p")).select(
        "doc_id", (F.col("tokens") - F.col("rest") + F.col("p.a") - F.col("at")).alias("start"), F.col("p.n").alias("length"),
        F.coalesce(F.expr("get(crcs, i)"), F.col("rest_crc")).alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        F.expr(place).cast("long").alias("sequence_id"), F.expr(from_).cast("long").alias("offset"),
    )
    return whole.select(cols).unionByName(combined.select(cols)).unionByName(loose.select(cols))


def _cut_crcs(docs: DataFrame, cut: DataFrame, most: int, tokenizer: str | None) -> DataFrame:
    """crcs of the parts of cut documents (at most one a window), which are tokenized again: rest, rank, crcs."""
    want = cut.select("rest", "rank", "doc_id", "text_hash", (F.col("tokens") - F.col("rest")).alias("skip"), F.transform("part", lambda p: p["n"]).alias("n"))
    text = F.coalesce("text", F.lit(""))
    have = docs.select(F.col("doc_id").alias("d_id"), F.xxhash64(text).alias("d_hash"), text.alias("text"))
    want = C.broadcast_if_small(want, most, 120)
    both = have.join(want, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")))
    both = both.dropDuplicates(["rest", "rank"]).select("rest", "rank", "skip", "n", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        for batch in batches:
            out = []
            for ids, skip, sizes in zip(chain.from_iterable(tokens.of_column(batch.column("text"))), batch.column("skip").to_pylist(), batch.column("n").to_pylist()):
                at = np.cumsum([skip, *sizes]) * 4
                out.append([zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])])
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("rank"), pa.array(out, pa.list_(pa.int64()))], names=["rest", "rank", "crcs"])
            batch = ids = out = None
            give_back()

    return both.mapInArrow(run, "rest int, rank long, crcs array<long>")
