"""Hierarchical Pitman-Yor language model after the two words before.

A token is drawn in two steps, each from restaurants of the words themselves: its
class after the two words before, then the word within its class after them.

Classes: each of the OWN most frequent words is a class of its own, the others
share N_DISH - OWN classes by their last bytes. Class restaurants after the two
words before have those after the word before and the folded class of the one
before that as parents, whose base is the model of classes after classes
(``pitman_yor.class_model``). Word restaurants after the two words before have
those after the word before as parents, these the one without context, whose
base is diffuse: there all customers of a word share a table. A large class is
cut into sections by word, with a share for each.

The restaurants grow with the corpus and nothing of them is collected or
broadcast. All class restaurants after a word and a folded class lie in one
bucket, and so do all word restaurants of a section; each bucket is seated by
itself, with its own discounts, by the same Gibbs sweeps as the classes. Every
token goes once to the bucket of its class restaurants and once, unless it has a
class of its own, to that of its word restaurants, in compressed blocks, where the
most frequent words stand by their ranks and the others by hashes. There it is
counted, and scored when its bucket is seated; sums go back by document.
"""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .flat import buffers, give_back, pieces
from .minhash import _mix
from .pitman_yor import CLASS_KEPT, CLASS_SWEEPS, END, FOLDED, FOLDS, HELD_OUT, N_CTX, N_DISH, STRENGTH, SUFFIX, class_model, discount_of

#: Words with a class of their own, at most; class 0 is the end.
OWN = 256
#: Words that have a number of two bytes in blocks, at most; the others stand there by their hashes.
COMMON = (1 << 16) - 2
#: Class cells that are summed in one place, and written as one block.
RANGE = 1 << 16
#: Tokens a task counts or packs at once.
CHUNK = 4_000_000
#: Learned tokens of a bucket, about, and of a section of a class.
BUCKET = 1_000_000
#: Words of more bytes are hashed one by one.
LONG = 64
#: Fewer restaurants than this take their turns one by one.
FEW = 24
#: Documents that one task puts together: 2 ** DEST at most.
DEST = 15

CLASSES, WORDS, DOCS = 0, 1, 2  # kinds of blocks


def _key(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    for x in more:
        first = _mix(first * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64))
    return first


class Common:
    """The most frequent words: their ranks, from 1; hashes and classes by rank. Rank 0 is the end."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = pa.array([END, *words], pa.large_binary())
        data, at = buffers(self.words)
        self.hashes, self.classes = _hashes(data, at), np.r_[np.arange(OWN), _classes(data, at)[OWN:]][: len(self.words)]

    @property
    def rank(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48-bit hashes of words."""
    n = np.diff(at)
    h = n.astype(np.uint64)
    eight = np.ndarray(len(data) + 1, "<u8", np.r_[data, np.zeros(8, np.uint8)], strides=(1,))  # the eight bytes from each place on
    for i in range(0, min(LONG, int(n.max(initial=0))), 8):
        has = np.flatnonzero(n > i)
        beyond = (8 * np.maximum(i + 8 - n[has], 0)).astype(np.uint64)
        h[has] = _key(h[has], eight[at[has] + i] << beyond)
    h &= np.uint64((1 << 48) - 1)
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[at[i] : at[i + 1]].tobytes(), digest_size=6).digest(), "little")
    return h


def _crc(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ 0xEDB88320 * (i & 1)
    return i


_CRC = np.array([_crc(i) for i in range(256)], np.uint32)


def _classes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes of words that have none of their own: by crc32 of the last SUFFIX bytes."""
    end, n = at[1:], np.diff(at)
    crc = np.full(len(n), 0xFFFFFFFF, np.uint32)
    for back in range(SUFFIX, 0, -1):
        has = np.flatnonzero(n >= back)
        c = crc[has]
        crc[has] = _CRC[(c ^ data[end[has] - back]) & 255] ^ (c >> 8)
    return OWN + (~crc % np.uint32(N_DISH - OWN)).astype(np.int64)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts, A-Z in lower case: their bytes one after another, their lengths, and how many each text has."""
    low = np.frombuffer(data.tobytes().lower(), np.uint8)
    inside = (low != 32) & (low - np.uint8(9) > 4)  # white space is the space and the control characters 9 to 13
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # texts part words too
    cut = at[(at > 0) & (at < len(low))]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    start = np.flatnonzero(first)
    return low[inside], np.flatnonzero(last) + 1 - start, np.diff(np.searchsorted(start, at))


def _encoded(batches: Iterator[pa.RecordBatch], fields: list[str]):
    """About CHUNK tokens at once: distinct words, the number of each word in them, words of each text, fields of the documents."""

    def chunk():
        lengths = np.concatenate([n for _, n, _ in got])
        at = np.r_[0, np.cumsum(lengths)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.concatenate([d for d, _, _ in got]))])
        words = words.dictionary_encode()
        return words.dictionary, words.indices.to_numpy(), np.concatenate([n for _, _, n in got]), [pa.concat_arrays(c) for c in zip(*rows)]

    got, rows, waiting = [], [], 0
    for batch in batches:
        for lo, hi, data, at in pieces(batch.column("text")):
            got.append(_words(data, at))
            waiting += len(got[-1][1]) + hi - lo
            rows.append([batch.column(f).slice(lo, hi - lo) for f in fields])
            if waiting > CHUNK:
                done = [chunk()]
                got, rows, waiting = [], [], 0
                yield done.pop()  # nothing of it stays here
    if got:
        done = [chunk()]
        del got, rows
        yield done.pop()


def _chunks(batches: Iterator[pa.RecordBatch], common: Common, fields: list[str], hashed: bool = True):
    """(u, v, w, document, lengths, (hashes, classes, ranks), fields of the documents): tokens as numbers, w after v after u.

    0 stands before a text, 1 for its end; ranks are -1 for words that are not common.
    """
    for words, number, n, rows in _encoded(batches, fields):
        data, at = buffers(words)
        rank = pc.index_in(words, value_set=common.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        cls = np.r_[0, 0, np.where((rank >= 0) & (rank < OWN), rank, _classes(data, at))].astype(np.int32)
        hashes = np.r_[np.uint64(0), common.hashes[:1], _hashes(data, at)] if hashed else np.zeros(0, np.uint64)
        rank = np.r_[np.int32(-1), np.int32(0), rank]
        n = n + 1
        end = np.cumsum(n) - 1
        start = end + 1 - n
        w = np.ones(int(n.sum()), np.uint32)
        inside = np.ones(len(w), bool)
        inside[end] = False
        w[inside] = number + 2
        del words, number, data, at, inside
        v, u = np.zeros_like(w), np.zeros_like(w)
        v[1:], u[2:] = w[:-1], w[:-2]
        v[start] = u[start] = 0
        u[(start + 1)[n > 1]] = 0
        done = [(u, v, w, np.repeat(np.arange(len(n), dtype=np.int32), n), n, (hashes, cls, rank), rows)]
        del u, v, w, hashes, cls, rank, rows
        yield done.pop()


def common_words(docs: DataFrame) -> Common:
    """docs: the texts learned from. Classes go by the first ranks, the rest only makes blocks shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, number, _, _ in _encoded(batches, []):
            counts = np.bincount(number, minlength=len(words))
            # those over 1 in 50,000 in any case, which decide the classes
            least = min(len(number) / 50_000, max(2, np.partition(counts, -COMMON)[-COMMON] + 1 if len(counts) > COMMON else 2))
            got = counts >= least
            yield pa.RecordBatch.from_arrays([words.filter(pa.array(got)).cast(pa.binary()), pa.array(counts[got], pa.int64())], names=["word", "n"])
            del words, number, counts, got
        give_back()

    got = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = C.materialize(got, "lm-common")
    # all down to a count, by eighths of octaves: a high limit would send many rows through one task
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    steps = sorted(got.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r.step)
    sizes = np.cumsum([r.words for r in steps])
    fit = int((sizes <= COMMON).sum())
    if fit and (sizes[fit - 1] >= OWN - 1 or fit == len(steps)):
        rows = got.where(F.col("n") >= steps[fit - 1].least)
    else:
        rows = got.orderBy(F.desc("n"), "word").limit(OWN - 1)
    rows = rows.toArrow()
    words = sorted(zip(rows["n"].to_pylist(), rows["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    C.discard(got)
    return Common([w for _, w in words])


def class_cells(docs: DataFrame, common: Common) -> pa.Table:
    """key (context * N_DISH + class), n: customers of the classes after classes, N_CTX * N_DISH rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(N_CTX * N_DISH, np.int64)
        for u, v, w, _, _, (_, cls, _), _ in _chunks(batches, common, [], hashed=False):
            sums += np.bincount(((cls[u] % FOLDED) * N_DISH + cls[v]) * N_DISH + cls[w], minlength=len(sums))
        for part in range(-(-len(sums) // RANGE)):
            n = sums[part * RANGE : (part + 1) * RANGE]
            at = np.flatnonzero(n)
            if len(at):
                data = _planes(np.diff(at, prepend=0), 4) + _planes(n[at], 6)
                block = np.array([len(at)], np.int64).tobytes() + pa.compress(data, "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block], pa.binary())], names=["part", "block"])
        del sums
        give_back()

    def summed(group: pa.Table) -> pa.Table:
        sums = np.zeros(RANGE, np.int64)
        for block in group["block"].to_pylist():
            m = int(np.frombuffer(block, np.int64, 1)[0])
            data = pa.decompress(memoryview(block)[8:], 10 * m, "zstd", asbytes=True)
            sums[np.cumsum(_values(data, 0, m, 4))] += _values(data, 4 * m, m, 6).astype(np.int64)
        at = np.flatnonzero(sums)
        return pa.table({"key": pa.array(at + group["part"][0].as_py() * RANGE), "n": pa.array(sums[at])})

    got = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "part long, block binary")
    return C.materialize(got.groupBy("part").applyInArrow(summed, "key long, n long"), "lm-cells").toArrow().sort_by("key")


def _planes(x: np.ndarray, size: int) -> bytes:
    width = 8 if size > 4 else 4
    return np.ascontiguousarray(x.astype(f"u{width}").view(np.uint8).reshape(len(x), width)[:, :size].T).tobytes()


def _values(data: bytes, at: int, n: int, size: int) -> np.ndarray:
    width = 8 if size > 4 else 4
    out = np.zeros((n, width), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T
    return out.view(f"u{width}").ravel()


def _pack(doc: np.ndarray, cols: list[np.ndarray], named: int, hashes: np.ndarray, cls: np.ndarray, ranks: np.ndarray | None = None) -> bytes:
    """A block of rows: documents in rising order, the first ``named`` columns numbers of words.

    Words are numbered in the order in which they first stand in the block, and
    0 is written there; the rest are written as their number plus one. In that
    order follow the ranks of common words plus one, 0 for the others, whose
    hashes follow, and classes: of all, or of those in the last column alone
    where all columns are named.
    """
    n = len(doc)
    words = np.concatenate(cols[:named])
    if len(words) * 16 > len(hashes):
        at = np.full(len(hashes), len(words))
        at[words[::-1]] = np.arange(len(words) - 1, -1, -1)  # of repeated places the last one written stays
        used = np.flatnonzero(at < len(words))
        used = used[np.argsort(at[used])]
        number = at
        first = at[used]
        number[used] = np.arange(len(used))
        inv = number[words]
    else:
        used, first, inv = np.unique(words, return_index=True, return_inverse=True)
        order = np.argsort(first)
        used, first = used[order], first[order]
        inv = np.argsort(order)[inv]
    written = inv + 1
    written[first] = 0
    of = cls[used]
    if named == len(cols):
        dish = np.zeros(len(used), bool)
        dish[inv[-n:]] = True
        of = of * dish
    rank = ranks[used] + 1 if ranks is not None else np.zeros(len(used), np.int64)
    rest = np.flatnonzero(rank == 0)
    columns = (_planes(c, 4) for c in (np.diff(doc, prepend=0), *written.reshape(named, n), *cols[named:]))
    data = b"".join([*columns, _planes(rank, 2), _planes(of[rest], 2), _planes(hashes[used[rest]], 6)])
    return np.array([n, len(used), len(rest)], np.int64).tobytes() + pa.compress(data, "zstd", asbytes=True)


def _unpack(block: bytes, columns: int, named: int, common: Common | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Documents; hashes of the named columns, then the others; classes of the named ones."""
    n, m, r = (int(x) for x in np.frombuffer(block, np.int64, 3))
    data = pa.decompress(memoryview(block)[24:], 4 * n * (columns + 1) + 2 * m + 8 * r, "zstd", asbytes=True)
    doc, *cols = (_values(data, 4 * n * i, n, 4) for i in range(columns + 1))
    at = 4 * n * (columns + 1)
    rank = _values(data, at, m, 2).astype(np.int64) - 1
    cls, hashes = (common.classes[rank], common.hashes[rank]) if common is not None else (np.zeros(m, np.int64), np.zeros(m, np.uint64))
    rest = rank < 0
    cls[rest], hashes[rest] = _values(data, at + 2 * m, r, 2), _values(data, at + 2 * m + 2 * r, r, 6)
    words = np.concatenate(cols[:named]).astype(np.int64) - 1
    words[words < 0] = np.arange(m)
    words = words.reshape(named, n)
    return np.cumsum(doc.astype(np.int64)), [*hashes[words], *cols[named:]], [*cls[words]]


def _alone(c: float, p: float, others: float, d: float, draw: random.Random, n: float = 1, t: int = 1) -> int:
    """``seat`` for one dish, from n customers at t tables on.

    With z = n - d * t the next customer opens a table with probability
    w / (z + w). The waits are thinned: no customer up to m later is proposed with
    probability ((z - 1) / (z - 1 + m)) ** w, so one is proposed with
    1 - (1 - 1 / z) ** w, never less than w / (z + w), and kept by the ratio.
    """
    coin, rise = draw.random, d * p
    w, z = max((STRENGTH + d * (others + t)) * p, 1e-300), n - d * t
    while n < c:
        if z < 4 * w or z < 2 or c - n < 6:
            n += 1
            z += 1
            if coin() * (z - 1 + w) < w:
                t += 1
                w += rise
                z -= d
            continue
        wait = -math.log(1 - coin()) / w
        if wait >= math.log1p((c - n) / (z - 1)):
            break
        skipped = int((z - 1) * math.expm1(wait))
        n += skipped + 1
        z += skipped + 1
        if n > c:
            break
        if coin() * -math.expm1(w * math.log1p(-1 / (z - 1))) < w / (z - 1 + w):
            t += 1
            w += rise
            z -= d
    return t


def seat(customers: np.ndarray, parent: np.ndarray, others: np.ndarray, d: float, rng: np.random.Generator, draw: random.Random) -> np.ndarray:
    """The draw of ``pitman_yor.seat``, the last few dishes with customers left one by one."""
    t = (customers > 0).astype(np.float64)
    n = t.copy()
    here = np.flatnonzero(customers > 1)
    while len(here) >= FEW:
        w = np.maximum((STRENGTH + d * (others[here] + t[here])) * parent[here], 1e-300)
        q = rng.beta(w, n[here] - d * t[here])
        with np.errstate(divide="ignore", over="ignore"):
            wait = np.floor(np.log(1 - rng.random(len(here))) / np.log1p(-np.minimum(q, 1 - 1e-16))) + 1
        at = n[here] + wait
        opens = at <= customers[here]  # False also where the wait is endless
        here, at = here[opens], at[opens]
        t[here] += 1
        n[here] = at
        here = here[at < customers[here]]
    for i in here.tolist():
        t[i] = _alone(float(customers[i]), float(parent[i]), float(others[i]), d, draw, int(n[i]), int(t[i]))
    return t


def _turns(ctx: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of two customers or more, and of the restaurants that have any, the largest first, where theirs begin and how many they are. ctx is sorted."""
    order = np.flatnonzero(c > 1)
    g = ctx[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(g)])
    by = np.argsort(-size, kind="stable")
    return order, first[by], size[by]


def seat_in_turn(turns: tuple[np.ndarray, np.ndarray, np.ndarray], ctx: np.ndarray, c: np.ndarray, t: np.ndarray, parent: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Seats all dishes anew, those of a restaurant in turn. A single customer has one table and takes no turn.

    turns: of ``_turns``; parent: of its cells.
    """
    t = np.minimum(np.maximum(t, 1), c)
    order, first, size = turns
    if not len(order):
        return t
    tables = np.bincount(ctx, weights=t)
    g, c, seated = ctx[order], c[order], t[order]
    draw = random.Random(int(rng.integers(2**62)))
    turn = 0
    while (m := int(np.searchsorted(-size, -turn))) >= FEW:  # those with dishes left are the first m
        k = first[:m] + turn
        others = tables[g[k]] - seated[k]
        seated[k] = new = seat(c[k], parent[k], others, d, rng, draw)
        tables[g[k]] = others + new
        turn += 1
    for at, n in zip(first[:m].tolist(), size[:m].tolist()):
        dishes = slice(at + turn, at + n)
        total, old = tables[g[at]], seated[dishes].tolist()
        for i, (x, p) in enumerate(zip(c[dishes].tolist(), parent[dishes].tolist())):
            new = _alone(x, p, total - old[i], d, draw)
            total += new - old[i]
            old[i] = new
        seated[dishes] = old
    t[order] = seated
    return t


def probabilities(c: np.ndarray, ctx: list[np.ndarray], up: list[np.ndarray], base: np.ndarray | None, rng: np.random.Generator) -> np.ndarray:
    """Mean probability of each lowest cell over the last sweeps.

    c: customers of the lowest cells; ctx: restaurants of the cells of each
    level, rising; up: their cells in the level above. base: of each cell of the
    highest level; without one that level is diffuse.
    """
    depth = len(ctx)
    cs, ts = [c.astype(np.float64)], []
    for i in range(depth):
        ts.append(np.minimum(cs[i], 1.0))
        if i + 1 < depth:
            cs.append(np.bincount(up[i], weights=ts[i], minlength=len(ctx[i + 1])))
    ds = [discount_of((x == 1).sum(), (x == 2).sum()) for x in cs]
    lowest = _turns(ctx[0], cs[0])  # their customers stay
    total = np.zeros(len(c))
    for turn in range(CLASS_SWEEPS):
        kept = turn >= CLASS_SWEEPS - CLASS_KEPT
        ps = [None] * depth
        for i in range(depth - 1, -1 if kept else 0, -1):  # the lowest ones serve the mean alone
            share = 1 / (STRENGTH + np.bincount(ctx[i], weights=cs[i]))
            free = (STRENGTH + ds[i] * np.bincount(ctx[i], weights=ts[i])) * share
            if i == depth - 1 and base is None:
                ps[i] = np.where(cs[i] > 0, (cs[i] - ds[i]) * share[ctx[i]], free[ctx[i]])
            else:
                p = free[ctx[i]]
                p *= base if i == depth - 1 else ps[i + 1][up[i]]
                p += np.maximum(cs[i] - ds[i] * ts[i], 0) * share[ctx[i]]
                ps[i] = p
        if kept:
            total += ps[0]
        if turn == CLASS_SWEEPS - 1:
            break  # a seating after the last probabilities would serve nothing
        for i in range(depth):
            if i:
                cs[i] = np.bincount(up[i - 1], weights=ts[i - 1], minlength=len(ctx[i]))
            if i == depth - 1 and base is None:
                ts[i] = np.minimum(cs[i], 1.0)
            else:
                turns = _turns(ctx[i], cs[i]) if i else lowest
                parent = base[turns[0]] if i == depth - 1 else ps[i + 1][up[i][turns[0]]]
                ts[i] = seat_in_turn(turns, ctx[i], cs[i], ts[i], parent, ds[i], rng)
    return total / CLASS_KEPT


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which ``x`` rises, and there the number of each distinct value."""
    order = np.argsort(x)
    x = x[order]
    new = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
    del x
    return order, np.cumsum(new, dtype=np.int32) - np.int32(1)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, in rising order, and which value each is."""
    order, number = _sorted(x)
    which = np.empty(len(order), np.int32)
    which[order] = number
    return order[np.flatnonzero(np.diff(number, prepend=np.int32(-1)))], which


def _cells(restaurant: np.ndarray, dish: np.ndarray, few: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of each cell, those of a restaurant one after another; the cell of each row; the restaurants of the cells, rising.

    few: all dishes are below N_DISH; then they stand beside 55 bits of the
    restaurant's hash, and one sort serves for both.
    """
    if few:
        low = np.uint64(N_DISH - 1)
        key = restaurant & ~low | dish.astype(np.uint64)
        at, which = _distinct(key)
        r = key[at] & ~low
        new = np.r_[False, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
        return at, which, np.cumsum(new, dtype=np.int32)
    at, which = _distinct(_key(restaurant, dish))
    order, ctx = _sorted(restaurant[at])
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return at[order], place[which], ctx


def score_bucket(root: np.ndarray, v: np.ndarray, u: np.ndarray, dish: np.ndarray, learn: np.ndarray, base, rng: np.random.Generator):
    """log10 probability of each row; without a base also the rows' cells at the root and the learned rows of those.

    The restaurants: after u and v within root, after v within root and, without
    a base, root itself; base: probability of the row's dish in its root, or a
    function of the roots and dishes that gives it.
    """
    after = _key(root.astype(np.uint64), v)
    both = _key(after, u)
    del u, v
    few = base is not None and int(dish.max(initial=0)) < N_DISH
    one, inv, ctx = _cells(both, dish, few)
    del both
    c, ctx = np.bincount(inv, weights=learn), [ctx]
    after, dish, root = after[one], dish[one], root[one]
    two, up, above = _cells(after, dish, few)
    ctx.append(above)
    dish, root = dish[two], root[two]
    if base is not None:
        base = base(root, dish) if callable(base) else base[one][two]
        return np.log10(np.maximum(probabilities(c, ctx, [up], base, rng), 1e-300))[inv]
    three, top, above = _cells(root.astype(np.uint64), dish, False)
    ctx.append(above)
    p = probabilities(c, ctx, [up, top], None, rng)
    word = top[up]
    return np.log10(np.maximum(p, 1e-300))[inv], word[inv], np.bincount(word, weights=c)


def _to_bytes(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def score(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from rows outside the held-out fold (crc32 of the id as text; a null
    id counts as an empty text). Null and empty texts have the end token alone.
    Repeated rows all count and are each scored; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    held = C.crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    learned = docs.where(~F.col("held_out"))
    common = common_words(learned)
    cells = class_cells(learned, common)
    keys, customers = cells["key"].to_numpy(), cells["n"].to_numpy()
    of_class = np.bincount(keys % N_DISH, weights=customers, minlength=N_DISH)
    n = int(of_class.sum())
    sections = np.maximum(np.ceil(of_class / BUCKET), 1).astype(np.int64)
    offset = np.cumsum(sections) - sections
    buckets = [int(np.ceil(x / BUCKET)) + 1 for x in (n, of_class[OWN:].sum())]
    single_of = np.arange(N_DISH) < OWN
    known_of, base_of = (single_of & (of_class > 0)).astype(np.float64), np.where(single_of, np.log10(of_class + 0.5), 0)
    shared = spark.sparkContext.broadcast((common, 10.0 ** class_model(keys, customers.astype(np.float64), seed)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v, w, doc, lengths, (hashes, cls, ranks), (keys, ids, held) in _chunks(batches, shared.value[0], ["key", "doc_id", "held_out"]):
            key, k = keys.to_numpy(), cls[w]
            low = int(key.min())
            code = ((key - low) * 2 + ~held.to_numpy(zero_copy_only=False)).astype(np.uint32)[doc]
            single = k < OWN
            known = np.bincount(doc, weights=known_of[k], minlength=len(key)).astype(np.int64)
            base = np.bincount(doc, weights=base_of[k], minlength=len(key))
            del doc
            out = []
            cuts = np.r_[0, np.flatnonzero(np.diff(key >> DEST)) + 1, len(key)]
            for i, j in zip(cuts, cuts[1:]):
                part = {"key": keys[i:j], "known": pa.array(known[i:j]), "base": pa.array(base[i:j]), "doc_id": ids[i:j], "held_out": held[i:j], "n_tokens": pa.array(lengths[i:j])}
                out.append((DOCS, int(key[i] >> DEST), 0, _to_bytes(part)))
            to = np.empty(len(w), np.uint32)
            for i in range(0, len(w), 1 << 18):
                j = i + (1 << 18)
                to[i:j] = _key(hashes[v[i:j]], cls[u[i:j]] % FOLDED) % np.uint64(buckets[CLASSES])
            rare = np.flatnonzero(~single)
            rk, rw = k[rare], hashes[w[rare]]
            section = offset[rk] + (rw % sections[rk].astype(np.uint64)).astype(np.int64)
            for kind, at, rows in ((CLASSES, to, None), (WORDS, section % buckets[WORDS], rare)):
                at = at.astype(np.uint32)
                order = np.argsort(at.astype(np.uint16) if buckets[kind] < 1 << 16 else at, kind="stable")
                at = at[order]
                order = order if rows is None else rows[order]
                cuts = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)] if len(at) else [0]
                for i, j in zip(cuts, cuts[1:]):
                    x = order[i:j]
                    cols, named = ([u[x], v[x], k[x]], 2) if kind == CLASSES else ([u[x], v[x], w[x]], 3)
                    out.append((kind, int(at[i]), low, _pack(code[x], cols, named, hashes, cls, ranks)))
            del u, v, w, k, code, single, to, rare, rk, rw, section, at, order, rows, x, cols, hashes, cls, ranks
            for i in range(0, len(out), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 16]), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["kind", "bucket", "low", "block"])
            del out
            give_back()

    def seated(group: pa.Table) -> pa.Table:
        kind, bucket = group["kind"][0].as_py(), group["bucket"][0].as_py()
        schema = pa.schema([("dest", pa.int64()), ("types", pa.int64()), ("block", pa.binary())])
        if kind == DOCS:
            return pa.table([group["bucket"], pa.nulls(len(group), pa.int64()), group["block"]], schema=schema)
        group = group.sort_by("low")  # the same order in every run
        named = 2 if kind == CLASSES else 3
        parts = []
        for low, block in zip(group["low"].to_pylist(), group["block"]):
            d, (u, v, dish), k = _unpack(block.as_buffer(), 3, named, shared.value[0])
            root = (k[0].astype(np.int32) % FOLDED * N_DISH + k[1]).astype(np.int32) if kind == CLASSES else k[2].astype(np.int32)
            parts.append((d + 2 * low, u, v, dish.astype(np.int32) if kind == CLASSES else dish, root))
        parts = list(zip(*parts))[::-1]
        code, u, v, dish, root = (np.concatenate(parts.pop()) for _ in range(5))
        learn = (code & 1).astype(np.int8)
        key = code >> 1
        del code, group
        rng = np.random.default_rng([seed, kind, bucket])
        types, base, known = None, None, None
        if kind == CLASSES:
            # the restaurants after v take its folded neighbour in, as their base does
            rows, table = [dish, u, v, root], shared.value[1]
            del u, v, dish, root
            lp = score_bucket(rows.pop(), rows.pop(), rows.pop(), rows.pop(), learn, lambda root, dish: table[root, dish].astype(np.float64), rng)
        else:
            k = root
            root = offset[k] + (dish % sections[k].astype(np.uint64)).astype(np.int64)
            lp, word, count = score_bucket(root, v, u, dish, learn, None, rng)
            del u, v, dish
            inside = np.bincount(root, weights=learn)[root]
            lp += np.log10((inside + STRENGTH / sections[k]) / (of_class[k] + STRENGTH))
            types, known, base = int((count > 0).sum()), (count > 0)[word], np.log10(count + 0.5)[word]
        new = np.r_[True, key[1:] != key[:-1]]  # rows are in the order of documents
        keys, inv = key[new], np.cumsum(new) - 1
        sums = {"key": pa.array(keys), "lp": pa.array(np.bincount(inv, weights=lp).astype(np.float32))}
        if kind == WORDS:
            sums |= {"known": pa.array(np.bincount(inv, weights=known).astype(np.int64)), "base": pa.array(np.bincount(inv, weights=base))}
        cuts = np.r_[0, np.flatnonzero(np.diff(keys >> DEST)) + 1, len(keys)]
        rows = [(int(keys[i] >> DEST), None, _to_bytes({c: x[i:j] for c, x in sums.items()})) for i, j in zip(cuts, cuts[1:])]
        rows.append((-1, types, None))
        out = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        del rows, sums, lp, known, base, key, keys, inv, new, learn, parts
        give_back()
        return out

    def summed(group: pa.Table) -> pa.Table:
        names = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64()), ("types", pa.int64())]
        dest = group["dest"][0].as_py()
        if dest < 0:
            types = sum(x for x in group["types"].to_pylist() if x)
            return pa.table([*(pa.nulls(1, t) for _, t in names[:-1]), pa.array([types])], names=[c for c, _ in names])
        parts = [pa.ipc.open_stream(b.as_py()).read_all() for b in group["block"]]
        whole = pa.concat_tables([p for p in parts if "doc_id" in p.column_names])
        order = whole["key"].to_numpy()
        known, base, lp = whole["known"].to_numpy().copy(), whole["base"].to_numpy().copy(), np.zeros(len(order))
        sorter = np.argsort(order)
        for p in parts:
            if "doc_id" not in p.column_names:
                at = sorter[np.searchsorted(order, p["key"].to_numpy(), sorter=sorter)]
                lp[at] += p["lp"].to_numpy()
                if "known" in p.column_names:
                    known[at] += p["known"].to_numpy()
                    base[at] += p["base"].to_numpy()
        return pa.table([whole["doc_id"], whole["held_out"], whole["n_tokens"], pa.array(known), pa.array(base), pa.array(lp), pa.nulls(len(order), pa.int64())], names=[c for c, _ in names])

    # `key` numbers the rows within this one pass
    inner = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "held_out", F.col("text").cast("binary").alias("text"))
    blocks = inner.mapInArrow(pack, "kind long, bucket long, low long, block binary")
    sums = blocks.groupBy("kind", "bucket").applyInArrow(seated, "dest long, types long, block binary")
    out = sums.groupBy("dest").applyInArrow(summed, "doc_id long, held_out boolean, n_tokens long, known long, base double, lp double, types long")
    out = C.materialize(out, "lm-scores")
    types = int(out.agg(F.sum("types")).first()[0] or 0) + int((of_class[:OWN] > 0).sum())
    each = float(np.log10(n + 0.5 * (types + 1)))
    return out.where("types IS NULL").select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(each)).alias("base_score"), F.col("lp").alias("score"),
    )
