"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments and indexed by each segment's value. A query probes
all segment values within a growing radius: after radius s in each of m
segments, every code within m * (s + 1) - 1 bits has been met, so the search
ends as soon as the kth verified distance is no larger.

Codes and queries are dealt into blocks of bounded size; each pair of blocks is
one task's work, and a query's results from all blocks are merged.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BITS = 64
INDEX_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 10
BATCH = 64


def sign_code(embedding: Column) -> Column:
    """64-bit code: a bit for each of the first 64 components, 1 where it is above 0; absent or null ones give 0."""
    bit = F.transform(F.slice(embedding, 1, BITS), lambda x: F.when(x > 0, 1).otherwise(0))
    full = F.concat(bit, F.array_repeat(F.lit(0), F.lit(BITS) - F.size(bit)))
    return F.aggregate(full, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


class Index:
    def __init__(self, codes: np.ndarray, ids: np.ndarray, k: int) -> None:
        order = np.lexsort((ids, codes))
        codes, ids = codes[order], ids[order]
        self.codes, first, count = np.unique(codes, return_index=True, return_counts=True)
        self.ids, self.first, self.count = ids, first, np.minimum(count, k + 1)  # ids beyond k + 1 of one code lose every tie
        self.k = k
        n = len(self.codes)
        self.m = max(1, min(8, round(BITS / max(1.0, np.log2(max(n, 2))))))
        self.m = max(self.m, 4)  # segments of 16 bits at most
        edges = np.linspace(0, BITS, self.m + 1).round().astype(int)
        self.low = [np.uint64(e) for e in edges[:-1]]
        self.width = [int(w) for w in np.diff(edges)]
        self.mask = [np.uint64((1 << w) - 1) for w in self.width]
        self.rows, self.offsets = [], []
        for j in range(self.m):
            v = self.segment(self.codes, j).astype(np.int64)
            self.rows.append(np.argsort(v, kind="stable"))
            self.offsets.append(np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << self.width[j]))]))
        self.flips: dict[tuple[int, int], np.ndarray] = {}

    def segment(self, codes: np.ndarray, j: int) -> np.ndarray:
        return (codes >> self.low[j]) & self.mask[j]

    def flip(self, width: int, s: int) -> np.ndarray:
        if (width, s) not in self.flips:
            self.flips[width, s] = np.array([sum(1 << i for i in c) for c in combinations(range(width), s)], np.int64)
        return self.flips[width, s]

    def hits(self, q: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, code) first met at radius s: their least segment distance is s."""
        found = []
        for j in range(self.m):
            if s > self.width[j]:
                continue
            probe = self.segment(q, j).astype(np.int64)[:, None] ^ self.flip(self.width[j], s)
            lo = self.offsets[j][probe]
            n = self.offsets[j][probe + 1] - lo
            per_query = n.sum(axis=1)
            qi = np.repeat(np.arange(len(q)), per_query)
            lo, n = lo.ravel(), n.ravel()
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ci = self.rows[j][at]
            x = q[qi] ^ self.codes[ci]
            keep = np.ones(len(x), bool)
            for i in range(self.m):
                if i != j:
                    w = np.bitwise_count(self.segment(x, i))
                    keep &= (w > s) | ((w == s) & (i > j))
            found.append((qi[keep], ci[keep]))
        return np.concatenate([a for a, _ in found] or [np.zeros(0, int)]), np.concatenate([b for _, b in found] or [np.zeros(0, int)])

    def search(self, q: np.ndarray, q_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, distance) of at least the k nearest of each query, itself left out, ties complete."""
        out = []
        reach = np.full(len(q), BITS + 1)  # kth distance so far
        tally = np.zeros((len(q), BITS + 2), np.int64)
        own = np.searchsorted(self.codes, q)
        own = (own < len(self.codes)) & (self.codes[np.minimum(own, len(self.codes) - 1)] == q)
        tally[:, 0] -= own  # a query's own row may be among them
        active = np.arange(len(q))
        for s in range(max(self.width) + 1):
            qi, ci = self.hits(q[active], s)
            qi = active[qi]
            d = np.bitwise_count(q[qi] ^ self.codes[ci]).astype(np.int64)
            np.add.at(tally, (qi, d), self.count[ci])
            met = np.cumsum(tally[active], axis=1) >= self.k
            reach[active] = np.where(met.any(axis=1), met.argmax(axis=1), BITS + 1)
            keep = d <= reach[qi]
            out.append((qi[keep], ci[keep], d[keep]))
            active = active[reach[active] > self.m * (s + 1) - 1]
            if not len(active):
                break
        qi, ci, d = (np.concatenate(x) for x in zip(*out))
        keep = d <= reach[qi]
        qi, ci, d = qi[keep], ci[keep], d[keep]
        n = self.count[ci]
        at = np.repeat(self.first[ci] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        qi, d, ids = np.repeat(qi, n), np.repeat(d, n), self.ids[at]
        other = ids != q_ids[qi]
        return qi[other], ids[other], d[other]


def _block(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(index) and len(queries):
            held = Index(index["code"].to_numpy(np.int64).view(np.uint64), index["id"].to_numpy(np.int64), k)
            codes, ids = queries["code"].to_numpy(np.int64).view(np.uint64), queries["id"].to_numpy(np.int64)
            for i in range(0, len(codes), BATCH):
                qi, found, d = held.search(codes[i : i + BATCH], ids[i : i + BATCH])
                order = np.lexsort((found, d, qi))
                qi, found, d = qi[order], found[order], d[order]
                rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
                top = rank < k
                got.append(pd.DataFrame({"query_id": ids[i : i + BATCH][qi[top]], "id": found[top], "distance": d[top]}))
        return pd.concat(got) if got else pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "distance": np.zeros(0, np.int64)})

    return run


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """codes and queries: (id, code). Returns query_id, rank (from 1), id, distance.

    The k nearest codes of each query by Hamming distance, ties by smaller id,
    the query's own id left out; fewer only where there are fewer codes. Rows
    with a null id or code take no part; repeated rows count once; an empty
    table gives an empty result.
    """
    codes = C.materialize(codes.dropna().distinct(), "codes")
    queries = C.materialize(queries.dropna().distinct(), "queries")
    n_index, n_query = -(-codes.count() // INDEX_BLOCK) or 1, -(-queries.count() // QUERY_BLOCK) or 1
    mine = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = codes.select("id", "code", mine(n_index).alias("ib"), every(n_query).alias("qb"))
    right = queries.select("id", "code", mine(n_query).alias("qb"), every(n_index).alias("ib"))
    near = left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInPandas(_block(k), "query_id long, id long, distance long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def embedding_search(embeddings: DataFrame, k: int = 10, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, distance: every row whose id is divisible by ``every`` against all rows. Other columns are ignored."""
    codes = embeddings.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(codes, codes.where(F.col("id") % every == 0), k).withColumnRenamed("id", "vec_id")


def oracle_sql() -> str:
    """The same by brute force in DuckDB's SQL."""
    return """
    WITH c AS (SELECT vec_id, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS code
               FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS BIGINT) AS distance
          FROM c AS q JOIN c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance
    FROM p QUALIFY rank <= 10
    """
