"""Exact top-k search by inner product with MaxScore over shards.

Every dimension is a term. In a shard, a vector's impact for a query's term is how far its product with the query's weight lies above the shard's least; a term's postings are
the shard's vectors by falling impact, and its bound is the largest impact. Given a threshold (the k-th best score known), the terms with the smallest bounds are non-essential
as long as their bounds together can't lift a vector over it; what is left of the threshold is shared out among the others, the essential terms, as impacts that needn't be
looked at. So only vectors in the upper part of an essential term's postings are candidates; no other can reach the threshold. Candidates are scored on the essential terms,
and the others are probed, one after another, for those that are still competitive. Shards and blocks of queries meet by a join on their numbers; each pair
yields at most k rows a query, and these are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors in a shard and of queries in a block.
SHARD_BYTES, BLOCK_BYTES = 1 << 22, 1 << 24
#: Postings of each of the SEED_TERMS terms with the largest bounds that give the first threshold, and terms that are probed at a time.
SEEDS, SEED_TERMS, PROBES = 16, 4, 8
#: If one essential list has this share of the shard, every vector is a candidate.
ALL = 0.9
#: Whole numbers up to this are exact as doubles.
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(flat.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


class Shard:
    """The vectors of a shard by id, and the postings of its terms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = self.vectors.min(0), self.vectors.max(0)
        self.by_term = np.ascontiguousarray(self.vectors.T)
        #: of each term, the vectors by rising component; falling ones are the same backwards
        self.rising = np.argsort(self.by_term, 1, kind="stable")
        self.sorted = np.take_along_axis(self.by_term, self.rising, 1)
        #: postings that searches have looked at
        self.visited = 0

    def upper(self, term: int, weight: float, above: float) -> np.ndarray:
        """The postings of a term with an impact above a bound."""
        if weight > 0:
            k = int(np.searchsorted(self.sorted[term], self.low[term] + above / weight, "left"))
            return self.rising[term, max(0, k - 1) :]  # one more than needed, for what division rounds off
        k = int(np.searchsorted(self.sorted[term], self.high[term] + above / weight, "right"))
        return self.rising[term, : k + 1]

    def search(self, query: float, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors for one query, its own id left out; ties go to smaller ids."""
        bound = np.abs(weights) * (self.high - self.low)
        floor = np.minimum(weights * self.low, weights * self.high).sum()
        terms = np.argsort(-bound, kind="stable")
        terms = terms[: np.count_nonzero(bound)]
        others = self.ids != query
        seeds = np.unique(np.concatenate([np.zeros(0, np.int64), *(self.rising[t, -SEEDS:] if weights[t] > 0 else self.rising[t, :SEEDS] for t in terms[:SEED_TERMS])]).astype(np.int64))
        seeds = seeds[others[seeds]]
        self.visited += len(seeds)
        known = np.sort(self.vectors[seeds] @ weights)[::-1]
        least = known[k - 1] if len(known) >= k else -np.inf
        # the terms with the smallest bounds that together stay below the threshold
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0.0)  # rest[i]: bounds of terms i and later
        essential = int(np.argmax(floor + rest < least)) if floor + rest[-1] < least else len(terms)
        slack = least - floor - rest[essential]
        lists = [np.arange(len(self.ids))]
        if slack > 0 and essential:
            share = slack * bound[terms[:essential]] / bound[terms[:essential]].sum() * (1 - 1e-9)
            lists = [self.upper(t, weights[t], above) for t, above in zip(terms[:essential].tolist(), share.tolist(), strict=True)]
        candidate = others.copy()
        if max(map(len, lists)) < ALL * len(candidate):
            self.visited += sum(map(len, lists))
            candidate[:] = False
            for part in lists:
                candidate[part] = True
            candidate &= others
        alive = np.flatnonzero(candidate)
        here = terms[:essential]
        self.visited += len(alive) * len(here)
        least_of = np.minimum(weights * self.low, weights * self.high)
        if 2 * len(alive) > len(candidate):  # whole columns, without picking cells
            score = (weights[here] @ self.by_term[here])[alive]
        else:
            score = weights[here] @ self.by_term[np.ix_(here, alive)]
        score += floor - least_of[here].sum()
        if len(score) > 4 * k:  # a better threshold: the full scores of the most promising
            top = alive[np.argpartition(score, -4 * k)[-4 * k :]]
            self.visited += len(top) * (len(terms) - essential)
            least = max(least, np.partition(self.vectors[top] @ weights, -k)[-k])
        for at in range(essential, len(terms), PROBES):
            stay = score + rest[at] >= least
            alive, score = alive[stay], score[stay]
            step = terms[at : at + PROBES]
            self.visited += len(alive) * len(step)
            score = score - least_of[step].sum() + weights[step] @ self.by_term[np.ix_(step, alive)]
        if len(score) > 4 * k:  # ties with the k-th best stay
            stay = score >= np.partition(score, -k)[-k]
            alive, score = alive[stay], score[stay]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive[best]], score[best]


def search_shard(shard_ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids and scores (64-bit whole numbers) of each query's k best of a shard. Where doubles aren't exact, by Python's whole numbers; scores beyond 64 bits are cut off there."""
    largest = np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * max(1, vectors.shape[1])
    out: tuple[list, list, list] = ([], [], [])
    shard = Shard(shard_ids, vectors) if 4 * largest < EXACT else None
    exact = None if shard else np.array([[int(x) for x in v] for v in np.rint(vectors).tolist()], object).reshape(vectors.shape)
    for q, weights in zip(query_ids.tolist(), queries, strict=True):
        if shard:
            ids, score = shard.search(q, weights, k)
            score = np.rint(score).astype(np.int64)
        else:
            full = [sum(a * b for a, b in zip(v, map(int, np.rint(weights).tolist()), strict=True)) for v in exact.tolist()]
            best = sorted((-max(-(2**63), min(2**63 - 1, s)), i) for s, i in zip(full, shard_ids.tolist(), strict=True) if i != q)[:k]
            ids, score = np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)
        for column, x in zip(out, (np.full(len(ids), q), ids, score), strict=True):
            column.append(x)
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)  # type: ignore[return-value]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """query_id, rank, vec_id, score (long): each query's k highest inner products with `vectors`, ties to smaller ids; the query's own id isn't its candidate.

    Components are whole numbers (others are exact to about nine digits); scores beyond 64 bits are cut off. Vectors that are null or hold null or non-finite
    components take no part, on either side; shorter vectors count as filled up with zeros. Fewer than k candidates: all. Repeated rows of an id each
    count; a null id takes no part; an empty table gives no rows; other columns aren't read. Every query meets every vector, in blocks: that is the search's definition, and rows
    that move are at most (vectors x blocks + queries x shards). Shards are dealt by id and vector, so that rows with one id spread.
    """
    parts, sizes = [], []
    for frame in (vectors, queries):
        good = frame.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        parts.append(good)
        sizes.append(good.agg(F.count("*"), F.max(F.size("v"))).first())
    width = max(s[1] or 0 for s in sizes)
    shards, blocks = (max(1, -(-s[0] * 8 * max(1, width) // n)) for s, n in zip(sizes, (SHARD_BYTES, BLOCK_BYTES), strict=True))
    part = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    left = parts[0].withColumn("shard", part(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = parts[1].withColumn("block", part(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if a.num_rows and b.num_rows:
            found = search_shard(a["id"].to_numpy(), _matrix(a["v"], width), b["id"].to_numpy(), _matrix(b["v"], width), k)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
