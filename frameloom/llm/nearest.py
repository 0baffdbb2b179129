"""Exact nearest neighbours by a block matrix join over int8 tiles."""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def usable(vec: Column) -> Column:
    """Not null, not zero, no null and no non-finite component."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values held as float32, scales, norms of what they stand for, norms of the error."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / np.where(scale > 0, scale, 1.0)[:, None])
    near = q * scale[:, None]
    return q.astype(np.float32), scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Block:
    """A block of queries of one length, and for each a heap of its k best candidates so far.

    The product of int8 tiles is exact in float32 up to 1,024 components and is summed in double
    beyond.  It differs from the true product by at most |q| * err(c) + |c8| * err(q).  A
    candidate whose upper bound is below the k-th best lower bound so far can't be among the k
    best; the others are recomputed in double precision and go through the query's heap.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        q8, self.qs, _, self.qe = quantised(q)
        self.q8 = q8.astype(np.float32 if q.shape[1] <= 1024 else np.float64)
        self.qn = np.linalg.norm(q, axis=1)
        self.best = np.full((len(q), k), -np.inf)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]

    def meet(self, c_ids: np.ndarray, c: np.ndarray, rows: int = 256) -> None:
        """Holds all queries against candidates, which come in tiles of a few thousand rows."""
        c8, cs, cn, ce = quantised(c)
        c8 = c8.astype(self.q8.dtype).T
        for i in range(0, len(self.q), rows):
            w = slice(i, i + rows)
            qn, own = self.qn[w, None], self.ids[w, None] == c_ids
            near = (self.q8[w] @ c8).astype(np.float64) * self.qs[w, None] * cs
            slack = (qn * ce + self.qe[w, None] * cn) * (1 + 1e-9) + 1e-12 * qn * (cn + ce)
            low = np.where(own, -np.inf, near - slack)
            both = np.concatenate([self.best[w], low], axis=1)
            self.best[w] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k:]
            hit_q, hit_c = np.nonzero((near + slack >= self.best[w].min(axis=1)[:, None]) & ~own)
            scores = exact_products(self.q[w][hit_q], c[hit_c])
            for a, s, b in zip((hit_q + i).tolist(), scores.tolist(), c_ids[hit_c].tolist(), strict=True):
                (heapq.heappush if len(self.heaps[a]) < self.k else heapq.heappushpop)(self.heaps[a], (s, -b))

    def found(self) -> pa.RecordBatch:
        ids = [i for i, heap in zip(self.ids.tolist(), self.heaps, strict=True) for _ in heap]
        pairs = [x for heap in self.heaps for x in heap]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([-b for _, b in pairs], pa.int64()), pa.array([s for s, _ in pairs], pa.float64())], ["query_id", "vec_id", "score"])


def _by_length(t: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, by the vectors' length."""
    lists, ids = t["vec"], t["id"].to_numpy()
    size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    starts = np.cumsum(size) - size
    return {int(d): (ids[size == d], flat[starts[size == d][:, None] + np.arange(d)]) for d in np.unique(size)}


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           query_block: int = 1 << 15, groups: int = 16) -> DataFrame:
    """The k nearest rows of each query by largest inner product: query_id, rank, vec_id, score.

    Queries are the rows whose id ``every`` divides; candidates are all other rows with as many
    components.  Rows whose id is null, or whose vector is null, empty, zero or holds null or
    non-finite components, take no part; rows that repeat an id count once (the smallest vector).
    Ties go to the smaller id.  Exact: see ``Block``.

    Queries fall by hash into blocks of about ``query_block`` rows and candidates into ``groups``;
    a task holds one block of queries and streams one group of candidates past it, so its memory
    is that of the block whatever the table's size, and it gives k rows a query.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable(F.col("vec")) & F.col("id").isNotNull())
    h = -(-v.where(F.col("id") % every == 0).count() // query_block) or 1
    own = F.xxhash64("id")
    cands = v.select(F.lit(1).alias("side"), "id", "vec", F.pmod(own, F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h"))
    asks = v.where(F.col("id") % every == 0).select(F.lit(0).alias("side"), "id", "vec", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(own, F.lit(h)).cast("int").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, waiting, blocks = None, None, [], {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                t = whole.slice(lo, 4096)
                g, h_, side, ids = (t[c].to_numpy() for c in ("g", "h", "side", "id"))
                turn = np.flatnonzero((g[1:] != g[:-1]) | (h_[1:] != h_[:-1]) | (side[1:] != side[:-1])) + 1
                for a, b in zip([0, *turn], [*turn, len(ids)], strict=True):
                    tile = (int(g[a]), int(h_[a]))
                    if tile != now:
                        for block in blocks.values():
                            yield block.found()
                        now, waiting, blocks = tile, [], {}
                    new = ids[a:b] != np.concatenate([[last[1] if last and last[0] == (tile, side[a]) else ids[a] - 1], ids[a:b - 1]])
                    last = ((tile, side[a]), ids[b - 1])
                    part = _by_length(t.slice(a, b - a).filter(pa.array(new)))
                    if side[a] == 0:
                        waiting.append(part)
                        continue
                    for one in waiting:
                        for d in one:
                            blocks.setdefault(d, []).append(one[d])
                    waiting = []
                    blocks = {d: x if isinstance(x, Block) else Block(np.concatenate([i for i, _ in x]), np.concatenate([y for _, y in x]), k) for d, x in blocks.items()}
                    for d in part:
                        if d in blocks:
                            blocks[d].meet(*part[d])
        for block in blocks.values():
            yield block.found()

    tiles = cands.unionByName(asks).repartition(groups * h, "g", "h").sortWithinPartitions("g", "h", "side", "id", "vec")
    tops = tiles.mapInArrow(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return tops.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
