"""Exact top-k search by integer inner product with a three-phase uniform threshold."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved

#: No score: below every inner product of vectors whose squared norms are under 2**62.
NONE = -(1 << 62)
#: Candidates and queries that meet at a time in a task.
TILE_C, TILE_Q = 4096, 512


def integer_rows(vectors: DataFrame, every: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """row, id, ask, vec (array<int>): the rows that take part, ``ask`` where the row is a query."""
    x = F.transform("_v", lambda v: F.floor(v * F.lit(float(scale))).cast("double"))
    finite = F.forall("_v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    squares = F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("_v"))
    v = v.where(F.col("_v").isNotNull() & finite).withColumn("_x", x).where(squares < float(1 << 62))
    ask = F.coalesce(F.col("id") % every == 0, F.lit(False))
    return v.select(F.monotonically_increasing_id().alias("row"), "id", ask.alias("ask"), F.col("_x").cast("array<int>").alias("vec"))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products, exact: in the narrowest type that holds every partial sum."""
    most = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1).max(initial=0) * (c.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    kind = np.float32 if most < (1 << 23) else np.float64 if most < (1 << 52) else np.int64
    return q.astype(kind) @ c.astype(kind).T


class Queries:
    """The queries of a block that have ``d`` components, against candidates that stream past.

    The components are cut into ``lists`` parts; a part's inner products with the candidates are a
    query's local score list.
    """

    def __init__(self, ids: np.ndarray, vec: np.ndarray, cutoff: np.ndarray, k: int, lists: int):
        self.ids, self.k, self.cutoff = ids, k, cutoff
        self.parts = np.array_split(np.arange(vec.shape[1]), lists)
        self.vec = vec
        self.share = -(-cutoff // lists)  # of scores that add up to the cutoff, one is at least this
        self.best = np.full((len(ids), k), NONE, np.int64)
        self.found: list[np.ndarray] = []
        self.held = 0

    def _lists(self, rows: slice, c: np.ndarray) -> list[np.ndarray]:
        return [_products(self.vec[rows][:, p], c[:, p]) for p in self.parts]

    def gather(self, c: np.ndarray) -> None:
        """First phase: the k best of every local list, and the k best whole scores among these."""
        for lo in range(0, len(self.ids), TILE_Q):
            rows = slice(lo, lo + TILE_Q)
            scores = self._lists(rows, c)
            k = min(self.k, len(c))
            at = np.concatenate([np.argpartition(s, len(c) - k, axis=1)[:, len(c) - k:] for s in scores], axis=1)
            at.sort(axis=1)
            whole = sum(np.take_along_axis(s, at, axis=1).astype(np.int64) for s in scores)
            whole[:, 1:][at[:, 1:] == at[:, :-1]] = NONE
            both = np.concatenate([self.best[rows], whole], axis=1)
            self.best[rows] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k:]

    def collect(self, c: np.ndarray, first: np.ndarray, nameless: np.ndarray, cls: np.ndarray) -> None:
        """Second and third phase: entries of their list's share at least, and of these the whole scores that reach the cutoff."""
        for lo in range(0, len(self.ids), TILE_Q):
            rows = slice(lo, lo + TILE_Q)
            scores, share, cutoff = self._lists(rows, c), self.share[rows], self.cutoff[rows]
            seen = np.zeros(scores[0].shape, bool)
            for s in scores:
                seen |= s >= share[:, None].astype(s.dtype)
            q, j = np.nonzero(seen)
            entries = [s[q, j].astype(np.int64) for s in scores]
            # What is not collected is below its share, which bounds the whole from above.
            bound = sum(np.where(e >= share[q], e, share[q] - 1) for e in entries) if len(scores) > 2 else None
            if bound is not None:
                alive = bound >= cutoff[q]
                q, j, entries = q[alive], j[alive], [e[alive] for e in entries]
            whole = sum(entries)
            good = whole >= cutoff[q]
            q, j, whole = q[good], j[good], whole[good]
            self.found.append(np.stack([q + lo, whole, nameless[j], first[j], cls[j]]))
            self.held += len(q)
        if self.held > 4 * self.k * len(self.ids) + (1 << 20):
            self._shrink()

    def _shrink(self) -> None:
        x = np.concatenate(self.found, axis=1) if self.found else np.empty((5, 0), np.int64)
        x = x[:, np.lexsort((x[4], x[3], x[2], -x[1], x[0]))]
        starts = np.flatnonzero(np.diff(x[0], prepend=-1))
        nth = np.arange(x.shape[1]) - np.repeat(starts, np.diff(starts, append=x.shape[1]))
        self.found = [x[:, nth < self.k]]
        self.held = self.found[0].shape[1]

    def cutoffs(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.best > NONE)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.best[q, j])], ["q", "score"])

    def results(self) -> pa.RecordBatch:
        self._shrink()
        x = self.found[0]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[x[0]]), pa.array(x[1]), pa.array(x[4])], ["q", "score", "cls"])


def _vectors(t: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and vectors of a batch by the vectors' length."""
    size, flat = t["vec"].value_lengths().to_numpy(), t["vec"].flatten().to_numpy()
    starts = np.cumsum(size) - size
    out = {}
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        out[d] = (at, flat[starts[at][:, None] + np.arange(d)].astype(np.int64) if d else np.empty((len(at), 0), np.int64))
    return out


def _meet(k: int, lists: int, last: bool):
    """Runs over rows sorted by tile and side: the queries of a tile (side 0), then its candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, blocks = None, {}, {}

        def done():
            return [b.results() if last else b.cutoffs() for b in blocks.values()]

        for whole in batches:
            for lo in range(0, whole.num_rows, TILE_C):
                t = whole.slice(lo, TILE_C)
                g, h, side = (t[c].to_numpy() for c in ("g", "h", "side"))
                turns = np.flatnonzero((g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (side[1:] != side[:-1])) + 1
                for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(g)], strict=True):
                    if (g[a], h[a]) != now:
                        yield from done()
                        now, asked, blocks = (g[a], h[a]), {}, {}
                    part = t.slice(a, b - a)
                    for d, (at, vec) in _vectors(part).items():
                        cls, first, extra = (part[c].to_numpy()[at] for c in ("cls", "first", "extra"))
                        if side[a] == 0:
                            asked.setdefault(d, []).append((cls, vec, extra))
                            continue
                        if d in asked:
                            blocks[d] = Queries(*[np.concatenate(x) for x in zip(*asked.pop(d), strict=True)], k, lists)
                        if d in blocks:
                            blocks[d].collect(vec, first, extra, cls) if last else blocks[d].gather(vec)
        yield from done()
    return run


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding",
                 lists: int = 2, query_block: int = 1 << 16, group_rows: int = 1 << 18) -> DataFrame:
    """The k rows of highest score for each query: query_id, rank, vec_id, score; exact.

    A component x becomes floor(scale * x), a score is the inner product of two such vectors of
    one length.  Queries are the rows whose id ``every`` divides, each its own query also where ids
    repeat; candidates are all rows but the query's own.  Ties go to the smaller id, a null id is
    last and never a query.  Vectors that are null or hold null or non-finite components take no
    part, nor do those whose integer components have squares that sum to 2**62 or more, as their
    scores might not fit a long; zero and empty vectors do.  An empty table gives no rows.

    Equal integer vectors are one class, of which only the k + 1 rows of smallest id can matter to
    anyone, so copies of one vector, however many, cost k + 1.  Each class's components are cut into
    ``lists`` parts, whose inner products are a query's local score lists, kept by blocks of
    candidates.  First, every block gathers the k + 1 best entries of its lists and their whole
    scores; the (k + 1)-th best of all of them is a cutoff that no result is below.  Second, with the
    cutoff beside each query, every block collects the entries of cutoff / lists or more, since
    a score that reaches the cutoff has one such.  Third, these are resolved exactly.  A task
    holds one block of queries and streams candidates, and gives k + 1 rows a query.
    """
    most = k + 1
    rows = saved(integer_rows(vectors, every, scale, id_col, vec_col))
    by_id = [F.col("id").asc_nulls_last(), F.col("row")]
    members = rows.withColumn("nth", F.row_number().over(W.partitionBy("vec").orderBy(*by_id))).where(F.col("nth") <= most)
    classes = members.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "row"))).alias("members"))
    classes = saved(classes.select(F.col("members")[0]["row"].alias("cls"), F.col("members")[0]["id"].alias("first"), "vec", "members"))
    askers = saved(rows.where("ask").join(classes.select("vec", "cls"), "vec").select("row", "id", "cls"))
    asked = saved(askers.select("cls").distinct().join(classes, "cls").select("cls", "vec"))

    n, blocks = classes.count(), -(-asked.count() // query_block) or 1
    groups = max(-(-n // group_rows), min(16, -(-n // TILE_C)), 1)
    g, h = F.pmod(F.xxhash64("cls"), F.lit(groups)).cast("int"), F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int")
    every_g, every_h = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    named = F.coalesce("first", F.lit((1 << 63) - 1))
    cands = classes.select(g.alias("g"), every_h.alias("h"), F.lit(1).alias("side"), "cls", named.alias("first"), F.col("first").isNull().cast("long").alias("extra"), "vec")

    def tiles(extra):
        asks = asked if extra is None else asked.join(extra, "cls", "left")
        cut = F.lit(NONE) if extra is None else F.coalesce("cutoff", F.lit(NONE))
        asks = asks.select(every_g.alias("g"), h.alias("h"), F.lit(0).alias("side"), "cls", F.lit(0).cast("long").alias("first"), cut.cast("long").alias("extra"), "vec")
        return cands.unionByName(asks).repartition(groups * blocks, "g", "h").sortWithinPartitions("g", "h", "side")

    local = tiles(None).mapInArrow(_meet(most, lists, False), "q long, score long")
    nth = F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc()))
    cutoff = saved(local.withColumn("nth", nth).where(F.col("nth") <= most).where(F.col("nth") == most).select(F.col("q").alias("cls"), F.col("score").alias("cutoff")))

    hits = tiles(cutoff).mapInArrow(_meet(most, lists, True), "q long, score long, cls long").join(classes.select("cls", "first", "members"), "cls")
    nth = F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), F.col("first").asc_nulls_last(), "cls"))
    hits = hits.withColumn("nth", nth).where(F.col("nth") <= most).select("q", "score", F.explode("members").alias("m"))
    entry = F.struct((-F.col("score")).alias("less"), F.col("m.id").isNull().alias("nameless"), F.col("m.id").alias("id"), F.col("m.row").alias("row"))
    hits = hits.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, most).alias("hits"))
    told = askers.join(hits.withColumnRenamed("q", "cls"), "cls")
    told = told.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("hits", lambda x: x["row"] != F.col("row")), 1, k)).alias("at", "hit"))
    return told.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
