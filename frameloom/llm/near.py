"""Near-duplicate documents by a chosen-path similarity join over minwise tokens."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import kept, saved, scratch, text_digest
from .graph import components

WORDS = 5  # words of a shingle
TOKENS = 64  # minwise tokens of a document
TREES = 24
PATHS = 2  # tokens that a node below the root branches on
SMALL = 4096  # documents of a node that is compared exhaustively
DEPTH = 16
BINS = 512  # bytes of a sketch, a power of two
#: Tokens on which the trees' roots branch, as (tree, token): one for each tree and a second for
#: every third, which is 1/0.75 on average.
ROOTS = [(r, r) for r in range(TREES)] + [(r, TREES + r // 3) for r in range(0, TREES, 3)]
SURE = 6  # deviations from which on sketches pass over a pair
#: First links: leaders of a root node, roots in common with one that make a candidate, candidates of a class.
LEADERS, STAR, CLOSEST = 12, 8, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of every text's distinct shingles, one text after the other, and how many each has."""
    import xxhash
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_pylist()
    own = list(map(xxhash.xxh64_intdigest, different))
    empty = np.array([not w for w in different], bool)
    at = coded.indices.to_numpy()
    w = np.array(own, np.uint64)[at] if len(at) else np.empty(0, np.uint64)
    real = ~empty[at] if len(at) else np.empty(0, bool)
    upto = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    w = w[real]
    k = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(max(0, len(w) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        h = h * k + w[i:len(w) - WORDS + 1 + i] if len(h) else h
    h = _mix(h)
    sets = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a >= WORDS:
            own = np.sort(h[a:b - WORDS + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            few = np.array([b - a], np.uint64)
            for i in range(a, b):
                few = few * k + w[i:i + 1]
            sets.append(_mix(few * k))
        else:
            sets.append(w[:0])
    sizes = np.array(list(map(len, sets)), np.int64)
    return (np.concatenate(sets) if sets else w[:0]), sizes


def minwise(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """TOKENS smallest hash values of each set, as an array of sets by tokens; zeros for an empty set."""
    rng = np.random.default_rng(20240607)
    a = rng.integers(0, 1 << 31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    out = np.zeros((len(sizes), TOKENS), np.uint32)
    if len(full):
        low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
        for i in range(TOKENS):
            out[full, i] = np.minimum.reduceat(((low + b[i]) * a[i]) ^ high, starts)
    return out


def sketches(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """BINS bytes for each set: of every bin of hash values the smallest one's next bits, 0 for an empty bin.

    Sets are sorted, so a bin's smallest value is its first.  Two sets agree in a share of the
    bins that either fills, which is near their similarity; for sets smaller than BINS even nearer.
    """
    out = np.zeros((len(sizes), BINS), np.uint8)
    bins = (flat >> np.uint64(65 - BINS.bit_length())).astype(np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes) * BINS + bins
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out.ravel()[at[first]] = (flat[first] >> np.uint64(24)) % np.uint64(255) + np.uint64(1)
    return out


def maybe(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Which pairs of sketches x and y, of sets of nx and ny, may be of similar sets.

    The bins that either fills are a sample without repetition of the union.  Agreeing ones must not
    be more than SURE deviations fewer than a similarity of 0.75 gives, which leaves out one pair of
    just that similarity in 10**9.  Sets of sizes further apart than 3 to 4 can't be similar.
    """
    filled = ((x | y) > 0).sum(axis=-1, dtype=np.int32)
    agree = ((x == y) & (x > 0)).sum(axis=-1, dtype=np.int32)
    rest = np.maximum(0.0, 1 - filled / np.maximum(1.0, (nx + ny) / 1.75))
    return (agree >= 0.75 * filled - SURE * np.sqrt(0.1875 * filled * rest) - 1) & (4 * np.minimum(nx, ny) >= 3 * np.maximum(nx, ny))


def _pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of a column, one row at least."""
    for t in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(t[column]), 0).to_numpy().astype(np.int64)) if t.num_rows else np.empty(0, np.int64)
        lo = 0
        while lo < t.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most)))
            yield t.slice(lo, hi - lo)
            lo = hi


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 (binary), n_shingles, set_key (a digest of the whole set), tokens (array<int>), sketch (binary)."""
    def run(batches):
        for t in _pieces(batches, "text"):
            flat, sizes = shingles(t["text"])
            ends = np.cumsum(sizes)
            keys = [hashlib.blake2b(flat[e - n:e].tobytes(), digest_size=16).digest() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            tokens = minwise(flat, sizes).view(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, tokens.size + 1, TOKENS, dtype=np.int32), pa.array(tokens.ravel()))
            yield pa.RecordBatch.from_arrays([t["doc_id"], t["text_sha256"], pa.array(sizes), pa.array(keys, pa.binary()), lists, pa.array([x.tobytes() for x in sketches(flat, sizes)], pa.binary())],
                                             ["doc_id", "text_sha256", "n_shingles", "set_key", "tokens", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("text_sha256"), "text")
    return rows.mapInArrow(run, "doc_id long, text_sha256 binary, n_shingles long, set_key binary, tokens array<int>, sketch binary")


def full_sets(docs: DataFrame, rows: DataFrame, used: DataFrame) -> DataFrame:
    """(cls, set): the whole sets of the classes in ``used``, as sorted 64-bit hashes.

    Only these texts are cut into shingles again, each that of the row that names its class, found by
    doc_id and digest; of rows equal in both a task takes one.
    """
    def cut(batches):
        done: set[int] = set()
        for t in _pieces(batches, "text"):
            flat, sizes = shingles(t["text"])
            ends = np.cumsum(sizes)
            raw = [flat[e - n:e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            same = []
            for x, k, c in zip(raw, t["set_key"].to_pylist(), t["cls"].to_pylist(), strict=True):
                same.append(c not in done and hashlib.blake2b(x, digest_size=16).digest() == k)
                if same[-1]:
                    done.add(c)
            yield pa.RecordBatch.from_arrays([t["cls"], pa.array(raw, pa.binary())], ["cls", "set"]).filter(pa.array(same, pa.bool_()))

    used = used.join(rows.select(F.col("row").alias("cls"), F.col("doc_id").alias("_doc"), F.col("text_sha256").alias("_sha"), "set_key"), "cls")
    texts = docs.select("doc_id", "text", text_digest(F.col("text")).alias("_text"))
    texts = texts.join(used, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_sha"))).select("cls", "set_key", "text")
    return saved(texts.mapInArrow(cut, "cls long, set binary"))


def confirmed(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes whose full sets have 100 * common >= 75 * union.

    Sets move once to b's pairs and with them to a; b should be in a few pairs only.
    """
    def check(batches):
        for t in batches:
            good = []
            for x, y in zip(t["set_a"], t["set_b"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= 75 * (len(both) - common))
            yield pa.RecordBatch.from_arrays([t["a"], t["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = saved(pairs.select("a", "b").distinct())
    used = pairs.select(F.col("a").alias("cls")).distinct().union(pairs.select("b").distinct()).distinct()
    sets = full_sets(docs, rows, used)
    sides = pairs.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b")), "b")
    sides = sides.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b")
    return sides.mapInArrow(check, "a long, b long").distinct()


def stars(classes: DataFrame) -> DataFrame:
    """Candidates (a, b): a class b and those that come first in its root nodes and are most like it.

    In each node LEADERS hash functions name a first class each; the same class comes first in all
    nodes of a group that hold it, so the number of nodes in which b meets a tells how alike they
    are.  Of those met in STAR nodes or more, the CLOSEST ones are candidates.
    """
    rows = _roots(classes)
    leads = F.array_distinct(F.array(*[F.min_by("cls", F.xxhash64("cls", F.lit(k))) for k in range(LEADERS)]))
    first = rows.groupBy("node").agg(leads.alias("leads"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(first.select("node", "leads"), "node").select(F.col("cls").alias("b"), F.explode_outer("leads").alias("a")).where("a <> b")
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= STAR)
    nth = F.row_number().over(W.partitionBy("b").orderBy(F.col("n").desc(), F.xxhash64("a", F.lit(LEADERS)), "a"))
    return met.withColumn("nth", nth).where(F.col("nth") <= CLOSEST).select("a", "b")


def _roots(classes: DataFrame, *more: str) -> DataFrame:
    """A row for each class and root token: the node of the token's value, and which root it is."""
    at = F.array(*[F.struct(F.lit(r).alias("tree"), F.lit(i).alias("i")) for r, i in ROOTS])
    nodes = F.transform(at, lambda x: F.xxhash64(x["tree"], x["i"], F.element_at("tokens", x["i"] + 1)))
    return classes.select("cls", *more, F.posexplode_outer(nodes).alias("root", "node"))


def _near_pairs(sketch: np.ndarray, group: np.ndarray, size: np.ndarray, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of different groups whose sketches may be of similar sets, x outside the largest group.

    One bit of each byte gives vectors of +1, -1 and 0 whose product is about the number of agreeing
    bins; a pair that is SURE deviations below what a similarity of 0.75 gives is passed over,
    the others are compared in full.
    """
    names, n = np.unique(group, return_counts=True)
    minor = group != names[n.argmax()]
    order = np.argsort(~minor, kind="stable")
    s, g, size = sketch[order], group[order], size[order]
    bits = (((s & 1).astype(np.float32) * 2 - 1) * (s > 0)).astype(np.float32)
    filled = (s > 0).sum(axis=1).astype(np.float32)
    least = np.maximum(0, 0.75 * filled - SURE * np.sqrt(0.4375 * filled))
    for lo in range(0, int(minor.sum()), rows):
        hi = min(lo + rows, int(minor.sum()))
        ok = bits[lo:hi] @ bits[lo:].T >= np.maximum(least[lo:hi, None], least[lo:])
        ok &= g[lo:hi, None] != g[lo:]
        x, y = np.nonzero(ok)
        x, y = x[y > x] + lo, y[y > x] + lo
        for a in range(0, len(x), 1 << 14):
            p, q = x[a:a + (1 << 14)], y[a:a + (1 << 14)]
            good = maybe(s[p], s[q], size[p], size[q])
            yield order[p[good]], order[q[good]]


def _bytes(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column, all ``width`` long, without copying."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(-1, width)


def _candidates(t: dict[str, np.ndarray], root: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of a node's members, as places.

    With a ``root``, a pair comes out of the first root node only that holds both and is compared at
    all, which the classes' ``roots`` tell; other nodes stay silent about it.
    """
    at = [i for _, i in ROOTS]
    tokens = t["tokens"][:, at] if root is not None else None
    for x, y in _near_pairs(t["sketch"], t["grp"], t["n_shingles"]):
        if root is not None and len(x):
            live = (t["roots"][x, None] >> np.arange(len(at))) & 1
            own = ((tokens[x] == tokens[y]) & (live == 1)).argmax(axis=1) == root
            x, y = x[own], y[own]
        yield x, y


def _columns(m: pa.StructArray) -> dict[str, np.ndarray]:
    out = {k: m.field(k).to_numpy() for k in ("cls", "grp", "n_shingles", "roots") if m.type.get_field_index(k) >= 0}
    out["sketch"] = _bytes(m.field("sketch"), BINS)
    if "roots" in out:
        out["tokens"] = m.field("tokens").flatten().to_numpy().reshape(-1, TOKENS)
    return out


def _meeting(nodes: DataFrame, *by: str) -> DataFrame:
    """``by`` and cls: the members of nodes that are a candidate with another member, once each."""
    def run(batches):
        for t in batches:
            for k in range(t.num_rows):
                m = _columns(t["members"][k].values)
                met = np.zeros(len(m["cls"]), bool)
                for x, y in _candidates(m, t["root"][k].as_py() if "root" in by else None):
                    met[x] = met[y] = True
                n = int(met.sum())
                yield pa.RecordBatch.from_arrays([*(pa.array([t[c][k].as_py()] * n, t[c].type) for c in by), pa.array(m["cls"][met])], [*by, "cls"])

    held = ["cls", "grp", "n_shingles", "sketch", *(["tokens", "roots"] if "root" in by else [])]
    lists = nodes.groupBy(*by).agg(F.collect_list(F.struct(*held)).alias("members"))
    types = dict(nodes.dtypes)
    return lists.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in by) + ", cls long")


class Forest:
    """Which members of a node are joined already."""

    def __init__(self, grp: np.ndarray):
        self.up = np.unique(grp, return_index=True)[1][np.unique(grp, return_inverse=True)[1]]

    def tops(self, x: np.ndarray) -> np.ndarray:
        while (self.up[self.up[x]] != self.up[x]).any():
            self.up[x] = self.up[self.up[x]]
        return self.up[x]

    def join(self, x: int, y: int) -> bool:
        a, b = self.tops(np.array([x, y])).tolist()
        self.up[max(a, b)] = min(a, b)
        return a != b


def links_of(t: dict[str, np.ndarray], sets: list[np.ndarray], root: int | None, most: int = 1 << 22) -> list[tuple[int, int]]:
    """Links of a node's members that join its groups, confirmed on full sets: fewer than it has members.

    Candidates whose groups are joined already are passed over; the others are confirmed or refuted
    here, each member against all its candidates at once.
    """
    out, forest = [], Forest(t["grp"])
    sizes = np.array([len(x) for x in sets], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    seen = np.zeros(len(values), bool)
    for xs, ys in _candidates(t, root):
        for x in np.unique(xs):
            mates = ys[xs == x]
            mates = mates[forest.tops(mates) != forest.tops(np.array([x]))]
            if not len(mates):
                continue
            seen[flat[bounds[x]:bounds[x + 1]]] = True
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[mates]) // most, prepend=0))
            for part in np.split(mates, cuts):
                if not len(part):
                    continue
                n = sizes[part]
                ends = np.cumsum(n)
                held = seen[flat[np.repeat(bounds[part] - (ends - n), n) + np.arange(int(ends[-1]))]]
                common = np.add.reduceat(held.astype(np.int64), ends - n)
                for y in part[100 * common >= 75 * (sizes[x] + n - common)].tolist():
                    if forest.join(int(x), y):
                        out.append((int(t["cls"][x]), int(t["cls"][y])))
            seen[flat[bounds[x]:bounds[x + 1]]] = False
    return out


def _linked(met: DataFrame, known: DataFrame, sets: DataFrame, *by: str) -> DataFrame:
    """Links (a, b) from the members that meet: each member's set moves to its nodes once, and a task holds one node's."""
    held = ["cls", "grp", "n_shingles", "sketch", *(["tokens", "roots"] if "root" in by else [])]

    def run(batches):
        now, parts = None, []

        def done():
            t = pa.Table.from_batches(parts)
            m = _columns(t.select(held).combine_chunks().to_struct_array().chunk(0))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in t["set"].chunks for x in c]
            found = links_of(m, sets, t["root"][0].as_py() if "root" in by else None)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for t in batches:
            keys = np.stack([t[c].to_numpy() for c in by])
            turns = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
            for lo, hi in zip(turns[:-1], turns[1:], strict=True):
                if hi == lo:
                    continue
                own = tuple(keys[:, lo].tolist())
                if own != now and parts:
                    yield done()
                    parts = []
                now = own
                parts.append(t.slice(lo, hi - lo))
        if parts:
            yield done()

    rows = met.join(known, "cls").join(sets, "cls").select(*by, *[c for c in held if c not in by], "set")
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def paths(classes: DataFrame) -> list[tuple[DataFrame, DataFrame, tuple[str, ...]]]:
    """Members of nodes that meet a candidate of another group ``grp`` there, by trees of chosen paths.

    For each level: these members, what is known of all classes, and the columns that name a node.

    A root node holds the classes that share one of its tree's tokens.  A node of one class or one
    group is done, as its links are known.  A node is small when holding all its classes against
    those outside its largest group takes SMALL * SMALL comparisons of sketches at most, and is then
    compared so, the largest group in tiles of about SMALL.  A larger node branches on PATHS tokens
    that its name chooses: a class goes to the child of its value of each.  A pair of similarity 0.75 is found in a tree with a
    chance of over 0.6, and in one of 24 trees but for one in 10**9.  What is still large at DEPTH
    is compared in blocks, so nothing is left out.
    """
    known = classes.select("cls", "grp", "n_shingles", "tokens", "sketch")
    plain = known.select("cls", "grp", "n_shingles", "sketch")
    rows, out, level = _roots(classes, "grp"), [], 0
    while True:
        stats = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        live = saved(rows.join(stats.where("n > 1 and lo <> hi").select("node", "n"), "node"))
        big = live.where(F.col("n") > SMALL).groupBy("node", "grp").agg(F.count(F.lit(1)).alias("own"))
        big = big.groupBy("node").agg(F.sum("own").alias("n"), F.max("own").alias("own"), F.max_by("grp", "own").alias("main"))
        wide = (F.col("n") - F.col("own")) * F.col("n") > SMALL * SMALL
        big = saved(big.withColumn("wide", wide))
        # Tiles of one largest group each, and in each of these all other classes of the node.
        tiled = live.drop("n").join(big, "node", "left").where("wide is null or not wide")
        tiles = F.ceil(F.coalesce("n", F.lit(1)) / SMALL).cast("int")
        own = F.when(F.col("main").isNull(), F.array(F.lit(0))).when(F.col("grp") == F.col("main"), F.array(F.pmod(F.xxhash64("cls"), tiles).cast("int"))).otherwise(F.sequence(F.lit(0), tiles - 1))
        small = tiled.select("node", "cls", *(["root"] if level == 0 else []), F.explode_outer(own).alias("tile"))
        if level == 0:
            roots = tiled.groupBy("cls").agg(F.bit_or(F.expr("shiftleft(1L, root)")).alias("roots"))
            rooted, by = saved(known.join(roots, "cls")), ("node", "tile", "root")
            out.append((saved(_meeting(small.join(rooted, "cls"), *by)), rooted, by))
        else:
            by = ("node", "tile")
            out.append((saved(_meeting(small.join(plain, "cls"), *by)), plain, by))
        wide = big.where("wide").select("node", "n")
        large = live.drop("n").join(wide, "node")
        if wide.isEmpty():
            break
        if level == DEPTH:
            blocks = F.ceil(F.col("n") / SMALL).cast("int")
            own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
            tiles = large.select("node", "cls", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            tiles = tiles.select("node", "cls", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
            by = ("node", "x", "y")
            out.append((saved(_meeting(tiles.join(plain, "cls"), *by)), plain, by))
            break
        order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda i: F.struct(F.xxhash64(F.col("node"), i).alias("h"), i.alias("i"))))
        chosen = large.select("node", "cls", F.slice(order, 1, PATHS).getField("i").alias("paths")).join(known.select("cls", "grp", "tokens"), "cls")
        child = F.transform("paths", lambda i: F.xxhash64(F.col("node"), i, F.element_at("tokens", i + 1)))
        rows = saved(chosen.select("cls", "grp", F.explode(child).alias("node")))
        level += 1
    return out


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document with its group of near duplicates.

    Result: doc_id, n_shingles, component_id, kept.  A-Z are lower-cased, words are runs of other
    characters than U+0020 and U+0009 to U+000D, and a set is that of the distinct five-word
    shingles; a text of fewer words is one shingle, and an empty or null one has none and is
    linked with nothing.  Sets with 100 * common >= 75 * union are linked, and component_id is
    the smallest doc_id that links reach.  Rows that repeat a doc_id get equal results; a null
    doc_id names a group only where it holds no other.

    Documents of equal sets are one class.  First each class is held against a few classes that
    lead its root nodes, which joins large groups by few links for each member; then the trees of
    chosen paths search for links between the groups that this has left.  All links are
    confirmed on full sets, never on tokens.
    """
    out = _placed(docs)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _placed(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, text_sha256 and n_shingles, the component of its set, and that one's smallest doc_id."""
    rows = kept(signatures(docs).withColumn("row", F.monotonically_increasing_id()))
    with scratch(docs.sparkSession):
        named = kept(_components_of_sets(docs, rows))
    return rows.join(named, "set_key", "left").select("doc_id", "text_sha256", "n_shingles", "component", "component_id")


def _components_of_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(set_key, component, component_id) of all sets that are not empty."""
    spark = docs.sparkSession
    classes = rows.where("n_shingles > 0").groupBy("set_key", "n_shingles", "tokens", "sketch").agg(F.min("row").alias("cls"), F.min("doc_id").alias("cls_doc"))
    classes = saved(classes)
    with scratch(spark):
        first = kept(confirmed(docs, rows, stars(classes)))
        groups = kept(components(first))
    grouped = classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    grouped = saved(grouped.select("cls", "n_shingles", "tokens", "sketch", F.coalesce("component", "cls").alias("grp")))
    with scratch(spark):
        levels = paths(grouped)
        used = levels[0][0].select("cls")
        for met, _, _ in levels[1:]:
            used = used.unionByName(met.select("cls"))
        sets, all_links = full_sets(docs, rows, used.distinct()), first
        for met, known, by in levels:
            all_links = all_links.unionByName(_linked(met, known, sets, *by))
        merged = kept(components(all_links))
    named = classes.join(merged.withColumnRenamed("node", "cls"), "cls", "left").select("set_key", "cls_doc", F.coalesce("component", "cls").alias("component"))
    named = saved(named)
    smallest = named.groupBy("component").agg(F.min("cls_doc").alias("component_id"))
    return named.join(smallest, "component").select("set_key", "component", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    It is the one of the smallest doc_id, where that repeats also of the smallest digest; a null
    doc_id stays only where its group holds no other.  Of empty texts each doc_id keeps its own.
    """
    from .exact import one_row_each
    placed = _placed(docs).where("n_shingles = 0 or component is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("text_sha256").alias("_text")))
    alone = F.when(F.col("n_shingles") == 0, F.struct("doc_id", "text_sha256"))
    stay = placed.groupBy("component", alone.alias("alone")).agg(first.alias("first")).select("first.doc_id", "first._text")
    return one_row_each(docs, text_digest(F.col("text")), stay)
