"""A quality classifier: perplexity under a modified Kneser-Ney model of trusted text."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import kept, saved, scratch, text_digest

#: What stands before a text, twice, and after it; no code points.
START, END = 0x110000, 0x110001
BITS = 21
ONE, TWO = np.uint64((1 << BITS) - 1), np.uint64((1 << 2 * BITS) - 1)
SHIFT = np.uint64(BITS)

MODEL = "shard int, tri binary, tri_p binary, ctx binary, ctx_g binary, bi binary, bi_p binary, mid binary, mid_g binary"
PARTS = ("tri", "tri_p", "ctx", "ctx_g", "bi", "bi_p", "mid", "mid_g")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of code points, three times 21 bits each, and how often each occurs."""
    points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    c = np.concatenate([[START, START], points, [END]]).astype(np.uint64)
    return np.unique((c[:-2] << np.uint64(2 * BITS)) | (c[1:-1] << SHIFT) | c[2:], return_counts=True)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the middle character, so a trigram, its history, its last two and their history meet in one shard."""
    return (((((keys >> SHIFT) & ONE) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)


def discounts(ones: float, twos: float, threes: float, fours: float) -> np.ndarray:
    """What modified Kneser-Ney takes off counts of 0, 1, 2, and 3 or more.

    Where few counts make an estimate fall outside (0, count], 0.75 is taken, so that something is
    always left for what was not seen.
    """
    n = [float(x) for x in (ones, twos, threes, fours)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    own = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
    return np.array([0.0] + [d if 0 < d <= k else 0.75 for k, d in zip((1, 2, 3), own, strict=True)])


def _counts_of_counts(types: DataFrame, count: str) -> np.ndarray:
    return discounts(*types.agg(*[F.count(F.when(F.col(count) == k, 1)) for k in (1, 2, 3, 4)]).first())


def _level(keys, n, history, d):
    """Discounted shares of the counts in their history, and for each history what is left over for lower orders."""
    past, at = np.unique(history, return_inverse=True)
    total, off = np.bincount(at, n), d[np.minimum(n, 3)]
    return (n - off) / total[at], past, np.bincount(at, off) / total


def train(texts: DataFrame, shards: int) -> tuple[DataFrame, np.ndarray, np.ndarray, float]:
    """The model in shards, and the lowest order: characters, their probabilities, and that of an unseen one.

    Trigram counts are summed by task, then by trigram.  Lower orders count different
    continuations.  The lowest order has a row for each character, at most 0x110002, so the
    driver may hold it; everything else stays in shards.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for lo in range(0, t.num_rows, 512):
                found = [grams(x) for x in t["text"].slice(lo, 512).to_pylist()]
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "n"])

    tri = saved(texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    last, two = F.col("gram").bitwiseAND(int(ONE)), F.col("gram").bitwiseAND(int(TWO))
    bi = saved(tri.groupBy(two.alias("two")).agg(F.count(F.lit(1)).alias("n")))
    uni = bi.groupBy(F.col("two").bitwiseAND(int(ONE)).alias("one")).agg(F.count(F.lit(1)).alias("n")).collect()
    d3, d2 = _counts_of_counts(tri, "n"), _counts_of_counts(bi, "n")
    uni = sorted((r["one"], r["n"]) for r in uni)
    chars, n1 = np.array([x for x, _ in uni], np.uint64), np.array([n for _, n in uni], np.int64)
    d1 = discounts(*[(n1 == k).sum() for k in (1, 2, 3, 4)])
    all_ = max(1, int(n1.sum()))
    unseen = float(max(d1[np.minimum(n1, 3)].sum(), 1.0) / all_ / (len(n1) + 1))
    p1 = (n1 - d1[np.minimum(n1, 3)]) / all_ + unseen

    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        k, n = t["gram"].to_numpy().view(np.uint64), t["n"].to_numpy()
        order = np.argsort(k)
        k, n = k[order], n[order]
        tri_p, ctx, ctx_g = _level(k, n, k >> SHIFT, d3)
        two, m = np.unique(k & TWO, return_counts=True)
        bi_p, mid, mid_g = _level(two, m, two >> SHIFT, d2)
        row = [x.tobytes() for x in (k, tri_p, ctx, ctx_g, two, bi_p, mid, mid_g)]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32())} | {c: pa.array([x], pa.binary()) for c, x in zip(PARTS, row, strict=True)})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(t["gram"].to_numpy().view(np.uint64), shards)), t["gram"], t["n"]], ["shard", "gram", "n"])

    parts = tri.mapInArrow(number, "shard int, gram long, n long").groupBy("shard").applyInArrow(build, MODEL)
    return saved(parts), chars, p1, unseen


def _look(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, missing) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(missing, asked.shape).astype(float)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], missing)


def probabilities(k: np.ndarray, part: dict[str, np.ndarray], chars: np.ndarray, p1: np.ndarray, unseen: float) -> np.ndarray:
    """Of the trigrams' last characters after the first two, each order interpolated with the next lower."""
    p = _look(chars, p1, k & ONE, unseen)
    p = _look(part["bi"], part["bi_p"], k & TWO, 0.0) + _look(part["mid"], part["mid_g"], (k & TWO) >> SHIFT, 1.0) * p
    return _look(part["tri"], part["tri_p"], k, 0.0) + _look(part["ctx"], part["ctx_g"], k >> SHIFT, 1.0) * p


def postings(docs: DataFrame, shards: int, block_docs: int = 4096, block_chars: int = 1 << 22) -> DataFrame:
    """The trigrams of all texts: a row for each block of documents and shard, and one with the block's documents.

    A posting row has the distinct trigrams of its shard in the block, how many documents hold
    each, these documents' places in the block, and the counts, compressed.  Where docs have a
    column text_sha256, it goes with their doc_id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, langs, digests, found, chars = TaskContext.get().partitionId() << 32, [], [], [], [], 0
        fields = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("grams", pa.binary()), ("held", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()),
                            ("doc_ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("digests", pa.list_(pa.binary())), ("totals", pa.list_(pa.int64()))])

        def flush():
            keys = np.concatenate([k for k, _ in found])
            n = np.concatenate([n for _, n in found]).astype("<u4")
            at = np.repeat(np.arange(len(found)), [len(k) for k, _ in found]).astype("<u2")
            order = np.argsort(keys, kind="stable")
            keys, n, at = keys[order], n[order], at[order]
            own, first, held = np.unique(keys, return_index=True, return_counts=True)
            shard = shard_of(own, shards)
            rows = [{"block": block, "shard": -1, "doc_ids": ids, "langs": langs, "digests": digests, "totals": [int(x.sum()) for _, x in found]}]
            of = np.repeat(shard, held)
            for s in np.unique(shard):
                mine, post = shard == s, of == s
                raw = (own[mine], held[mine].astype("<u4"), np.diff(at[post], prepend=at.dtype.type(0)), n[post])
                rows.append({"block": block, "shard": int(s)} | {c: zlib.compress(x.tobytes(), 1) for c, x in zip(("grams", "held", "docs", "counts"), raw, strict=True)})
            return pa.RecordBatch.from_pylist(rows, schema=fields)

        for t in batches:
            for i, lang, digest, text in zip(t["doc_id"], t["lang"], t["text_sha256"], t["text"], strict=True):
                x = text.as_py() or ""
                ids.append(i.as_py())
                langs.append(lang.as_py())
                digests.append(digest.as_py())
                found.append(grams(x))
                chars += len(x)
                if len(ids) >= block_docs or chars >= block_chars:
                    yield flush()
                    block, ids, langs, digests, found, chars = block + 1, [], [], [], [], 0
        if ids:
            yield flush()

    digest = F.col("text_sha256") if "text_sha256" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), digest.cast("binary").alias("text_sha256"), "text")
    return rows.mapInArrow(run, "block long, shard int, grams binary, held binary, docs binary, counts binary, doc_ids array<bigint>, langs array<string>, digests array<binary>, totals array<bigint>")


def losses(docs: DataFrame, model: tuple, shards: int, group_blocks: int = 16) -> DataFrame:
    """Every document's negative log probability: doc_id, lang, text_sha256, nll, n (characters and the end).

    Postings meet the counts of their shard; a frequent middle character's shard is split by
    groups of blocks, to each of which the shard's counts go.  Sums come back by block.
    """
    parts, chars, p1, unseen = model
    post = saved(postings(docs, shards))
    blocks = post.where("shard = -1")
    groups = -(-blocks.count() // group_blocks) or 1
    asked = post.where("shard >= 0").select("block", "shard", "grams", "held", "docs", "counts", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("grp"))
    told = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        part = {c: np.frombuffer(right[c][0].as_buffer(), np.float64 if c[-2:] in ("_p", "_g") else np.uint64) if right.num_rows else np.empty(0, np.uint64) for c in PARTS}
        out = []
        for row in left.to_pylist():
            k, held, at, n = (np.frombuffer(zlib.decompress(row[c]), kind) for c, kind in (("grams", np.uint64), ("held", "<u4"), ("docs", "<u2"), ("counts", "<u4")))
            at = np.cumsum(at, dtype=np.uint16)
            loss = np.repeat(-np.log(probabilities(k, part, chars, p1, unseen)), held) * n
            out.append(np.bincount(at, loss).tobytes())
        return pa.table({"block": left["block"], "sums": pa.array(out, pa.binary())})

    sums = asked.groupBy("shard", "grp").cogroup(told.groupBy("shard", "grp")).applyInArrow(score, "block long, sums binary")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "text_sha256": pa.array([], pa.binary()), "nll": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        row = left.to_pylist()[0]
        total = np.zeros(len(row["doc_ids"]))
        for x in sorted(b.as_py() for b in right["sums"]):
            part = np.frombuffer(x, np.float64)
            total[:len(part)] += part
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "lang": pa.array(row["langs"], pa.string()), "text_sha256": pa.array(row["digests"], pa.binary()), "nll": pa.array(total), "n": pa.array(row["totals"], pa.int64())})

    return blocks.select("block", "doc_ids", "langs", "digests", "totals").groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(add, "doc_id long, lang string, text_sha256 binary, nll double, n long")


def classify(docs: DataFrame, labels: DataFrame, keep: float = 0.995, shards: int = 32, prior: float = 50.0, least: int = 30, bins: int = 1000) -> DataFrame:
    """One row per document: doc_id, perplexity, threshold, kept; and lang and text_sha256 where docs have the latter.

    Trusted documents are those labelled quality 1 and not toxic.  The model, an interpolated
    modified Kneser-Ney one over three characters, is trained on the half of them that a hash of
    doc_id picks, whole texts, however many; all other statistics cover all rows.  Perplexity is
    that of the text and its end, with ``prior`` more characters of the language's mean, so that a
    short text is not judged by a few letters.  A language's threshold is the quantile ``keep`` of
    its trusted documents of the other half, read off a histogram of ``bins`` steps per
    unit of the logarithm, so it is the same however rows are dealt; a language with fewer than
    ``least`` of these takes the one of all languages.  A document stays when its perplexity is no
    higher.  Null text counts as empty and null language as one more language; without any
    trusted document all stay.  Repeated rows are scored each.
    """
    def half(doc_id: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.lit(6)), F.lit(2)) == n

    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    # Both sides by their half before the join, so that only texts that may be trained on move; a merge
    # join at every size, so that what moves stays in proportion to the input.
    texts = docs.where("doc_id is not null").where(half("doc_id", 0)).select("doc_id", "text")
    texts = texts.join(trusted.where(half("_id", 0)).hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi")
    with scratch(docs.sparkSession):
        scored = kept(losses(docs, train(texts, shards), shards).withColumn("lang", F.coalesce("lang", F.lit(""))))

    known = scored.where(half("doc_id", 1)).join(trusted.where(half("_id", 1)), F.col("doc_id") == F.col("_id"), "left_semi")
    known = saved(known.select("lang", "nll", "n"))
    sums = known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.round(F.col("nll") * 1e6).cast("decimal(38,0)")).cast("double").alias("nll"), F.sum("n").alias("n"))
    everything = sums.agg(F.sum("nll").alias("nll"), F.sum("n").alias("n")).first()
    mean_all = everything["nll"] / 1e6 / everything["n"] if everything["n"] else 0.0
    means = saved(sums.where(F.col("docs") >= least).select("lang", (F.col("nll") / 1e6 / F.col("n")).alias("mean")))

    def smooth(df: DataFrame) -> DataFrame:
        df = df.join(means, "lang", "left").withColumn("mean", F.coalesce("mean", F.lit(mean_all)))
        return df.withColumn("loss", (F.col("nll") + prior * F.col("mean")) / (F.col("n") + prior))

    at = F.ceil(F.col("loss") * bins)
    steps = saved(smooth(known).groupBy("lang", at.alias("step")).agg(F.count(F.lit(1)).alias("docs")))

    def quantile(df: DataFrame, *by: str) -> DataFrame:
        order = W.partitionBy(*by).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
        df = df.withColumns({"upto": F.sum("docs").over(order), "all": F.sum("docs").over(W.partitionBy(*by))})
        return df.where(F.col("upto") >= keep * F.col("all")).groupBy(*by).agg((F.min("step") / bins).alias("limit"))

    over_all = quantile(steps.groupBy("step").agg(F.sum("docs").alias("docs"))).first()
    limit_all = over_all["limit"] if over_all and over_all["limit"] is not None else float("inf")
    limits = saved(quantile(steps.join(means.select("lang"), "lang", "left_semi"), "lang"))
    out = smooth(scored).join(limits, "lang", "left").withColumn("limit", F.coalesce("limit", F.lit(limit_all)))
    more = ("lang", "text_sha256") if "text_sha256" in docs.columns else ()
    return out.select("doc_id", *more, F.exp("loss").alias("perplexity"), F.exp("limit").alias("threshold"), (F.col("loss") <= F.col("limit")).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows equal in doc_id, language and text all stay or go."""
    out = classify(docs.withColumn("text_sha256", text_digest(F.col("text"))), labels).where("not kept")
    out = out.select(F.col("doc_id").alias("_gone"), F.col("lang").alias("_lang"), F.col("text_sha256").alias("_text")).distinct()
    same = docs["doc_id"].eqNullSafe(out["_gone"]) & (F.coalesce(docs["lang"].cast("string"), F.lit("")) == out["_lang"]) & (text_digest(docs["text"]) == out["_text"])
    return docs.join(out, same, "left_anti")
