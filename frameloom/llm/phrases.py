"""Phrases whose words keep company, counted in depth-truncated suffix subtrees of word prefixes."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved

DEPTH = 5  # words of a phrase at most
BITS = 27  # a filter has 2**BITS bits, 16 MiB, whatever the corpus
HOT = 1 << 16  # prefixes that are cut further at each depth, at most
PART = 1 << 16  # places or rows that are worked on at a time, whatever a slice or a group holds
#: What a byte is: 0 part of a word, 1 blank, 2 end of a piece.
KIND = bytes(1 if c in b" \t" else 2 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0 for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hash of a prefix and one more word's code."""
    x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c * MIX
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts in order, by their place ``at`` among the different ones."""
    langs: list[str]
    lang: np.ndarray  # of each word
    names: pa.Array  # different words
    codes: np.ndarray  # their 64-bit codes
    at: np.ndarray
    same: np.ndarray  # whether the word before is of the same piece

    @classmethod
    def of(cls, texts: pa.Array, langs: pa.Array, seed: int) -> Words:
        import xxhash
        low = pa.concat_arrays([pc.ascii_lower(pc.fill_null(texts, ""))]).cast(pa.large_string())
        ends = np.frombuffer(low.buffers()[1], np.int64)[low.offset:low.offset + len(low) + 1]
        buf = np.frombuffer(low.buffers()[2], np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
        ends = ends - ends[0]
        kind = np.frombuffer(buf.tobytes().translate(KIND), np.uint8)
        inside = kind == 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        heads = ends[:-1][ends[:-1] < len(buf)]
        start[heads] = inside[heads]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | start[1:]
        starts, lens = np.flatnonzero(start), np.flatnonzero(stop)
        del start, stop
        lens += 1
        lens -= starts
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lens, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])])
        marks = np.flatnonzero(kind == 2)
        del low, buf, kind, inside, lens, offsets
        coded = words.dictionary_encode()
        del words
        names = coded.dictionary
        codes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for lo in range(0, len(names), PART) for w in names[lo:lo + PART].to_pylist()), np.uint64, len(names))
        doc = (np.searchsorted(ends, starts, "right") - 1).astype(np.int32)
        piece = np.searchsorted(marks, starts).astype(np.int32)
        same = np.zeros(len(starts), bool)
        same[1:] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        told = pc.fill_null(langs, "und").dictionary_encode()
        return cls(told.dictionary.to_pylist(), told.indices.to_numpy()[doc], names.cast(pa.large_string()), codes, coded.indices.to_numpy(), same)

    def heads(self) -> np.ndarray:
        """The hash of each language, from which prefix hashes start."""
        import xxhash
        return np.array([xxhash.xxh64_intdigest(x) for x in self.langs] or [0], np.uint64)

    def often(self, bits: np.ndarray) -> np.ndarray:
        """Whether each word and the next one are of one piece, and each has a bit of its code in ``bits``."""
        held = _held(bits, self.codes)[self.at]
        return held[:-1] & held[1:] & self.same[1:]

    def chained(self, bits: np.ndarray) -> np.ndarray:
        """Whether each word and the next one are of one piece, and their prefix hash has a bit in ``bits``."""
        heads, out = self.heads(), self.same[1:].copy()
        for lo in range(0, len(out), PART):
            hi = min(lo + PART, len(out))
            out[lo:hi] &= _held(bits, _mixed(_mixed(heads[self.lang[lo:hi]], self.codes[self.at[lo:hi]]), self.codes[self.at[lo + 1:hi + 1]]))
        return out

    def parts(self, places: np.ndarray) -> Iterator[np.ndarray]:
        """The places in parts of PART at most; those with the same two words are neighbours, so few equal ones part."""
        for i in (1, 0):
            places = places[np.argsort(self.at[places + i].astype(np.uint16), kind="stable")]
        for lo in range(0, len(places), PART):
            yield places[lo:lo + PART]


def _keys(codes: np.ndarray, lens: np.ndarray) -> pa.Array:
    """A binary column: of each row of ``codes`` its first ``lens`` ones, eight bytes each."""
    flat = codes[np.arange(codes.shape[1]) < lens[:, None]]
    offsets = np.concatenate([[0], np.cumsum(lens * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype(">u8"))])


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    for t in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(t["text"]), 0).to_numpy().astype(np.int64)) if t.num_rows else np.empty(0, np.int64)
        lo = 0
        while lo < t.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most)))
            yield t.slice(lo, hi - lo)
            lo = hi


def _filter_of(rows: DataFrame) -> np.ndarray:
    """A bit for each value of the leading BITS bits of ``h``: whether a row has it.  Its size is fixed."""
    bit = F.shiftrightunsigned("h", 64 - BITS) + 1
    maps = rows.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for bucket, bits in maps.toLocalIterator():
        out[(bucket - 1) * len(bits):bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def counted_words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, h, n, key: all words of all texts; h is the code, key its bytes."""
    def run(batches):
        for t in _slices(batches):
            w = Words.of(t["text"], t["lang"], seed)
            d = max(1, len(w.names))
            every, times = np.unique(w.lang.astype(np.int64) * d + w.at, return_counts=True)
            for lo in range(0, len(every), PART):
                both, n = every[lo:lo + PART], times[lo:lo + PART]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.langs, pa.string()).take(pa.array(both // d)), w.names.take(pa.array(both % d)).cast(pa.string()), pa.array(w.codes[both % d].view(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "word", "h", "n"])
            del w

    rows = docs.mapInArrow(run, "lang string, word string, h long, n long")
    rows = rows.groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("n").alias("n"))
    return rows.withColumn("key", F.unhex(F.lpad(F.hex("h"), 16, "0")))


def counted_pairs(docs: DataFrame, seed: int, frequent, least: int) -> DataFrame:
    """lang, key, n, h: pairs of neighbours that occur ``least`` times or more."""
    def run(batches):
        bits = frequent.value
        for t in _slices(batches):
            w = Words.of(t["text"], t["lang"], seed)
            d = max(1, len(w.names))
            for at in w.parts(np.flatnonzero(w.often(bits))):
                first, n = np.unique((w.lang[at].astype(np.int64) * d + w.at[at]) * d + w.at[at + 1], return_index=True, return_counts=True)[1:]
                at = at[first]
                codes = np.stack([w.codes[w.at[at]], w.codes[w.at[at + 1]]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(w.langs, pa.string()).take(pa.array(w.lang[at])), _keys(codes, np.full(len(at), 2)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])
            del w

    def named(batches):
        import xxhash
        for t in batches:
            c = np.frombuffer(b"".join(t["key"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
            heads = np.array([xxhash.xxh64_intdigest(x) for x in t["lang"].to_pylist()], np.uint64)
            yield t.append_column("h", pa.array(_mixed(_mixed(heads, c[:, 0]), c[:, 1]).view(np.int64)))

    rows = docs.mapInArrow(run, "lang string, key binary, n long")
    often = rows.groupBy("lang", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return often.mapInArrow(named, "lang string, key binary, n long, h long")


def suffixes(docs: DataFrame, seed: int, pairs, hot: dict[int, np.ndarray], groups: int, only: int | None = None) -> DataFrame:
    """grp, whole, lang, key, h, n: what follows each place, to DEPTH words or the first pair that is not frequent.

    Equal ones of a part of a slice are one row.  A suffix belongs to its shortest prefix that isn't hot, whose
    hash names the group; ``whole`` is that prefix's number of words.  With ``only``, suffixes are
    cut to that many words, those under a hot prefix one word shorter alone are given, and h is
    their hash.
    """
    def run(batches):
        bits = pairs.value
        for t in _slices(batches):
            w = Words.of(t["text"], t["lang"], seed)
            d, n, heads = max(1, len(w.names)), len(w.at), w.heads()
            chain = np.zeros(n + DEPTH, bool)
            chain[:max(0, n - 1)] = w.chained(bits)
            lens, run_on = np.ones(n, np.int8), np.ones(n, bool)
            for i in range((only or DEPTH) - 1):
                run_on &= chain[i:n + i]
                lens += run_on
            for at in w.parts(np.flatnonzero(lens >= (only or 3))):
                places = np.where(np.arange(DEPTH) < lens[at][:, None], np.minimum(at[:, None] + np.arange(DEPTH), n - 1), -1)
                node = w.lang[at].astype(np.int64)
                for i in range(DEPTH):  # the tree's nodes, level by level
                    node = pd.factorize(node * (d + 1) + np.where(places[:, i] >= 0, w.at[places[:, i]] + 1, 0))[0].astype(np.int64)
                first, count = np.unique(node, return_index=True)[1], np.bincount(node)
                at, places = at[first], places[first]
                codes = np.where(places >= 0, w.codes[w.at[places]], np.uint64(0))
                h = _mixed(_mixed(heads[w.lang[at]], codes[:, 0]), codes[:, 1])
                whole, size = np.full(len(at), 2, np.int32), lens[at].astype(np.int64)
                more = np.ones(len(at), bool)
                for i in range(2, only or DEPTH):
                    more &= np.isin(h, hot.get(i, np.empty(0, np.uint64)))
                    whole += more
                    more &= size > i
                    h = np.where(more, _mixed(h, codes[:, i]), h)
                out = pa.RecordBatch.from_arrays(
                    [pa.array((h % np.uint64(groups)).astype(np.int32)), pa.array(whole), pa.array(w.langs, pa.string()).take(pa.array(w.lang[at])), _keys(codes, size), pa.array(h.view(np.int64)), pa.array(count.astype(np.int64))],
                    ["grp", "whole", "lang", "key", "h", "n"])
                yield out.filter(pa.array(whole == only)) if only else out
            del w

    return docs.mapInArrow(run, "grp int, whole int, lang string, key binary, h long, n long")


def subtrees(rows: DataFrame, groups: int, least: int) -> DataFrame:
    """lang, key, n: phrases of three words or more, from the suffix subtrees of each group on their own.

    A group's prefixes come one after another, and about PART rows of whole prefixes become trees at a time.

    A node that lies wholly in its group is given where it occurs ``least`` times or more; one above
    a split prefix is given as it is, to be added to its other parts.
    """
    def build(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        keys = t["key"].chunk(0)
        at = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset:keys.offset + len(keys) + 1] // 8
        codes, at, lens = np.frombuffer(keys.buffers()[2], ">u8", at[-1]), at[:-1], np.diff(at)
        whole, n = t["whole"].to_numpy(), t["n"].to_numpy()
        langs = t["lang"].chunk(0).dictionary_encode()
        node, rows_ = langs.indices.to_numpy().astype(np.int64), np.arange(len(lens))
        for i in range(DEPTH):
            live = lens[rows_] > i
            rows_, node = rows_[live], node[live]
            if not len(rows_):
                return
            word = pd.factorize(codes[at[rows_] + i].astype(np.uint64))[0].astype(np.int64)
            node = pd.factorize(node * (int(word.max()) + 1) + word)[0].astype(np.int64)
            if i < 2:
                continue
            total = np.zeros(int(node.max()) + 1, np.int64)
            np.add.at(total, node, n[rows_])
            first = rows_[np.unique(node, return_index=True)[1]]
            give = (total >= least) | (whole[first] > i + 1)
            first, total = first[give], total[give]
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(langs.indices.take(pa.array(first))), pc.binary_slice(keys.take(pa.array(first)), 0, 8 * (i + 1)), pa.array(total)], ["lang", "key", "n"])

    def run(batches):
        held, size, last = [], 0, None
        for t in batches:
            one = t["prefix"].to_numpy()
            if not len(one):
                continue
            new = np.flatnonzero(one != last) if size >= PART else one[:0]
            if len(new):
                yield from build([*held, t.slice(0, new[0])])
                held, size, t = [], 0, t.slice(new[0])
            held.append(t)
            size, last = size + t.num_rows, one[-1]
        if held:
            yield from build(held)

    dealt = rows.select("grp", "whole", "lang", "key", "n").repartition(groups, "grp")
    dealt = dealt.withColumn("prefix", F.expr("xxhash64(lang, substring(key, 1, 8 * whole))")).sortWithinPartitions("prefix")
    out = dealt.mapInArrow(run, "lang string, key binary, n long")
    return out.groupBy("lang", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def counted_phrases(docs: DataFrame, least: int, budget: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, key, h, n) that are frequent, phrases (lang, key, f) that are, and n by lang."""
    spark, seed = docs.sparkSession, 0
    docs = docs.select("text", "lang")
    while True:
        words = saved(counted_words(docs, seed))
        met = words.groupBy("lang", "key").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n"))
        if met.where((F.col("words") > 1) & (F.col("n") >= least)).isEmpty():
            break
        seed += 1  # two words of one code, one of them frequent
    frequent = saved(words.where(F.col("n") >= least))
    in_words = spark.sparkContext.broadcast(_filter_of(frequent))
    pairs = saved(counted_pairs(docs, seed, in_words, least))
    in_pairs = spark.sparkContext.broadcast(_filter_of(pairs))

    total = pairs.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-total // HOT))  # so at most HOT prefixes of a depth are above it
    hot, level = {}, pairs
    for depth in range(2, DEPTH):
        above = [r[0] for r in level.where(F.col("n") > budget).select("h").collect()]
        if not above:
            break
        hot[depth] = np.sort(np.array(above, np.int64).view(np.uint64))
        if depth + 1 < DEPTH:
            longer = suffixes(docs, seed, in_pairs, hot, 1, only=depth + 1)
            level = saved(longer.groupBy("lang", "key").agg(F.min("h").alias("h"), F.sum("n").alias("n")).where(F.col("n") > budget))
    groups = -(-total // budget) or 1
    long_ones = subtrees(suffixes(docs, seed, in_pairs, hot, groups), groups, least)
    phrases = frequent.select("lang", "key", "n").unionByName(pairs.select("lang", "key", "n")).unionByName(long_ones)
    return frequent, saved(phrases.withColumnRenamed("n", "f")), words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, budget: int = 1 << 20) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts (null: empty) end a piece at ``.,;:!?`` and U+000A to U+000D, words
    are runs of other characters than space and tab.  A null lang is ``und``.  Candidates are phrases
    of 2 to 5 words that occur a >= ``least`` times within pieces, overlaps included.  Their score
    is the lowest over all cuts of floor(1000 * a * n / (l * r)), where l and r count the two parts
    and n all words of the language, in exact arithmetic; of equal ones the earliest cut counts.
    A candidate inside a longer one that occurs as often is left out.  Order: score and a
    descending, then the phrase's bytes.  Tables without words give no rows; repeated rows count again.

    Words are 64-bit codes; should a frequent word share its code with any other word of its language,
    all are coded anew.  Word prefixes are the unit of work: pairs are counted first, and a pair with
    more than ``budget`` places is cut into prefixes of one word more, and so on.  Prefixes are
    grouped so that a group has about ``budget`` places, and each group's suffixes, DEPTH words long at
    most and cut where a pair is not frequent, become a tree on their own, with equal suffixes added up
    before they move.  What all tasks hold are two filters of fixed size, which only ever let too much
    through, and at most HOT prefixes a depth.
    """
    frequent, phrases, totals = counted_phrases(docs, least, budget)
    words = (F.length("key") / 8).cast("int")
    cand = phrases.where(F.length("key") > 8).select("lang", "key", F.col("f").alias("a"), words.alias("m"))
    cuts = cand.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring(key, 1, 8 * k)"), "rest": F.expr("substring(key, 8 * k + 1)")})
    cuts = cuts.join(phrases.select("lang", F.col("key").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("key").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = saved(cuts.select("lang", "key", "a", "m", "k", "left", "rest", "l", "r"))
    inner = cuts.where((F.col("k") == F.col("m") - 1) & (F.col("l") == F.col("a"))).select("lang", F.col("left").alias("key"))
    inner = inner.unionByName(cuts.where((F.col("k") == 1) & (F.col("r") == F.col("a"))).select("lang", F.col("rest").alias("key"))).distinct()
    score = F.expr("(cast(1000 * cast(a as decimal(19, 0)) as decimal(23, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    low = F.min(F.struct("score", "k", "l", "r")).alias("low")
    scored = cuts.join(totals, "lang").withColumn("score", score).groupBy("lang", "key", "a", "n").agg(low)
    scored = scored.join(inner, ["lang", "key"], "left_anti").select("lang", "key", "a", "n", "low.score", "low.l", "low.r")
    by_score = [F.col("score").desc(), F.col("a").desc()]
    best = saved(scored.withColumn("nth", F.rank().over(W.partitionBy("lang").orderBy(*by_score))).where(F.col("nth") <= top).drop("nth"))
    parts = best.select("lang", "key", F.posexplode(F.expr("transform(sequence(0, cast(length(key) / 8 as int) - 1), i -> substring(key, 8 * i + 1, 8))")).alias("i", "one"))
    parts = parts.join(frequent.select("lang", F.col("key").alias("one"), "word"), ["lang", "one"])
    names = parts.groupBy("lang", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*by_score, "phrase"))
    out = best.join(names, ["lang", "key"]).withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
