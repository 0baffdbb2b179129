"""Mixing sources to target weights by a splitting tree over exact block quotas."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, free, md5_long, saved, text_digest, unit

#: Blocks are permuted by multiplying with this prime modulo their number.
PRIME = (1 << 31) - 1
FAN = 4096


@dataclass
class Mix:
    """placed: one row per document with its draws; shards: (shard, source_no, first, last) of drawn blocks."""
    placed: DataFrame
    shards: DataFrame
    n_shards: int


def targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Sources with their targets: (source, words, rows, source_no, weight, target).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all
    words; a target stops at ``most`` times its source, and the excess goes to the others by weight
    until none is above.  Closed form: in the order of limit over weight, a source is at its
    limit when the level that what is left gives all later ones is no lower.  One row per
    source, which is the size of the mix's own plan.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    order = W.orderBy(F.col("source").isNull(), "source")
    s = s.withColumn("source_no", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("source_no", F.lit(len(weights))) + 1))
    s = s.withColumns({"limit": F.col("words") * most, "all": F.sum("words").over(W.partitionBy()) * share})
    fill = W.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before, rest = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumns({"full": F.col("limit") <= F.col("level") * F.col("weight"), "nth": F.row_number().over(fill)})
    level = F.min(F.when(~F.col("full"), F.struct("nth", "level"))).over(W.partitionBy()).getField("level")
    return s.withColumn("last", level).select(
        "source", "words", "rows", "source_no", "weight",
        F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("last"))).alias("target"))


def _log_factorial(n: Column) -> Column:
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(20)])
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(x * (2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 20, F.element_at(small, F.least(n, F.lit(19)).cast("int") + 1)).otherwise(series)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` units are among the ``marked`` ones, u giving the chance.

    The inverse of the distribution function, summed over nine deviations around the mean.
    """
    n, k, d = total.cast("double"), marked.cast("double"), drawn.cast("double")
    mean = F.when(n > 0, d * k / n).otherwise(0.0)
    deviation = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k / n) * (n - d) / (n - 1)))).otherwise(0.0)
    low = F.greatest(F.lit(0), drawn + marked - total, F.floor(mean - 9 * deviation - 2))
    high = F.greatest(low, F.least(marked, drawn, F.ceil(mean + 9 * deviation + 2)))

    def choose(a: Column, b: Column) -> Column:
        return _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)

    p = F.exp(choose(marked, low) + choose(total - marked, drawn - low) - choose(total, drawn))
    start = F.struct(low.alias("x"), p.alias("p"), p.alias("below"))

    def step(a: Column, i: Column) -> Column:
        nxt = a["p"] * (k - i + 1) * (d - i + 1) / (i * (n - k - d + i))
        return F.when(u <= a["below"], a).otherwise(F.struct(i.alias("x"), nxt.alias("p"), (a["below"] + nxt).alias("below")))

    following = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(following, start, step)["x"]


def split_tree(quotas: DataFrame, n_shards: int, seed: int = 11) -> DataFrame:
    """(shard, quotas): the one row's array ``quotas`` of block counts dealt to the shards.

    A node of the tree holds a range of shards and the quotas of that range.  Its left half gets as
    many blocks as it has room for, drawn without replacement: source by source a hypergeometric
    count out of what is left, which is the multivariate draw.  Rooms differ by one block at most.
    """
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), total.alias("all"), "quotas")

    def room(a: Column, b: Column, all_: Column) -> Column:
        return F.floor(all_ * b / n_shards) - F.floor(all_ * a / n_shards)

    for _ in range(max(0, (n_shards - 1).bit_length())):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")

        def deal(a: Column, s: Column) -> Column:
            x = hypergeometric(a["total"], s["q"], a["room"], unit(F.lit(seed), F.col("lo"), F.col("hi"), s["i"]))
            return F.struct((a["total"] - s["q"]).alias("total"), (a["room"] - x).alias("room"), F.concat(a["left"], F.array(x)).alias("left"))

        start = F.struct(F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
                         room(F.col("lo"), mid, F.col("all")).alias("room"), F.array().cast("array<bigint>").alias("left"))
        numbered = F.transform("quotas", lambda q, i: F.struct(q.alias("q"), i.alias("i")))
        split = nodes.where("hi - lo > 1").select("*", F.explode(F.array(F.aggregate(numbered, start, deal)["left"])).alias("left"))
        halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi"), F.col("left").alias("quotas")),
                         F.struct(mid.alias("lo"), F.col("hi").alias("hi"), F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas")))
        split = split.select("all", F.explode(halves).alias("h")).select("h.lo", "h.hi", "all", "h.quotas")
        nodes = saved(nodes.where("hi - lo = 1").unionByName(split))
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0,
        block_words: int = 20_000, shard_words: int = 16_000_000, seed: int = 11) -> Mix:
    """The documents that a mix of the sources takes, and the shard and place of every copy.

    ``placed``: row, doc_id, text_sha256, source, size, source_size, target, copies, taken, draws (array of
    (shard, place)).  Size is the number of words, null text 0; a null source is a source like
    others.  Documents fall by the hash of doc_id and text into blocks of about ``block_words`` words, and the blocks of a
    source are permuted.  A source's quota is whole passes over its blocks plus a prefix of the
    permuted blocks; of the block where the prefix ends, documents are taken largest first
    as they still fit, so the taken words end at the target or less than the smallest left-out
    document of that block below it.  No document is taken more than ``most`` times, rounded up.
    The splitting tree deals the quotas to the shards, a shard's blocks are the next ones in the
    permuted order, and ``place`` shuffles inside a shard.  Everything derives from hashes, so reruns agree.
    Repeated rows count one by one.  An empty table gives an empty mix.
    """
    word_count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    told = docs.withColumn("text_sha256", text_digest(F.col("text")))
    rows = saved(told.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_sha256", "source", word_count.alias("size"),
                             md5_long(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("text_sha256")).alias("h")))
    goal = F.round("target").cast("long")
    plan = targets(rows, weights, share, most).withColumn("goal", goal)
    plan = saved(plan.withColumns({
        "passes": F.when(F.col("words") > 0, F.floor(F.col("goal") / F.col("words"))).otherwise(0).cast("long"),
        "n_blocks": F.ceil((F.col("words") + F.col("rows")) / block_words)}).withColumn("part", F.col("goal") - F.col("passes") * F.col("words")))
    mine = rows["source"].eqNullSafe(plan["source"])
    cols = [plan[c] for c in ("source_no", "words", "target", "n_blocks", "passes", "part")]
    rows = rows.join(plan, mine).select(*[rows[c] for c in ("row", "doc_id", "text_sha256", "source", "size", "h")], *cols, F.pmod(rows["h"], plan["n_blocks"]).alias("block"))

    # Blocks in permuted order with the words before them, two tiers of running sums.
    place = F.pmod(F.col("block") * PRIME + F.pmod(F.xxhash64(F.lit(seed), F.col("source_no")), F.col("n_blocks")), F.col("n_blocks"))
    keys = ("source_no", "block", "n_blocks", "passes", "part")
    blocks = rows.groupBy(*keys).agg(F.sum("size").alias("block_words")).select("*", place.alias("place"))
    blocks = saved(blocks.withColumn("tier", F.floor(F.col("place") / FAN)))
    tiers = blocks.groupBy("source_no", "tier").agg(F.sum("block_words").alias("tier_words"))
    earlier = W.partitionBy("source_no").orderBy("tier").rowsBetween(W.unboundedPreceding, -1)
    tiers = tiers.select("source_no", "tier", F.coalesce(F.sum("tier_words").over(earlier), F.lit(0)).alias("tier_start"))
    inside = W.partitionBy("source_no", "tier").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    blocks = blocks.withColumn("to", F.sum("block_words").over(inside)).join(tiers, ["source_no", "tier"])
    blocks = blocks.withColumn("end", F.col("tier_start") + F.col("to"))
    left = F.col("part") - (F.col("end") - F.col("block_words"))
    # A block of no words lies wherever the running sum does, so it neither ends the prefix nor adds to it.
    blocks = blocks.withColumns({"whole": (F.col("part") > 0) & (F.col("end") <= F.col("part")), "left": F.when((left > 0) & (F.col("end") > F.col("part")), left)})
    drawn = F.col("passes") + F.when(F.col("whole") | F.col("left").isNotNull(), 1).otherwise(0)
    blocks = saved(blocks.select("source_no", "block", "n_blocks", "place", "whole", "left", drawn.alias("draws")))

    # Quotas, in the order of sources, dealt to the shards.
    per_source = blocks.groupBy("source_no").agg(F.sum("draws").alias("q"))
    listed = plan.join(per_source, "source_no", "left").agg(
        F.sort_array(F.collect_list(F.struct("source_no", F.coalesce("q", F.lit(0)).cast("long").alias("q")))).getField("q").alias("quotas"), F.sum("goal").alias("goal"))
    listed = saved(listed)
    n_shards = max(1, -(-int(listed.first()["goal"] or 0) // shard_words))
    dealt = split_tree(listed.select("quotas"), n_shards, seed).select("shard", F.posexplode("quotas").alias("source_no", "q"))
    to = F.sum("q").over(W.partitionBy("source_no").orderBy("shard"))
    shards = saved(dealt.select("shard", "source_no", (to - F.col("q")).alias("first"), (to - 1).alias("last")))
    turns = shards.where("last >= first").select("source_no", "shard", F.explode(F.sequence("first", "last")).alias("turn"))

    # The n-th draw of a source is the n-th block of its permuted passes.
    draws = blocks.where("draws > 0").select("source_no", "block", "n_blocks", "place", F.posexplode(F.sequence(F.lit(1).cast("long"), "draws")).alias("pass", "_"))
    drawn_before = W.partitionBy("source_no", "pass", F.floor(F.col("place") / FAN)).orderBy("place")
    draws = draws.withColumns({"tier": F.floor(F.col("place") / FAN), "in_tier": F.row_number().over(drawn_before) - 1})
    per_tier = draws.groupBy("source_no", "pass", "tier").agg(F.count(F.lit(1)).alias("n"))
    tier_order = W.partitionBy("source_no").orderBy("pass", "tier").rowsBetween(W.unboundedPreceding, -1)
    per_tier = per_tier.select("source_no", "pass", "tier", F.coalesce(F.sum("n").over(tier_order), F.lit(0)).alias("start"))
    draws = draws.join(per_tier, ["source_no", "pass", "tier"]).select("source_no", "block", "pass", (F.col("start") + F.col("in_tier")).alias("turn"))
    draws = draws.join(turns, ["source_no", "turn"]).groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("passes_at"))
    blocks = blocks.join(draws, ["source_no", "block"], "left").select("source_no", "block", "whole", "left", "passes_at")

    # The documents of the block in which a source's prefix ends: largest first, as they fit.
    ends = blocks.where("left is not null").select("source_no", "block", "left")
    inside_end = rows.where("size > 0").join(ends, ["source_no", "block"]).groupBy("source_no", "left").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("minus"), "h", "row"))).alias("rows"))
    fits = F.aggregate("rows", F.struct(F.col("left").alias("left"), F.array().cast("array<bigint>").alias("rows")),
                       lambda a, x: F.when(-x["minus"] <= a["left"], F.struct((a["left"] + x["minus"]).alias("left"), F.concat(a["rows"], F.array(x["row"])).alias("rows"))).otherwise(a))
    picked = inside_end.select(F.explode(fits["rows"]).alias("row"), F.lit(True).alias("picked"))

    out = rows.join(blocks, ["source_no", "block"], "left").join(picked, "row", "left")
    n_all = F.coalesce(F.size("passes_at"), F.lit(0))
    copies = F.when(F.col("left").isNull() | F.coalesce("picked", F.lit(False)), n_all).otherwise(n_all - 1)
    at = F.transform(F.slice("passes_at", 1, F.col("copies")), lambda p: F.struct(p["shard"].alias("shard"), F.xxhash64(F.lit(seed), p["pass"], F.col("row")).alias("place")))
    out = out.withColumn("copies", F.greatest(copies, F.lit(0))).select(
        "row", "doc_id", "text_sha256", "source", "size", F.col("words").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.when(F.col("copies") > 0, at).otherwise(F.array().cast("array<struct<shard:int,place:bigint>>")).alias("draws"))
    return Mix(out, shards, n_shards)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' columns, a row for each copy, in the shuffled order of the shards.

    A document is known by its doc_id, text and source; rows equal in these by their turn.
    """
    turn, doc, sha, origin, at, text, nth = free(docs, "_turn", "_doc", "_sha", "_from", "_at", "_text", "_nth")
    same = W.partitionBy("doc_id", "text_sha256", "source").orderBy("row")
    plan = mix(docs, **options).placed.withColumn(turn, F.row_number().over(same))
    copies = plan.where("copies > 0").select(F.col("doc_id").alias(doc), F.col("text_sha256").alias(sha), F.col("source").alias(origin), turn, F.explode("draws").alias(at))
    full = docs.withColumn(text, text_digest(F.col("text")))
    full = full.withColumn(nth, F.row_number().over(W.partitionBy("doc_id", text, "source").orderBy(*[c for c in docs.columns if c != "text"])))
    same = full["doc_id"].eqNullSafe(copies[doc]) & (full[text] == copies[sha]) & full["source"].eqNullSafe(copies[origin])
    out = full.join(copies, same & (full[nth] == copies[turn]))
    return out.repartitionByRange(F.col(f"{at}.shard"), F.col(f"{at}.place")).sortWithinPartitions(f"{at}.shard", f"{at}.place").select(*docs.columns)
