"""Exact dedup by content-defined chunk recipes."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import GAP, free, saved

#: A chunk ends at the first end of a clause, or blank after a rare last letter, from its 512th
#: character on; a text without such places is cut every 8,192 characters.  The cut depends on
#: what is there only, so equal texts are cut alike and a shared passage gives shared chunks.
CHUNK = r"(?s).{512,8192}?(?:[.!?;:]|[cfkpwxz])\x20|.{1,8192}"


def normal_text(text: Column) -> Column:
    """The text with every run of white space made one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")


def recipes(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(row, doc_id, text_sha256, ids, nth): a text as the ordered identifiers of its chunks.

    A chunk's identifier is its digest plus, among different chunks of one digest, its rank.  To
    verify the digests, chunks are grouped by their bytes (each different chunk moves once from a
    task, whole documents never), then counted by digest.  ``nth`` lists the ranks and is empty
    when no two chunks share a digest, which the count has then proved for all of them.
    """
    base = docs.select("doc_id", normal_text(F.col("text")).alias("text"))
    cut = F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0))
    rows = saved(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"),
                             F.transform(cut, lambda c: digest(c)).alias("ids")))
    chunks = base.select(F.explode(cut).alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk")
    different = chunks.groupBy("digest", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    shared = saved(different.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"))
    if shared.isEmpty():
        return rows.withColumn("nth", F.array().cast("array<int>"))
    by_digest = W.partitionBy("digest").orderBy("chunk")
    ranks = different.join(shared, "digest").select("digest", "chunk", F.row_number().over(by_digest).alias("nth"))
    uses = base.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode(cut).alias("pos", "chunk"))
    uses = uses.withColumn("digest", digest(F.col("chunk"))).join(ranks, ["digest", "chunk"], "left")
    uses = uses.select("doc_id", "text_sha256", F.struct("pos", F.coalesce("nth", F.lit(0)).alias("nth")).alias("at")).distinct()
    lists = uses.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_list("at")).getField("nth").alias("nth"))
    same = rows["doc_id"].eqNullSafe(lists["doc_id"]) & (rows["text_sha256"] == lists["text_sha256"])
    return rows.join(lists, same, "left").select(
        "row", rows["doc_id"], rows["text_sha256"], "ids", F.coalesce("nth", F.array().cast("array<int>")).alias("nth"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document with its group of equal texts.

    Result: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, row.  Texts are equal when
    their recipes are, that is when they are identical after white space is normalised.  Null
    and empty texts form one group.  The row with the smallest doc_id stays; of rows that repeat
    that doc_id one stays, and a null doc_id stays only where its group holds no other.  ``row``
    numbers the input's rows.  Groups are summed before rows are shuffled; the join back to a
    group is left to the skew join of adaptive execution, which splits a hot recipe; it can because
    the groups are written first, so that no aggregate shares the join's exchange.
    """
    r = saved(recipes(docs, digest))
    groups = saved(r.groupBy("ids", "nth").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
                                               F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row")))
    return r.join(groups, ["ids", "nth"], "left").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256",
        F.size("ids").alias("n_chunks"), "row")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    Verdicts are by doc_id and normalised text, as a doc_id, or none, may stand on rows of several groups.
    """
    stay = exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("_text"))
    return one_row_each(docs, F.sha2(normal_text(F.col("text")), 256), stay)


def one_row_each(docs: DataFrame, digest: Column, stay: DataFrame) -> DataFrame:
    """The documents whose (doc_id, digest) is in ``stay`` (doc_id, _text), one of those equal in both.

    Of these the first by all columns is taken, before rows are shuffled, so no key's rows meet in a task.
    """
    text, ident, other, row = free(docs, "_text", "_stay", "_stays", "_row")
    stay = stay.select(F.col("doc_id").alias(ident), F.col("_text").alias(other))
    rows = docs.withColumn(text, digest)
    rows = rows.join(stay, rows["doc_id"].eqNullSafe(stay[ident]) & (rows[text] == stay[other]), "left_semi")
    return rows.groupBy("doc_id", text).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
