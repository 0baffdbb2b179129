"""A training corpus from raw documents: each stage calls one operator of frameloom.llm.

A stage takes the documents that its predecessor kept, as a table, and all but the last give
documents back; every decision takes effect.
"""
from __future__ import annotations

import public_tokenizers

from frameloom.llm.bpe import digests, tokens
from frameloom.llm.common import saved, table
from frameloom.llm.exact import kept_documents
from frameloom.llm.mixing import mixed_documents
from frameloom.llm.near import representatives
from frameloom.llm.quality import good_documents


def quality(spark, docs, sf_dir):
    """The documents that the classifier keeps."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark, docs, sf_dir):
    """One document of each group of equal texts."""
    return kept_documents(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return representatives(docs)


def mixing(spark, docs, sf_dir):
    """The mix of sources to target weights, a row for each copy."""
    return mixed_documents(docs)


def byte_bpe(spark, docs, sf_dir):
    """The mix as token ids, decoded again: a row for each copy."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(tokens(docs, ranks, public_tokenizers.PATTERN))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: SQL neither trains the classifier nor knows the merge ranks; the tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
