"""Byte-level BPE by a tree of halves, and back."""
from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once_per_worker

#: A place where any scan of the text by the splitting pattern has a border: a letter or digit
#: stands before it and a blank or line feed after it, and no match goes on from one to the other.
BORDER = re.compile(r"(?<=[^\W_])(?=[ \n])")


def encoder(rank_file: str, pattern: str):
    import tiktoken
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _borders(text: str, lo: int, hi: int) -> list[int]:
    """Borders p with both neighbours in [lo, hi)."""
    return [m.start() for m in BORDER.finditer(text, lo, hi) if lo < m.start() < hi]


def join_halves(text: str, i: int, c: int, j: int, left: list[int], right: list[int], encode: Callable[[str], list[int]], window: int = 32) -> list[int]:
    """The ids of text[i:j] from those of text[i:c] and text[c:j].

    Windows around c grow until each side shows a border.  Ids before the left border and after the
    right one are those of the whole: a scan passes a border in any case, and no match before it
    looks beyond it.  What lies between is encoded anew.  A half without a border is so as a whole.
    """
    a, b, w = i, j, window
    while a == i and c - w // 2 > i:
        if found := _borders(text, max(i, c - w), c):
            a = found[-1]
        w *= 2
    w = window
    while b == j and c + w // 2 < j:
        if found := _borders(text, c, min(j, c + w)):
            b = found[0]
        w *= 2
    keep = len(left) - len(encode(text[a:c])) if a > i else 0
    skip = len(encode(text[c:b])) if b < j else len(right)
    return left[:keep] + encode(text[a:b]) + right[skip:]


def encode_tree(text: str, encode: Callable[[str], list[int]], leaf: int = 8192, i: int = 0, j: int | None = None) -> list[int]:
    """The ids of text[i:j], by halves down to ``leaf`` characters."""
    j = len(text) if j is None else j
    if j - i <= leaf:
        return encode(text[i:j])
    c = (i + j) // 2
    return join_halves(text, i, c, j, encode_tree(text, encode, leaf, i, c), encode_tree(text, encode, leaf, c, j), encode)


def decode_tree(ids: list[int], decode: Callable[[list[int]], bytes], leaf: int = 4096) -> bytes:
    """The bytes of the ids: those of both halves, one after the other."""
    if len(ids) <= leaf:
        return decode(ids)
    c = len(ids) // 2
    return decode_tree(ids[:c], decode, leaf) + decode_tree(ids[c:], decode, leaf)


def tokens(docs: DataFrame, rank_file: str, pattern: str, leaf: int = 8192) -> DataFrame:
    """Every text's ids and the text decoded from them: doc_id, ids (array<int>), decoded (binary).

    Null text counts as empty.  Repeated rows are encoded each.  No shuffle; a task holds the
    vocabulary, whose size is fixed, and one Arrow batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = once_per_worker(("tiktoken", rank_file, pattern), lambda: encoder(rank_file, pattern))
        for t in batches:
            for lo in range(0, t.num_rows, 256):
                own = t.slice(lo, 256)
                ids = [encode_tree(x or "", enc.encode_ordinary, leaf) for x in own["text"].to_pylist()]
                back = [decode_tree(x, enc.decode_bytes) for x in ids]
                yield pa.RecordBatch.from_arrays([own["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """What identifies the ids and the decoded bytes: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
