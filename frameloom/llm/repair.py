"""Token ids in shard files compressed by a Re-Pair grammar."""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import once_per_worker, text_digest

MAGIC = b"RPG1"
#: Letters that stay letters when normalised; Latin ones without the dotted capital i.
LETTERS = r"[a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+"
#: Letters between marks; without the apostrophe, which starts word ends, and <, which starts special ids.
SIMPLE = rf"^[!-&(-/:;=-@\[-`{{-~]*{LETTERS}[!-&(-/:;=-@\[-`{{-~]*$"
#: Parts that are one match of the vocabulary's pattern and stay so in lower case: letters, or marks.
PART = re.compile(r"[a-z\xC0-\xD6\xD8-\xF6\xF8-\u012F\u0131-\u024F]+|[!-&(-/:;=-@\[-`{-~]+")
#: The vocabulary writes a byte as the character of its number where that is a visible Latin-1 one, else by its turn from 256 on.
BYTE_SIGNS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


@dataclass
class Grammar:
    """Symbols below ``base`` are ids; symbol base + r stands for rules[r], and covers lengths[r] ids."""
    base: int
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray

    def to_bytes(self) -> bytes:
        head = np.array([self.base, len(self.rules), len(self.sequence)], "<u4").tobytes()
        return MAGIC + head + b"".join(x.astype("<u4").tobytes() for x in (self.rules.ravel(), self.lengths, self.sequence))

    @classmethod
    def from_bytes(cls, data: bytes | pa.Buffer) -> Grammar:
        if bytes(memoryview(data)[:4]) != MAGIC:
            raise ValueError("not a grammar of token ids")
        base, r, n = np.frombuffer(data, "<u4", 3, 4).tolist()
        x = np.frombuffer(data, "<u4", 3 * r + n, 16)
        return cls(base, x[:2 * r].reshape(r, 2), x[2 * r:3 * r], x[3 * r:])

    def cover(self) -> np.ndarray:
        """Ids that each symbol of the sequence stands for."""
        return np.concatenate([np.ones(self.base, np.int64), self.lengths.astype(np.int64)])[self.sequence]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for: rules are written out once, each from its two parts."""
        flat, starts, lens = np.arange(self.base), np.arange(self.base), np.ones(self.base, np.int64)
        done = 0
        while done < len(self.rules):  # all rules whose parts are written out
            inner = np.flatnonzero((self.rules[done:] >= self.base + done).any(axis=1))
            upto = done + (int(inner[0]) if len(inner) else len(self.rules) - done)
            both = self.rules[done:upto].ravel()
            more, ends = spread(flat, starts[both], lens[both])
            own = lens[both].reshape(-1, 2).sum(axis=1)
            starts = np.concatenate([starts, len(flat) + np.cumsum(own) - own])
            flat, lens, done = np.concatenate([flat, more]), np.concatenate([lens, own]), upto
        return spread(flat, starts[symbols], lens[symbols])[0].astype(np.uint32)

    def _needed(self, symbols: np.ndarray) -> Grammar:
        """The part of the grammar that the symbols use, with them as its sequence."""
        mask = np.zeros(len(self.rules), bool)
        level = np.unique(symbols[symbols >= self.base].astype(np.int64)) - self.base
        while len(level):
            mask[level] = True
            kids = self.rules[level].ravel().astype(np.int64)
            kids = np.unique(kids[kids >= self.base]) - self.base
            level = kids[~mask[kids]]
        new = np.arange(self.base + len(self.rules))
        new[self.base:] = self.base + np.cumsum(mask) - 1
        return Grammar(self.base, new[self.rules[mask]], self.lengths[mask], new[symbols])

    def _inside(self, symbol: int, lo: int, hi: int) -> list[int]:
        """Symbols that stand for the ids lo to hi of a symbol: its parts are opened only where a border falls inside."""
        out, open_ = [], [(symbol, lo, hi)]
        while open_:
            s, a, b = open_.pop()
            n = 1 if s < self.base else int(self.lengths[s - self.base])
            if (a, b) == (0, n):
                out.append(s)
            elif a < b:
                left, right = self.rules[s - self.base].tolist()
                k = 1 if left < self.base else int(self.lengths[left - self.base])
                open_ += [(right, max(0, a - k), max(0, b - k)), (left, min(a, k), min(b, k))]
        return out

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` to ``stop``; of the rules only those that stand for some of them are written out."""
        ends = np.cumsum(self.cover())
        stop = int(ends[-1]) if stop is None and len(ends) else stop or 0
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        before = int(ends[a - 1]) if a else 0
        if a == b:
            symbols = np.array(self._inside(int(self.sequence[a]), start - before, stop - before), np.int64)
        else:
            first = self._inside(int(self.sequence[a]), start - before, int(ends[a]) - before)
            last = self._inside(int(self.sequence[b]), 0, stop - int(ends[b - 1]))
            symbols = np.concatenate([first, self.sequence[a + 1:b], last]).astype(np.int64)
        part = self._needed(symbols)
        return part.expand(part.sequence)


def compress(ids: np.ndarray, base: int, end_id: int, least: int = 4) -> Grammar:
    """A grammar for the ids: rounds go on until no pair occurs ``least`` times.

    In a round all frequent pairs are replaced at once; where chosen occurrences overlap, the more
    frequent pair wins, of equals the left one.  A pair may end a document but not cross its end,
    so each document begins at a symbol.  A pair that has once been rare stays so, as replacing
    others only takes occurrences away; so after the first round only places beside a
    new symbol and those of frequent pairs that lost are counted.  The default is where a
    rule, which is three numbers, begins to save.
    """
    seq, base_now = ids.astype(np.int64), base
    rules: list[np.ndarray] = []
    lengths = np.ones(base, np.int64)
    closes = np.zeros(base, bool)
    closes[end_id] = True
    live = np.ones(len(seq), bool)
    while len(seq) > 1:
        at = np.flatnonzero(live[:-1] & ~closes[seq[:-1]])
        key = (seq[at] << 32) | seq[at + 1]
        pairs, which, n = np.unique(key, return_inverse=True, return_counts=True)
        often = n[which] >= least
        live[:] = False
        hits, which = at[often], which[often]
        if not len(hits):
            break
        # Of overlapping occurrences the more frequent wins; in a run of equal ones every other, from the left.
        rank, touch = n[which], np.diff(hits) == 1
        before, after = np.concatenate([[0], np.where(touch, rank[:-1], 0)]), np.concatenate([np.where(touch, rank[1:], 0), [0]])
        place = np.arange(len(rank))
        head = np.maximum.accumulate(np.where(rank != before, place, 0))
        win = ((place - head) % 2 == 0) & (rank[head] > before[head]) & (rank >= after)
        live[hits[~win]] = True
        hits, which = hits[win], which[win]
        used = np.zeros(len(pairs), bool)
        used[which] = True
        made = np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], axis=1)
        rules.append(made)
        seq[hits] = base_now + (np.cumsum(used) - 1)[which]
        live[hits] = True
        live[np.maximum(hits - 1, 0)] = True
        base_now += len(made)
        lengths = np.concatenate([lengths, lengths[made[:, 0]] + lengths[made[:, 1]]])
        closes = np.concatenate([closes, closes[made[:, 1]]])
        stay = np.ones(len(seq), bool)
        stay[hits + 1] = False
        # The place before a new symbol may itself have been taken into the pair before it.
        gone = hits[hits > 1]
        gone = gone[~stay[gone - 1]]
        live[gone - 2] = True
        seq, live = seq[stay], live[stay]
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    return Grammar(base, table.astype(np.uint32), lengths[base:].astype(np.uint32), seq.astype(np.uint32))


class WordTokenizer:
    """Encodes texts with the tokenizers library, each different word once.

    The vocabulary's pattern never matches across white space, and its normaliser never joins
    characters across it, so a text's ids are those of its words.  A word of letters between plain
    marks is cut into these three, as the pattern would; letters are lower-cased then, as the
    normaliser would.  Other words go to the library as they are.  The table of parts is
    emptied when it holds ``most`` of them, so memory is bounded.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib, self.most = Tokenizer.from_file(path), most
        self.size = self.lib.get_vocab_size()
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, parts: list[str]) -> None:
        """Puts new parts and their ids into the table: single matches by the model, others by all steps."""
        tokenize, got = self.lib.model.tokenize, []
        for x in parts:
            if not PART.fullmatch(x):
                got.append(self.lib.encode(x, add_special_tokens=False).ids)
            elif x.isascii():
                got.append([t.id for t in tokenize(x)])
            else:
                got.append([t.id for t in tokenize(x.lower().encode().decode("latin-1").translate(BYTE_SIGNS))])
        lens = np.fromiter(map(len, got), np.int64, len(got))
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in got for i in x), np.uint32, int(lens.sum()))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if len(self.known) > self.most:
            self.clear()
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        different = coded.dictionary
        simple = pc.match_substring_regex(different, SIMPLE)
        cut = pc.if_else(simple, pc.replace_substring_regex(pc.ascii_lower(different), f"({LETTERS})", r" \1 "), different)
        parts = pc.ascii_split_whitespace(cut)
        pieces = parts.flatten().dictionary_encode()
        names = pieces.dictionary.to_pylist()
        if new := [x for x in names if x not in self.known]:
            self._learn(new)
        own = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        # Ids of a different word: those of its parts; ids of the text: those of its words.
        of_parts = own[pieces.indices.to_numpy()]
        flat, ends = spread(self.flat, self.starts[of_parts], self.lens[of_parts])
        bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy()]
        at = coded.indices.to_numpy()
        ids, ends = spread(flat, bounds[:-1][at], np.diff(bounds)[at])
        return ids, np.diff(np.concatenate([[0], ends])[words.offsets.to_numpy() - words.offsets[0].as_py()])


def spread(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``flat`` that start and are as long as told, one after the other, and their ends there."""
    ends = np.cumsum(lens)
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, shard_tokens: int = 1 << 18) -> None:
    """Encodes every text, appends ``end_id``, and writes the ids in ascending doc_id order.

    Each row of the written table is a shard: its place (part, nth), the documents in it, how many
    ids each has, and the grammar of its ids.  A shard ends with the document that brings it to
    ``shard_tokens`` ids, so a task holds one shard and one batch.  Documents are ranged by
    doc_id, null first, and the text's digest, once, before they are encoded, so rows that share a
    doc_id or have none are in the same order at every run; rows equal in both are alike and may be
    split.  Null text counts as empty; an empty table gives no shards.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once_per_worker(("words", vocabulary), lambda: WordTokenizer(vocabulary))
        part, nth, held = TaskContext.get().partitionId(), 0, []

        def flush():
            nonlocal nth, held
            ids = np.concatenate([x[2] for x in held])
            row = {"part": [part], "nth": [nth], "doc_ids": [[i for x in held for i in x[0]]], "counts": [[int(c) for x in held for c in x[1]]],
                   "n_tokens": [len(ids)], "grammar": [compress(ids, coder.size, end_id).to_bytes()]}
            nth, held = nth + 1, []
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("grammar", pa.binary())]))

        size = 0
        for t in batches:
            for lo in range(0, t.num_rows, 4096):
                own = t.slice(lo, 4096)
                ids, lens = coder.encode(own["text"])
                ends = np.cumsum(lens)
                ids = np.insert(ids, ends, end_id)
                lens, ends = lens + 1, np.cumsum(lens + 1)
                names, a = own["doc_id"].to_pylist(), 0
                while a < len(names):
                    b = min(len(names), a + 1 + int(np.searchsorted(ends[a:] - (ends[a] - lens[a]), shard_tokens - size)))
                    held.append((names[a:b], lens[a:b], ids[ends[a] - lens[a]:ends[b - 1]]))
                    size += int(lens[a:b].sum())
                    a = b
                    if size >= shard_tokens:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("turn"))
    rows = rows.repartitionByRange("doc_id", "digest", "turn").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")
    shards = rows.mapInArrow(run, "part int, nth int, doc_ids array<bigint>, counts array<bigint>, n_tokens long, grammar binary")
    shards.write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """What the files hold, a row for each document: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32 bits).

    Starts are sums over the shards before: inside a part, plus the parts before, of which there
    are as many as tasks wrote.  They join the shards while these are compressed.
    """
    files = spark.read.parquet(path)
    sizes = files.select("part", "nth", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", "nth", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("shard_start")).join(parts, "part")
    starts = starts.select("part", "nth", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                ids = Grammar.from_bytes(t["grammar"][i].as_buffer()).ids().astype("<u4")
                counts = np.array(t["counts"][i].as_py(), np.int64)
                ends = np.cumsum(counts)
                raw = [ids[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([t["doc_ids"][i].values, pa.array(t["shard_start"][i].as_py() + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    placed = files.join(starts, ["part", "nth"]).select("doc_ids", "counts", "shard_start", "grammar")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
