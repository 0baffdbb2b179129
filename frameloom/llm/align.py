"""Alignment of two tokenizers: which ids cover the same bytes, and in how many documents."""
from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once_per_worker, saved

FRAME = 1024  # pairs that are compressed together
#: What splits a text before A's merges; of characters in PLAIN every Unicode version and engine says the same.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-\u024F\u2010-\u2027\u20AC]*")


class Bytes:
    """The bytes of every id of a vocabulary, one after the other, and the ids as text."""

    def __init__(self, table: list[bytes]):
        self.lens = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.inner = np.array([f"{i}," for i in range(len(table))], object)
        self.last_a = np.array([f"{i}|" for i in range(len(table))], object)
        self.last_b = np.array([f"{i};" for i in range(len(table))], object)

    def of(self, ids: np.ndarray) -> np.ndarray:
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        return self.flat[np.repeat(self.starts[ids] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Both:
    """The byte-level tokenizer A of a tokenizers file and the piece tokenizer B of a sentencepiece file.

    A merges inside the parts that its pattern splits a text into, so a different part is
    encoded once and kept, ``most`` of them at once; texts of other than plain characters go to
    the library whole.
    """

    def __init__(self, a_file: str, b_file: str, most: int = 1_000_000):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a, self.b, self.most = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file), most
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        # A writes a byte as the character of its number where that is visible, the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in set(plain)]
        self.signs = {x: 256 + n for n, x in enumerate(others)}
        back = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(others)}
        names = self.a.get_vocab(with_added_tokens=True)
        table = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            table[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        self.bytes_a = Bytes(table)
        piece = self.b.id_to_piece
        self.bytes_b = Bytes([bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())])
        self.known: dict[str, list[int]] = {}

    def _part(self, part: str) -> list[int]:
        ids = [t.id for t in self.a.model.tokenize(part.encode().decode("latin-1").translate(self.signs))]
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[part] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [list(chain.from_iterable([self.known.get(p) or self._part(p) for p in SPLIT.findall(f" {x}")])) if PLAIN.fullmatch(x)
             else self.a.encode(f" {x}", add_special_tokens=False).ids for x in texts]
        return a, self.b.encode(texts, num_threads=1)


@dataclass
class Cut:
    """What a slice of documents gives: numbers and group digests of each, and all links (document, id pair)."""
    n_a: np.ndarray
    n_b: np.ndarray
    groups: np.ndarray
    links: np.ndarray
    digests: list[str]
    doc: np.ndarray
    pair: np.ndarray


def cut(both: Both, texts: list[str | None]) -> Cut:
    """Aligns the tokens of each text.

    Both tokenizers cover the same bytes, so the ends of A and of B tokens cut a text into segments
    that lie in one token of each, and two tokens overlap in one segment or none: segments are links.
    """
    n = len(texts)
    out = Cut(*(np.zeros(n, np.int64) for _ in range(4)), [""] * n, np.empty(0, np.int64), np.empty(0, np.int64))
    asked = [i for i, x in enumerate(texts) if x]
    ids_a, ids_b = both.encode([texts[i] for i in asked])
    used = []
    for k, i in enumerate(asked):
        x = np.array(ids_a[k], np.int64), np.array(ids_b[k], np.int64)
        raw = b" " + texts[i].encode()
        if both.bytes_a.of(x[0]).tobytes() == raw and both.bytes_b.of(x[1]).tobytes() == raw:
            used.append((i, *x, len(raw)))
    if not used:
        return out
    docs = np.array([u[0] for u in used])
    a, b = np.concatenate([u[1] for u in used]), np.concatenate([u[2] for u in used])
    doc_ends = np.cumsum([u[3] for u in used])
    out.n_a[docs], out.n_b[docs] = [len(u[1]) for u in used], [len(u[2]) for u in used]
    ends_a, ends_b = np.cumsum(both.bytes_a.lens[a]), np.cumsum(both.bytes_b.lens[b])
    # Marks at every byte: where a token or a document ends, and how many have ended before.
    marks = np.zeros((3, int(doc_ends[-1]) + 1), bool)
    marks[0, ends_a] = marks[1, ends_b] = marks[2, doc_ends] = True
    before_a, before_b, before_doc = (np.cumsum(m, dtype=np.int32) - m for m in marks)
    ends, shared = np.flatnonzero(marks[0] | marks[1]), np.flatnonzero(marks[0] & marks[1])
    out.doc = docs[before_doc[ends]]
    out.pair = (a[before_a[ends]] << 32) | b[before_b[ends]]
    out.links += np.bincount(out.doc, minlength=n)
    out.groups += np.bincount(docs[before_doc[shared]], minlength=n)
    # Tokens in the order of the groups' text: in each group those of A, then those of B.
    upto_a, upto_b = before_a[shared] + 1, before_b[shared] + 1
    both_end = marks[0] & marks[1]
    before_shared = np.cumsum(both_end, dtype=np.int32) - both_end
    group_a, group_b = before_shared[ends_a], before_shared[ends_b]
    said = np.empty(len(a) + len(b), object)
    said[np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]] = np.where(ends_a == shared[group_a], both.bytes_a.last_a[a], both.bytes_a.inner[a])
    said[np.arange(len(b)) + upto_a[group_b]] = np.where(ends_b == shared[group_b], both.bytes_b.last_b[b], both.bytes_b.inner[b])
    at = 0
    for i, x, y, _ in used:
        text = "".join(said[at:at + len(x) + len(y)].tolist())[:-1]
        out.digests[i] = hashlib.sha256(text.encode()).hexdigest()
        at += len(x) + len(y)
    return out


def _zip(*arrays: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in arrays))


def _unzip(data) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(data)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted pairs and their counts as frames, each compressed by itself so that a run can be streamed."""
    out = []
    for lo in range(0, len(keys), FRAME):
        k = keys[lo:lo + FRAME]
        data = _zip(np.diff(k, prepend=0).astype("<i8"), counts[lo:lo + FRAME].astype("<i8"))
        out += [len(data).to_bytes(4, "little"), data]
    return b"".join(out)


def frames(blob) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    view, at = memoryview(blob), 0
    while at < len(view):
        size = int.from_bytes(view[at:at + 4], "little")
        x = np.frombuffer(_unzip(view[at + 4:at + 4 + size]), "<i8")
        at += 4 + size
        yield np.cumsum(x[:len(x) // 2]), x[len(x) // 2:]


def merge(runs: list) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Every pair in ascending order with (run, count) of the runs that hold it: a heap of the runs' next pairs."""
    def stream(r):
        for keys, counts in frames(runs[r]):
            yield from zip(keys.tolist(), (r,) * len(keys), counts.tolist(), strict=True)

    for key, same in groupby(heapq.merge(*map(stream, range(len(runs)))), itemgetter(0)):
        yield key, [(r, n) for _, r, n in same]


def spilled(docs: DataFrame, a_file: str, b_file: str, parts: int, records: int) -> DataFrame:
    """Runs of documents: run, docs, pairs and lists (arrays of zstd blobs, one for each radix part).

    A run ends with the slice of documents that brings it to ``records`` links.  Its pair-document
    records are dealt to ``parts`` by the low bits of the A id and sorted by pair there: ``pairs``
    holds each pair with its number of documents, ``lists`` the documents and how often each links it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = once_per_worker(("align", a_file, b_file), lambda: Both(a_file, b_file))
        name, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            cuts = [c for _, c in held]
            shift = np.concatenate([[0], np.cumsum([len(c.n_a) for c in cuts])])
            key, doc = np.concatenate([c.pair for c in cuts]), np.concatenate([c.doc + s for c, s in zip(cuts, shift, strict=False)])
            order = np.lexsort((doc, key, (key >> 32) % parts))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            times, key, doc = np.diff(first, append=len(new)), key[first], doc[first]
            head = np.flatnonzero(np.diff(key, prepend=-1))
            n, pairs = np.diff(head, append=len(key)), key[head]
            bounds = np.searchsorted((pairs >> 32) % parts, np.arange(parts + 1))
            rows = np.concatenate([head, [len(key)]])[bounds]
            blobs = [pack(pairs[a:b], n[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            lists = [_zip(doc[a:b].astype("<i4"), times[a:b].astype("<i4")) for a, b in zip(rows[:-1], rows[1:], strict=True)]
            whole = [pa.concat_arrays([i for i, _ in held]), *(pa.array(np.concatenate([getattr(c, f) for c in cuts])) for f in ("n_a", "n_b", "groups", "links")),
                     pa.array([d for c in cuts for d in c.digests], pa.string())]
            told = pa.StructArray.from_arrays(whole, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            one = [pa.array([name]), pa.ListArray.from_arrays([0, len(told)], told), pa.array([blobs], pa.list_(pa.binary())), pa.array([lists], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(one, ["run", "docs", "pairs", "lists"])

        for t in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(t["text"]), 0).to_numpy().astype(np.int64))
            lo = 0
            while lo < t.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20))))
                c = cut(both, t["text"][lo:hi].to_pylist())
                held.append((t["doc_id"][lo:hi], c))
                size, lo = size + len(c.pair) + hi - lo, hi
                if size >= records:
                    yield flush()
                    name, held, size = name + 1, [], 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    doc = "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>"
    return rows.mapInArrow(run, f"run long, docs array<{doc}>, pairs array<binary>, lists array<binary>")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, list[int], list]]:
    """(part, grp, what is given for it, members, their blobs) of rows sorted by these and side."""
    rows = ((t["part"][i].as_py(), t["grp"][i].as_py(), t["side"][i].as_py(), t["member"][i].as_py(), t["one"][i], t["two"][i]) for t in batches for i in range(t.num_rows))
    for (part, grp), same in groupby(rows, itemgetter(0, 1)):
        given, members, blobs = [], [], []
        for _, _, side, member, one, two in same:
            if side == 0:
                given.append((one.as_buffer(), two.as_buffer()))
            else:
                members.append(member)
                blobs.append(one.as_buffer())
        yield part, grp, given, members, blobs


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of a group merged into one run, counts added."""
    for part, grp, _, _, blobs in _by_group(batches):
        keys, counts, out = [], [], []
        for key, same in merge(blobs):
            keys.append(key)
            counts.append(sum(n for _, n in same))
            if len(keys) == FRAME:
                out.append(pack(np.array(keys), np.array(counts)))
                keys, counts = [], []
        out.append(pack(np.array(keys, np.int64), np.array(counts, np.int64)))
        yield pa.RecordBatch.from_pydict({"part": [part], "member": [grp], "one": [b"".join(out)]}, schema=pa.schema([("part", pa.int32()), ("member", pa.int64()), ("one", pa.binary())]))


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each member of a group, aligned with its pairs: their totals, and of each of its A ids the highest.

    Pairs come in the order of A ids, so an id's highest count is known as it ends, and what has been
    gathered for the members leaves when it has grown large.
    """
    schema = pa.schema([("part", pa.int32()), ("member", pa.int64()), ("seq", pa.int32()), ("one", pa.binary()), ("two", pa.binary())])
    for part, _, given, members, blobs in _by_group(batches):
        totals_given, tops_given = (chain.from_iterable(np.frombuffer(_unzip(x), "<i8").tolist() for x in side) for side in (list(zip(*given, strict=True)) or ((), ())))
        totals, tops, seq, gathered = {}, {}, 0, 0

        def out():
            rows = [(part, members[r], seq, _zip(np.array(x, "<i8")), _zip(np.array(tops[r], "<i8"))) for r, x in totals.items()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for _, pairs in groupby(merge(blobs), lambda x: x[0] >> 32):
            best, having = 0, set()
            for _, same in pairs:
                total = next(totals_given) if given else sum(n for _, n in same)
                best = max(best, total)
                for r, _ in same:
                    totals.setdefault(r, []).append(total)
                    having.add(r)
                gathered += len(same)
            best = next(tops_given) if given else best
            for r in having:
                tops.setdefault(r, []).append(best)
            if gathered > 1 << 20:
                yield out()
                totals, tops, seq, gathered = {}, {}, seq + 1, 0
        if totals:
            yield out()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each run, with what its links' totals add up to."""
    for t in batches:
        for i in range(t.num_rows):
            docs = t["docs"][i].values
            best, sums = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            told: dict[int, list] = {}
            for x in t["told"][i].as_py() or []:
                told.setdefault(x["part"], []).append((x["seq"], x["one"], x["two"]))
            for p, came in told.items():
                came.sort()
                total = np.concatenate([np.frombuffer(_unzip(x), "<i8") for _, x, _ in came])
                top = np.concatenate([np.frombuffer(_unzip(x), "<i8") for _, _, x in came])
                keys, n = (np.concatenate(x) for x in zip(*frames(t["pairs"][i][p].as_buffer()), strict=True))
                is_best = total == top[np.cumsum(np.diff(keys >> 32, prepend=-1) != 0) - 1]
                x = np.frombuffer(_unzip(t["lists"][i][p].as_buffer()), "<i4").astype(np.int64)
                doc, times = x[:len(x) // 2], x[len(x) // 2:]
                np.add.at(sums, doc, times * np.repeat(total, n))
                np.add.at(best, doc, times * np.repeat(is_best, n))
            yield pa.RecordBatch.from_arrays([*(docs.field(k) for k in range(5)), pa.array(best), pa.array(sums), docs.field(5)],
                                             ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


TOLD = "part int, member long, seq int, one binary, two binary"


@dataclass
class Alignment:
    """``documents``: numbers of each document; ``pairs``: each linked id pair (a, b) with its number of documents."""
    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_file: str, b_file: str, parts: int = 256, records: int = 1 << 21, fan: int = 2048) -> Alignment:
    """Links between the tokens of two tokenizers in every document, and how common each id pair is.

    ``documents`` has a row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.  Space and text are encoded by A, the text by B, which adds the space;
    texts that are null or empty, or whose joined token bytes differ from space and text for either,
    have no tokens: zeros and an empty digest.  A link is an A and a B token whose bytes overlap; a pair's
    count is the number of documents that hold it linked, so a pair twice in a text counts once,
    and rows that repeat count each.  A link is best when its count is the highest of its A id,
    ties included.  An empty table gives no rows.

    Tokenising tasks spill pair-document records as zstd runs of about ``records`` links, radix-partitioned by
    the A id.  Of each part the runs' pairs, with the numbers of documents they already hold, are
    merged by a heap; ``fan`` runs at most at once, more in tiers.  Pairs come in the order of A ids, so
    totals and maxima stream back to each run while it is merged, aligned with its pairs, and each
    run adds up its documents.  A pair in every document is one entry a run, so no key is hot; a task
    holds a run, or one part's compressed runs.
    """
    runs = saved(spilled(docs, a_file, b_file, parts, records))
    blobs = runs.select(F.col("run").alias("member"), F.posexplode("pairs").alias("part", "one")).where(F.length("one") > 0)
    tiers, n = [], runs.count()
    while True:
        groups = -(-n // fan) or 1
        rows = blobs.select("part", F.pmod(F.xxhash64("member"), F.lit(groups)).alias("grp"), F.lit(1).alias("side"), "member", "one", F.lit(None).cast("binary").alias("two"))
        tiers.append(rows)
        if groups == 1:
            break
        blobs, n = saved(_dealt(rows).mapInArrow(_up, "part int, member long, one binary")), groups
    told = None
    for rows in reversed(tiers):
        if told is not None:
            given = told.select("part", F.col("member").alias("grp"), F.lit(0).alias("side"), F.col("seq").cast("long").alias("member"), "one", "two")
            rows = rows.unionByName(given)
        told = saved(_dealt(rows).mapInArrow(_down, TOLD))
    back = told.groupBy(F.col("member").alias("run")).agg(F.collect_list(F.struct("part", "seq", "one", "two")).alias("told"))
    documents = runs.join(back, "run", "left").select("docs", "pairs", "lists", "told").mapInArrow(
        _sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def listed(batches):
        for t in batches:
            for i in range(t.num_rows):
                for keys, n in frames(t["one"][i].as_buffer()):
                    yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

    pairs = _dealt(tiers[-1]).mapInArrow(_up, "part int, member long, one binary").select("one").mapInArrow(listed, "a int, b int, n long")
    return Alignment(documents, pairs)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("part", "grp").sortWithinPartitions("part", "grp", "side", "member")
