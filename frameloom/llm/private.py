"""Personal data in texts: fixed patterns, and what a trained character tagger adds."""
from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tagger

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns.  A number with points can only start where no digit stands before it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A span of any kind holds one of these.
SIGNS = re.compile(r"[0-9@]|[(\[]at[)\]]")
WINDOW, STRIDE = 64, 32
#: An @ or one in words; what stands at a span's ends but isn't its own; what no phone number holds.
AT = re.compile(r"[^\W_]\s?(?:@|[(\[]at[)\]])\s?[^\W_]")
EDGES = frozenset(" \t\r\n,.;:!?\"'")
NO_PHONE = re.compile(r"[:,$%@]|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}|[0-9]{16}")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by the patterns, leftmost first and not overlapping within a kind; failing matches go."""
    found: list[Span] = []
    at, p = 0, text.find("@")
    while p >= 0:
        s = p
        while s > at and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, p + 1) if s < p else None
        if m:
            found.append((0, s, m.end()))
            at = m.end()
        p = text.find("@", max(p + 1, at))
    if SIGNS.search(text):
        # parts are compared as text first, so that very long ones need not become numbers
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x[-3:] if len(x) > 3 else x) < 256 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 64 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def tags_of(spans: list[Span], lo: int, hi: int) -> np.ndarray:
    """Tags of text[lo:hi]: 0 outside, 1 + 2 kind where a span begins, 2 + 2 kind inside; earlier kinds on top."""
    y = np.zeros(hi - lo, np.int64)
    for kind, s, e in sorted(spans, reverse=True):
        if s < hi and e > lo:
            y[max(s, lo) - lo:min(e, hi) - lo] = 2 + 2 * kind
            if s >= lo:
                y[s - lo] = 1 + 2 * kind
    return y


def windows(text: str) -> list[int]:
    """Starts of the windows with a sign in them; they overlap by half, and no span lies in another one."""
    starts: dict[int, None] = {}
    for m in SIGNS.finditer(text):
        k = m.start() // STRIDE
        for i in (k - 1, k):
            if i >= 0:
                starts[i * STRIDE] = None
    return list(starts)


def window_codes(text: str, start: int) -> np.ndarray:
    part = tagger.codes(text[start:start + WINDOW])
    return np.pad(part, (0, WINDOW - len(part)), constant_values=tagger.PAD)


def reconcile(starts: list[int], tags: np.ndarray, length: int) -> list[Span]:
    """Spans of a text from its windows' tags.

    At each place the window counts in which it is farthest from an edge; spans are then read off
    the tags of the whole text, so one that several windows see in part comes out once.
    """
    spans: list[Span] = []
    have, quarter = set(starts), (WINDOW - STRIDE) // 2
    kind, begin, last = -1, 0, -1

    def close(end):
        if kind >= 0:
            spans.append((kind, begin, end))

    for start, row in zip(starts, tags, strict=True):
        lo = start + quarter if start - STRIDE in have else start
        hi = start + WINDOW - quarter if start + STRIDE in have else min(start + WINDOW, length)
        if lo != last:
            close(last)
            kind = -1
        for i, tag in enumerate(row[lo - start:hi - start].tolist(), lo):
            k = (tag - 1) // 2 if tag else -1
            if k != kind or (tag and tag % 2):
                close(i)
                kind, begin = k, i
        last = hi
    close(min(last, length))
    return spans


def more_spans(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    """Those of the tagger's spans that touch no pattern's span and pass the checks of their kind.

    An email has an @ (or one in words in brackets) between word characters, an ip four parts of at
    most 255, a card 13 to 19 digits that pass Luhn, a phone number 9 to 15 digits and no date or
    amount in it; what stands between is free.  Blanks and marks at the ends are no part of it.
    """
    starts = np.array([s for _, s, _ in base], np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(np.array([e for _, _, e in base], np.int64)[order]) if base else starts
    out = []
    for kind, s, e in found:
        while s < e and text[s] in EDGES:
            s += 1
        while e > s and text[e - 1] in EDGES:
            e -= 1
        body = text[s:e]
        digits, numbers = re.sub("[^0-9]", "", body), re.findall("[0-9]+", body)
        plain = not any(c.isalpha() for c in body)
        good = (bool(AT.search(body)),
                plain and len(body) <= 31 and len(numbers) == 4 and all(len(x) < 4 and int(x) < 256 for x in numbers),
                plain and 13 <= len(digits) <= 19 and luhn(digits),
                plain and 9 <= len(digits) <= 15 and len(numbers) < 7 and not NO_PHONE.search(body))[kind]
        k = int(np.searchsorted(starts, e))  # spans that start before this one ends
        if good and not (k and ends[k - 1] > s):
            out.append((kind, s, e))
    return out


def _luhn_number(rng: random.Random, n: int) -> str:
    head = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(head + d for d in "0123456789" if luhn(head + d))


def unusual(rng: random.Random, kind: int) -> str:
    """Personal data of a kind in a form that the patterns don't match."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9)))
    if kind == 0:
        local = rng.choice([word(), f"{word()}.{word()}", f"{word()}{number(2)}", f"{word()}_{word()}"])
        host = rng.choice([f"{word()}.{word()[:3]}", f"{word()}-{word()}.com", f"{word()}.example.org"])
        return rng.choice([f"{local}@{word()}", f"{local}@{word()}-{word()}", f"{local} @ {host}", f"{local}[at]{host}", f"{local}(at){host}", f"{local} (at) {host}", f"{local} [at] {host}"])
    if kind == 1:
        sep = rng.choice([" . ", ". ", " .", "-", "[.]", ", ", " "])
        return sep.join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        digits = _luhn_number(rng, 16)
        return rng.choice([".", "/", "_", "  ", " - ", "\u2013"]).join(digits[i:i + 4] for i in range(0, 16, 4))
    a, b, c = number(3), number(3), number(4)
    return rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{number(2)} {number(2)} {number(7)}", f"0{number(3)} {number(7)}", f"0{number(3)}/{number(7)}"])


def harmless(rng: random.Random) -> str:
    """Numbers and signs that are no personal data but look alike."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    y, m, d = rng.randrange(1900, 2100), rng.randrange(1, 13), rng.randrange(1, 29)
    card = n(16)
    while luhn(card):
        card = n(16)
    return rng.choice([
        f"{y}-{m:02}-{d:02}", f"{m:02}/{d:02}/{y}", f"{d:02}.{m:02}.{y}", f"{d:02}:{m:02}:{rng.randrange(60):02}", f"{y}-{m:02}-{d:02} {d:02}:{m:02}:00",
        f"${n(1)},{n(3)}.{n(2)}", f"{n(2)},{n(3)},{n(3)}", f"v{n(1)}.{n(1)}.{n(2)}", f"{n(1)}.{n(1)}.{rng.randrange(300, 999)}.{rng.randrange(300, 999)}", f"{n(4)}-{n(4)}", f"3.{n(14)}",
        f"ORD-{y}-{n(4)}-{n(2)}", f"{n(1)} @ {n(2)} each", f"@{'abcdefg'[:rng.randrange(3, 7)]}", f"page {n(2)} of {n(3)}", f"{n(3)}-{n(3)}", "-".join(card[i:i + 4] for i in range(0, 16, 4)),
        ".".join(card[i:i + 4] for i in range(0, 16, 4)), f"{y}", n(1), n(2), n(5), n(8), f"{n(2)}%", f"{n(1)}, {n(1)}, {n(1)}, {n(1)} and {n(1)}", f"{y}\u2013{y + 3}", f"1{n(11)}"])


def written_windows(parts: list[str], each: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of ``parts`` of texts into which unusual spans or harmless look-alikes were written."""
    rng = random.Random(seed)
    x, y = np.zeros((each * len(parts), WINDOW), np.int64), np.zeros((each * len(parts), WINDOW), np.int64)
    for i in range(len(x)):
        text = parts[i % len(parts)][:rng.choice([WINDOW, WINDOW, rng.randrange(WINDOW)])]
        gaps = [m.end() for m in re.finditer(r"\s", text)] or [len(text)]
        at = rng.choice(gaps)
        kind = rng.randrange(2 * len(KINDS))
        body = unusual(rng, kind) if kind < len(KINDS) else harmless(rng)
        before, after = text[:at], rng.choice([" ", " ", ". ", ", ", "\n"]) + text[at:]
        whole = before + body + after
        lo = max(0, min(len(before) + rng.randrange(-40, 8), len(whole) - WINDOW))
        x[i] = window_codes(whole, lo)
        own = [(k, s, e) for k, s, e in base_spans(whole) if e <= at or s >= at + len(body)] + ([(kind, at, at + len(body))] if kind < len(KINDS) else [])
        tags = tags_of(own, lo, min(lo + WINDOW, len(whole)))
        y[i, :len(tags)] = tags
    return x, y


def training_windows(docs: DataFrame, sample: int, each: int = 3, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of labelled windows from at most ``sample`` windows of the texts.

    They are those of the smallest hashes, one for each text at most, so what comes to the driver is
    bounded by sample * WINDOW characters, however often a doc_id or a text repeats.  Each is taken
    with the patterns' spans in it, and ``each`` times with a span in a form that the patterns miss,
    or something harmless that looks alike, written into it: what the patterns find is easy,
    and what they miss is what there is to learn.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            parts = []
            for x in t["text"]:
                text = x.as_py() or ""
                own = windows(text)
                at = own[len(text) * 7919 % len(own)] if own else 0
                parts.append(text[at:at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], ["part"])

    found = docs.select("text").mapInArrow(cut, "part string").where("part <> ''").distinct()
    chosen = found.orderBy(F.xxhash64("part", F.lit(seed)), "part").limit(sample)
    parts = sorted(r.part for r in chosen.collect())
    if not parts:
        return np.empty((0, WINDOW), np.int64), np.empty((0, WINDOW), np.int64)
    x = np.stack([window_codes(part, 0) for part in parts])
    y = np.stack([np.pad(tags_of(base_spans(part), 0, len(part)), (0, WINDOW - len(part))) for part in parts])
    more_x, more_y = written_windows(parts, each)
    return np.concatenate([x, more_x]), np.concatenate([y, more_y])


def find(docs: DataFrame, sample: int = 8000, steps: int = 250) -> DataFrame:
    """One row per document: doc_id, base (the patterns' spans) and spans (all), arrays of (kind, start, end).

    Null text counts as empty; repeated rows are searched each.  Starts and ends count code
    points, ends exclusive, kinds are numbers into KINDS.  The tagger learns from ``sample`` windows of
    the texts (see ``training_windows``); it may add spans of the same kinds, in any text, where it
    reads one that no pattern's span touches.  Windows without a digit or @ hold no span, so only the
    others are decoded.  Without labelled windows nothing is added.
    """
    x, y = training_windows(docs, sample)
    model = tagger.train(x, y, 1 + 2 * len(KINDS), steps) if len(x) and y.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for t in batches:
            for lo in range(0, t.num_rows, 512):
                texts = [v.as_py() or "" for v in t["text"].slice(lo, 512)]
                base = [sorted(base_spans(v)) for v in texts]
                at = [windows(v) if model else [] for v in texts]
                added: list[list[Span]] = [[] for _ in texts]
                flat = [(i, s) for i, own in enumerate(at) for s in own]
                tags = np.empty((len(flat), WINDOW), np.int64)
                for j in range(0, len(flat), 2048):
                    tags[j:j + 2048] = tagger.decode(model, np.stack([window_codes(texts[i], s) for i, s in flat[j:j + 2048]]))
                used = 0
                for i, own in enumerate(at):
                    if own:
                        added[i] = more_spans(texts[i], base[i], reconcile(own, tags[used:used + len(own)], len(texts[i])))
                        used += len(own)
                rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b] for b in base]
                full = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in sorted(b + m)] for b, m in zip(base, added, strict=True)]
                yield pa.RecordBatch.from_arrays([t["doc_id"].slice(lo, 512), pa.array(rows, kind), pa.array(full, kind)], ["doc_id", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = "array<struct<kind:int,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, the number of the patterns' spans of each kind, their digest, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def digest_of(text: str) -> str:
    """The digest of a text's pattern spans, as ``summary`` gives it; for tests and single texts."""
    said = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(base_spans(text)))
    return hashlib.sha256(said.encode()).hexdigest()
