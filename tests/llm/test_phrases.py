"""Phrase mining against plain counting."""
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from frameloom.llm import phrases

from .fixture import docs, odd_rows


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for r in rows:
        lang = r[2] or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[(lang, tuple(w[i:i + k]))] += 1
    cand = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    gone = set()
    for (lang, p), c in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * c >= 100 * cand[(lang, p[i:i + k])]:
                    gone.add((lang, p[i:i + k]))
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in gone:
            cuts = [(1000 * a * n[lang] // (f[(lang, p[:k])] * f[(lang, p[k:])]), k, f[(lang, p[:k])], f[(lang, p[k:])]) for k in range(1, len(p))]
            s, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def rows(seed):
    rng = random.Random(seed)
    words = [*"abcdefgh", "É", "née", "THE", "the", "中文", "\x00", "x\xa0y"]
    out = list(odd_rows())
    for i in range(60):
        text = "".join(rng.choices(words, k=1)[0] + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(80)))
        out.append((500 + i, text + " of the people by the people " * rng.randrange(3), rng.choice(["en", "fr", None, "und"]), "s", 0, *["x"] * 10))
    return out


@pytest.mark.parametrize("budget", [1 << 20, 40, 5])
def test_plain_counting(spark, budget):
    x = rows(budget)
    got = phrases.collocations(docs(spark, x), least=4, top=300, budget=budget)
    assert sorted(tuple(r) for r in got.collect()) == brute(x, 4, 300)


def test_codes_shared_by_words(spark, monkeypatch):
    """A frequent word whose code another word shares makes all words coded anew."""
    import xxhash
    real = xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w, seed=0: 7 if seed == 0 and w in (b"a", b"b") else real(w, seed))
    x = pa_words(["a b a", "B c"], 0)
    y = pa_words(["a b a", "B c"], 1)
    assert len(set(x.codes.tolist())) == 2 and len(set(y.codes.tolist())) == 3
    assert [y.names[i].as_py() for i in y.at] == ["a", "b", "a", "b", "c"]


def pa_words(texts, seed):
    return phrases.Words.of(pa.array(texts), pa.array([None] * len(texts), pa.string()), seed)


def test_empty(spark):
    assert phrases.collocations(docs(spark, [])).collect() == []
    only = [(1, None, None, None, 0, *["x"] * 10), (2, " .;\n", "en", None, 0, *["x"] * 10)]
    assert phrases.collocations(docs(spark, only), least=1).collect() == []


class Step:
    """Stands for a frame: keeps the first function that is mapped over it, and goes on as an empty one."""
    def __init__(self, spark):
        self.spark, self.run = spark, None

    def mapInArrow(self, run, schema):
        self.run = self.run or run
        return self.spark.createDataFrame([], schema)

    def select(self, *_):
        return self

    repartition = withColumn = sortWithinPartitions = select


def mapped(run, batches):
    """What ``run`` gives, and the most MB that numpy held meanwhile."""
    tracemalloc.start()
    try:
        return list(run(iter(batches))), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def prose(spaces):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{x:x}" for x in rng.zipf(1.3, 2000) % spaces) for _ in range(600)]
    return pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * len(texts)})


@pytest.mark.parametrize("spaces", [1 << 20, 2])
def test_memory_of_a_slice(spark, spaces):
    """A slice of 1.2 million words, many or two, is worked on in parts and leaves in small batches."""
    t, every = prose(spaces), SimpleNamespace(value=np.full(1 << (phrases.BITS - 3), 255, np.uint8))
    words, pairs, longer = Step(spark), Step(spark), Step(spark)
    phrases.counted_words(words, 0)
    phrases.counted_pairs(pairs, 0, every, 100)
    phrases.suffixes(longer, 0, every, {}, 8)
    for step, n in ((words, 2000), (pairs, 1999), (longer, 1998)):
        out, most = mapped(step.run, [t])
        assert sum(pa.compute.sum(b["n"]).as_py() for b in out) == 600 * n
        assert max(b.num_rows for b in out) <= phrases.PART
        assert most < 120, most


def test_memory_of_a_group(spark):
    """A group of many prefixes becomes trees in parts, and the counts are those of the whole."""
    rng, n = np.random.default_rng(2), 600_000
    codes = rng.integers(0, [900, 900, 3, 3, 3], (n, phrases.DEPTH)).astype(np.uint64)
    prefix = (codes[:, 0] * np.uint64(900) + codes[:, 1]).astype(np.int64)
    order = np.argsort(prefix, kind="stable")
    codes, prefix = codes[order], prefix[order]
    keys = phrases._keys(codes, np.full(n, phrases.DEPTH))
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, 2, np.int32)), pa.array(["en"] * n), keys, pa.array(np.ones(n, np.int64)), pa.array(prefix)],
                                      ["grp", "whole", "lang", "key", "n", "prefix"])
    step = Step(spark)
    phrases.subtrees(step, 1, 2)
    out, most = mapped(step.run, [rows.slice(i, 10_000) for i in range(0, n, 10_000)])
    got = {k.as_py(): c.as_py() for b in out for k, c in zip(b["key"], b["n"], strict=True)}
    full = Counter(r[:8 * k] for r in keys.to_pylist() for k in (3, 4, 5))
    assert got == {k: c for k, c in full.items() if c >= 2}
    assert sum(b.num_rows for b in out) == len(got) and most < 60, most
