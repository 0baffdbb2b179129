"""Small tables with all the odd rows, and plain-loop versions of what operators compute."""
from __future__ import annotations

import random
import re

from pyspark.sql import types as T

#: Columns that clash with names that operators use inside.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("size", T.StringType()), T.StructField("node", T.StringType()),
                       T.StructField("h", T.StringType()), T.StructField("cls", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("kept", T.StringType()),
                       T.StructField("target", T.StringType()), T.StructField("grams", T.StringType()), T.StructField("base", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows() -> list[tuple]:
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choice(["th", "an", "er", "re", "on", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    base = prose(80)
    near = base.split()
    near[40] = "changed"
    texts = [(1, base, "en", "a"), (2, base.replace(" ", "\n", 3), "en", "a"), (3, " ".join(near), "en", "b"), (4, "", "en", "b"), (5, None, None, None), (6, "   ", "fr", "c"),
             (7, "one", "de", "c"), (8, "One", "de", "a"), (9, "two words", "en", "a"), (10, prose(3000), "en", "b"), (10, None, "en", "b"), (11, "x" * 30000, None, "d"),
             (12, "Naïve é中文 \U0001f600 text\twith\x0bodd\x1cmarks", "fr", "é"), (13, prose(30) + ". Released under the MIT License.", "en", "a"),
             (14, "mail a.b@c.example.org or +1 (555) 555-1234, 10.0.0.1, 4111 1111 1111 1111", "en", "a"), (None, prose(20), "en", "a"), (None, base, "en", "a")]
    texts += [(20, prose(25), "en", "a")] * 3
    texts += [(30 + i, prose(60), rng.choice(["en", "fr"]), "hot") for i in range(40)]
    texts += [(100 + i, base, "en", "hot") for i in range(30)]
    return [(*t, 0, *["x"] * 10) for t in texts]


def docs(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def near_components(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest doc_id reachable), by comparing all pairs."""
    sets = {}
    for r in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets[r[0]] = frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids, up = sorted(sets), {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}
