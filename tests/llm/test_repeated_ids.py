"""Documents without a doc_id, and several of one doc_id, through the pipeline's stages: each text has a verdict of its own."""
import hashlib
import random
import re
from collections import Counter

from frameloom.llm import exact, mixing, near, quality

from .fixture import docs, near_components


def prose(rng, n=40):
    return " ".join("".join(rng.choice(["th", "an", "er", "re", "on"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, 0, *["x"] * 10)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_exact(spark):
    rows = [row(5, "x"), row(5, "y"), row(3, "y"), row(None, "p"), row(None, "q"), row(None, "p"), row(None, "p", "de"), row(None, "y"), row(None, None)]
    for given in (rows, rows[::-1]):
        out = exact.kept_documents(docs(spark, given))
        assert texts(out) == Counter([(5, "x"), (3, "y"), (None, "p"), (None, "q"), (None, None)])
        assert [r.lang for r in out.collect() if r.text == "p"] == ["de"]


def test_near(spark):
    rng = random.Random(1)
    x, y, p, q, r = (prose(rng, 80) for _ in range(5))
    near_p, near_y = p + " end", y + " end"
    rows = [row(5, x), row(5, y), row(3, near_y), row(None, p), row(None, near_p), row(None, q), row(None, q), row(7, near_p.upper() + " " + r), row(None, near_y), row(None, ""), row(8, "")]
    assert near_components([row(1, p), row(2, near_p)])[2][1] == 1 and near_components([row(1, near_p), row(2, rows[7][1])])[2][1] == 2
    first = min(p, near_p, key=lambda t: hashlib.sha256(t.encode()).digest())
    for given in (rows, rows[::-1]):
        assert texts(near.representatives(docs(spark, given))) == Counter([(5, x), (3, near_y), (None, first), (None, q), (7, rows[7][1]), (None, ""), (8, "")])


def test_quality(spark):
    rng = random.Random(7)
    good = [prose(rng) for _ in range(200)]
    bad = [re.sub(" ", "!! ", prose(rng).upper()) for _ in range(5)]
    alone = [prose(rng) for _ in range(5)]
    rows = [row(i, t) for i, t in enumerate(good)] + [row(None, t) for t in bad + alone] + [row(500, bad[0]), row(500, alone[0])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    own = docs(spark, rows)
    verdict = [r.kept for r in quality.classify(own, labels).collect() if r.doc_id is None]
    assert sum(verdict) == 5
    out = texts(quality.good_documents(own, labels))
    assert {k: n for k, n in out.items() if k[0] in (None, 500)} == {**{(None, t): 1 for t in alone}, (500, alone[0]): 1}


def test_mix(spark):
    rng = random.Random(3)
    rows = [row(None, prose(rng, rng.randint(20, 60)), source=rng.choice("ab")) for _ in range(60)] + [row(i % 9, prose(rng, 30), source="b") for i in range(40)] + [row(None, "same text", source=s) for s in "aab"]
    placed = mixing.mix(docs(spark, rows), block_words=100).placed
    taken = Counter()
    for r in placed.collect():
        taken[r.doc_id, bytes(r.text_sha256)] += r.copies
    out = Counter((r.doc_id, hashlib.sha256(r.text.encode()).digest()) for r in mixing.mixed_documents(docs(spark, rows), block_words=100).collect())
    assert out == +taken and sum(out.values()) > 60
    # In one block the largest would go first; dealt over blocks, some larger ones stay out.
    alone = [row(None, prose(rng, 20 + i), source="a") for i in range(60)]
    half = mixing.mix(docs(spark, alone), share=0.5, block_words=100).placed.collect()
    assert min(r.size for r in half if r.copies) < max(r.size for r in half if not r.copies) - 10


def test_columns_named_like_helpers_stay(spark):
    """Columns of the caller's that bear the names used inside come out as they went in."""
    names = ["_text", "_nth", "_at", "_row", "_turn", "_stay", "_Doc", "_sha"]
    rows = [(i, t, "en", "a", *[f"{c}{i}" for c in names]) for i, t in enumerate(["one two", "one  two", "three four five", None, "six seven eight nine"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in names))
    from frameloom.llm.exact import kept_documents
    from frameloom.llm.mixing import mixed_documents
    from frameloom.llm.near import representatives
    for out in (kept_documents(df), representatives(df), mixed_documents(df)):
        got = out.collect()
        assert out.columns == df.columns and got
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)
