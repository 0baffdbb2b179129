"""Exact dedup, mixing, sharding and licence scans against plain loops."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from frameloom.llm import exact, licences, mixing, shards

from .fixture import WORD, docs, odd_rows


def normal(x):
    return re.sub(r"[\x20\x09-\x0D]+", " ", x or "")


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(2))], ids=["as it is", "with colliding digests"])
def test_exact_groups(spark, digest):
    rows = odd_rows() + [(200 + i, ("Some words of a clause, again. " * 60 + str(i % 2)), "en", "a", 0, *["x"] * 10) for i in range(4)]
    got = exact.exact_groups(docs(spark, rows), digest).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    want = Counter((r[0], min((i for i in groups[normal(r[1])] if i is not None), default=None), len(groups[normal(r[1])]), hashlib.sha256(normal(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_empty_and_kept(spark):
    assert exact.exact_groups(docs(spark, [])).count() == 0
    stay = exact.kept_documents(docs(spark)).collect()
    assert len({normal(r.text) for r in stay}) == len(stay) == len({normal(r[1]) for r in odd_rows()})
    assert all(r.row == "x" for r in stay)


def water(words, weights, share):
    """Targets by resharing the excess until none is above."""
    left, open_, out = share * sum(words.values()), set(words), {}
    while open_:
        over = {s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) >= 2 * words[s]}
        for s in over or open_:
            out[s] = 2.0 * words[s] if over else left * weights[s] / sum(weights[x] for x in open_)
        left -= sum(out[s] for s in over)
        open_ -= over or set(open_)
    return out


def test_mix(spark):
    rows = odd_rows()
    mix = mixing.mix(docs(spark), block_words=100, shard_words=1500)
    got = mix.placed.collect()
    words = Counter()
    for r in rows:
        words[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted((s for s in words if s is not None)) + [None]
    goal = water(words, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5)
    assert len(got) == len(rows)
    taken, sizes = Counter(), defaultdict(Counter)
    for r in got:
        assert r.source_size == words[r.source] and abs(r.target - goal[r.source]) < 1e-6 and r.taken == r.copies * r.size and 0 <= r.copies <= 2 and len(r.draws) == r.copies
        taken[r.source] += r.taken
        for d in r.draws:
            sizes[d.shard][r.source] += r.size
    for s in names:
        smallest = min((r.size for r in got if r.source == s and r.size), default=0)
        assert abs(taken[s] - goal[s]) <= max(smallest + 0.5, 0.5 * goal[s] if s in ("b", "d") else 0.06 * goal[s]), s
    assert mix.n_shards > 1 and set(sizes) <= set(range(mix.n_shards))
    per = defaultdict(list)
    for r in mix.shards.orderBy("source_no", "shard").collect():
        per[r.source_no].append((r.first, r.last))
    assert all(a[1] + 1 == b[0] for x in per.values() for a, b in zip(x, x[1:], strict=False))
    again = {(r.doc_id, r.row, r.copies) for r in mixing.mix(docs(spark), block_words=100, shard_words=1500).placed.select("doc_id", "row", "copies").collect()}
    assert again == {(r.doc_id, r.row, r.copies) for r in got}
    out = mixing.mixed_documents(docs(spark), block_words=100, shard_words=1500)
    assert out.columns == docs(spark).columns and out.count() == sum(r.copies for r in got)


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).placed.count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, None, None, None, 0, *["x"] * 10)])).placed.collect()] == [0]


def test_split_tree(spark):
    quotas = [500, 37, 0, 1, 260]
    rows = mixing.split_tree(spark.createDataFrame([(quotas,)], "quotas array<bigint>"), 7).collect()
    assert [sum(r.quotas[i] for r in rows) for i in range(5)] == quotas and len(rows) == 7
    assert max(sum(r.quotas) for r in rows) - min(sum(r.quotas) for r in rows) <= 1


def test_hypergeometric(spark):
    from math import comb
    d = spark.range(4000).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(12).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / 4000).alias("x"))
    seen = {r.x: r["count"] / 4000 for r in d.groupBy("x").count().collect()}
    for k in range(11):
        assert abs(seen.get(k, 0) - comb(12, k) * comb(18, 10 - k) / comb(30, 10)) < 6e-4


def test_shards(spark):
    rows = odd_rows()
    got = shards.assign(docs(spark), bucket_rows=1).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 24) for r in got) and len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert shards.assign(docs(spark, [])).count() == 0


def test_movement_stays_in_the_subtree(spark):
    tree = [[[1, 2], [1]], [[1, 1], [3]]]
    heavier = [[[1, 2], [1]], [[1, 1.5], [2.5]]]  # the second region's own weight stays
    key = F.xxhash64("id")
    got = spark.range(20000).select(shards.shard_of(key, tree).alias("a"), shards.shard_of(key, heavier).alias("b")).collect()
    n = Counter(r.a for r in got)
    for s, w in enumerate([1, 2, 1, 1, 1, 3]):
        assert abs(n[s] / 20000 - w / 9) < 0.02
    moved = Counter((r.a, r.b) for r in got if r.a != r.b)
    assert moved and all(a >= 3 and b >= 3 for a, b in moved)


def test_licences(spark):
    got = {(r.doc_id, r.licence): (r.dice, r.n_parts) for r in licences.scan(docs(spark)).collect()}
    assert got == {(13, "MIT"): (1.0, 1)}
    rows = [(1, "x.\nThis work is Licensed under the GNU General Public License version 3", "en", "a", 0, *["x"] * 10), (2, "licensed under CC BY NC 4 0", "en", "a", 0, *["x"] * 10), (3, "under the", "en", "a", 0, *["x"] * 10)]
    got = {(r.doc_id, r.licence): r.dice for r in licences.scan(docs(spark, rows)).collect()}
    assert got == {(1, "GPL-3.0"): 1.0, (2, "CC-BY-NC-4.0"): 1.0}
    assert licences.scan(docs(spark, [])).count() == 0


def test_licences_and_their_neighbours(spark):
    """Each template is found as its own licence, also when wrapped over lines inside a paragraph, and as no neighbour's."""
    rows, want = [], {}
    for i, (name, text) in enumerate(licences.TEMPLATES):
        words = text.split()
        wrapped = "Some words before it. " + "\n".join(" ".join(words[j:j + 5]) for j in range(0, len(words), 5)) + " And some\nafter it."
        for k, t in enumerate((text, wrapped)):
            rows.append((2 * i + k, t, "en", "a", 0, *["x"] * 10))
            want[2 * i + k] = name
    got = {}
    for r in licences.scan(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, {})[r.licence] = r.dice
    assert {i: max(x, key=x.get) for i, x in got.items()} == want
    assert all(abs(max(x.values()) - 1) < 1e-9 for i, x in got.items() if i % 2 == 0)
