"""Token files, BPE, near duplicates, personal data, neighbours and quality against plain versions."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import bpe, near, nearest, private, quality, repair, tagger

from .fixture import docs, near_components, odd_rows

WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.integers(0, 60), st.integers(0, 60))
def test_grammar_round_trip(ids, a, b):
    x = np.array(ids, np.uint32)
    g = repair.Grammar.from_bytes(repair.compress(x, 4, 2, least=2).to_bytes())
    assert g.ids().tolist() == ids and g.ids(a, min(b, len(ids))).tolist() == ids[a:min(b, len(ids))]


@pytest.mark.parametrize("shard_tokens", [1 << 18, 100])
def test_token_files(spark, tmp_path, shard_tokens):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(WORDS)
    rows = sorted(odd_rows(), key=lambda r: -1 if r[0] is None else r[0])
    repair.write_tokens(docs(spark), str(tmp_path / "t"), WORDS, shard_tokens=shard_tokens)
    got = sorted(repair.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append([*lib.encode(r[1] or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        want[r.doc_id].remove(ids)
        assert r.start == at and r.n_tokens == len(ids)
        at += len(ids)
    repair.write_tokens(docs(spark, []), str(tmp_path / "e"), WORDS)
    assert repair.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_word_tokenizer_is_the_library():
    import pyarrow as pa
    coder, rng = repair.WordTokenizer(WORDS, most=50), random.Random(2)
    for _ in range(20):
        texts = ["".join(rng.choice(["a", "b'", "'s", " ", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", "É", "é", "İ", ".", "!?", "—", "9", "中", "'ll", "|", "\x85", " ", "\x1c", "ﬁ", "Σ", "<"]) for _ in range(rng.randrange(20))) for _ in range(200)]
        ids, lens = coder.encode(pa.array(texts))
        want = [e.ids for e in coder.lib.encode_batch(texts, add_special_tokens=False)]
        assert lens.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


ENC = bpe.encoder(RANKS, P.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\tab1'sé.,\x85\x1c_-lr中\U0001f600", max_size=80))
def test_halves_give_the_whole(text):
    ids = ENC.encode_ordinary(text)
    assert bpe.encode_tree(text, ENC.encode_ordinary, 3) == ids and bpe.decode_tree(ids, ENC.decode_bytes, 2) == text.encode()


def test_byte_bpe(spark):
    want = Counter((r[0], tuple(ENC.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in odd_rows())
    got = bpe.tokens(docs(spark), RANKS, P.PATTERN, leaf=64).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert bpe.tokens(docs(spark, []), RANKS, P.PATTERN).count() == 0


def family(n, seed=5):
    """Copies of a text with words changed, drawn apart step by step, among other texts with a passage in common."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        own = list(words)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        if i % 10 == 0:
            words = own
        rows.append((i + 1000, " ".join(own), "en", "a", 0, *["x"] * 10))
    passage = " ".join(f"p{i}" for i in range(40))
    return rows + [(i + 5000, passage + " " + " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(60)), "en", "a", 0, *["x"] * 10) for i in range(n)]


@pytest.mark.parametrize("small,depth", [(512, 16), (4, 1)], ids=["as it is", "with deep nodes and blocks"])
def test_near_groups(spark, monkeypatch, small, depth):
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "DEPTH", depth)
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 10] + family(60)
    want = near_components(rows)
    got = near.near_groups(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), r
    assert len({x for _, x in want.values()}) < len(rows) - 60


def test_near_odd_tables(spark):
    assert near.near_groups(docs(spark, [])).count() == 0
    got = near.near_groups(docs(spark)).collect()
    assert len(got) == len(odd_rows()) and all(r.component_id is not None for r in got if r.doc_id is not None)
    assert near.representatives(docs(spark)).columns == docs(spark).columns


def slow_spans(t):
    """The patterns as they are stated."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and private.luhn(d):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "1", "25", "300", "+", "-", " ", "(", ")", "4111111111111111", "x.y", "é", "_", "1.2.3.4", "+1 (555) 555-1234"]), max_size=14).map("".join))
def test_patterns(text):
    assert sorted(private.base_spans(text)) == sorted(slow_spans(text))


def test_patterns_are_linear():
    for text in ("1" * 100000, "a" * 100000 + "@", "1." * 50000, "+1" * 50000, "@a" * 50000, "0" * 99999 + "1.1.1.1"):
        private.base_spans(text)


def test_slopes():
    rng = np.random.default_rng(0)
    p, x, y = tagger.fresh(5, 3), rng.integers(0, tagger.SIZE, (7, 3)), rng.integers(0, 5, (7, 3))
    _, g = tagger.loss_and_slopes(p, x, y)
    for k in p:
        i = tuple(rng.integers(0, s) for s in p[k].shape) if k != "E" else (x[2, 1], 3)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert abs((tagger.loss_and_slopes(up, x, y)[0] - tagger.loss_and_slopes(down, x, y)[0]) / 2e-5 - g[k][i]) < 1e-6


def test_reconcile():
    text = "x" * 20 + " 10.20.30.40 " + "y" * 200 + " 1.2.3.4"
    starts = private.windows(text)
    base = private.base_spans(text)
    tags = np.stack([np.pad(private.tags_of(base, s, min(s + 64, len(text))), (0, max(0, s + 64 - len(text)))) for s in starts])
    assert sorted(private.reconcile(starts, tags, len(text))) == sorted(base)


def test_private(spark):
    rng = random.Random(1)

    def text(i):
        kind = i % 4
        span = [f"{'abcdefgh'[i % 8]}{i}@mail.example.com", f"10.{i % 250}.3.{i % 99}", "4111 1111 1111 1111", f"+1 (555) 555-{1000 + i}"][kind]
        return " ".join(rng.choice(["the", "of", "and", "ation"]) for _ in range(12)) + f" {span} " + " ".join(rng.choice(["the", "of"]) for _ in range(12))

    rows = odd_rows() + [(1000 + i, text(i), "en", "a", 0, *["x"] * 10) for i in range(200)]
    rows.append((2000, "the of and ation 4111.1111.1111.1111 and ation of", "en", "a", 0, *["x"] * 10))
    got = private.find(docs(spark, rows), steps=60).collect()
    want = Counter((r[0], tuple(sorted(slow_spans(r[1] or "")))) for r in rows)
    assert Counter((r.doc_id, tuple(tuple(s) for s in r.base)) for r in got) == want
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got)
    out = {r.doc_id: r for r in private.summary(private.find(docs(spark, rows), steps=1)).collect()}
    assert (out[14].n_email, out[14].n_ip, out[14].n_card, out[14].n_phone) == (1, 1, 1, 1) and out[14].base_sha256 == private.digest_of(odd_rows()[14][1])
    assert out[14].spans.startswith("email:5:22,ip:")
    assert private.find(docs(spark, [])).count() == 0


def test_tagger_learns():
    rng, x, y = random.Random(1), [], []
    for i in range(400):
        text = " ".join(rng.choice(["the", "of", "and", "12", "ation"]) for _ in range(8))[:30] + f" +1 ({rng.randrange(999):03}) 555-{rng.randrange(9999):04} the of and the of"
        text = text[:64]
        x.append(private.window_codes(text, 0))
        y.append(np.pad(private.tags_of(private.base_spans(text), 0, len(text)), (0, 64 - len(text))))
    x, y = np.stack(x), np.stack(y)
    p = tagger.train(x[:300], y[:300], 9, steps=60)
    assert (tagger.decode(p, x[300:]) == y[300:]).mean() > 0.97


def test_nearest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=8)], "x") for i in range(300)]
    rows += [(300, None, "x"), (320, [0.0] * 8, "x"), (340, [1.0, None] * 4, "x"), (360, [float("nan")] * 8, "x"), (380, [], "x"), (400, [1.0, 2.0, 3.0], "x"), (401, [1.0, 2.0, 4.0], "x"), (None, [1.0] * 8, "x")]
    rows += [rows[3], rows[20], rows[20], (500, rows[7][1], "x"), (501, rows[7][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string")
    got = defaultdict(list)
    for r in nearest.search(df, k=5, query_block=4, groups=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    ok = {i: v for i, v, _ in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    for q in [i for i in ok if i % 20 == 0]:
        best = []
        for i, v in ok.items():
            if i != q and len(v) == len(ok[q]):
                s = 0.0
                for a, b in zip(ok[q], v, strict=True):
                    s += a * b
                best.append((-s, i))
        assert got[q] == [(i, -s, n + 1) for n, (s, i) in enumerate(sorted(best)[:5])]
    assert nearest.search(df.limit(0)).count() == 0


def slow_model(texts):
    """Interpolated modified Kneser-Ney over three characters, in plain loops."""
    tri = Counter()
    for t in texts:
        c = [quality.START] * 2 + [ord(x) for x in t] + [quality.END]
        tri.update(zip(c, c[1:], c[2:], strict=False))
    bi, uni = Counter(g[1:] for g in tri), Counter()
    uni.update(g[1] for g in bi)

    def off(counts):
        return quality.discounts(*[sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)])

    d3, d2, d1 = off(tri), off(bi), off(uni)
    total = sum(uni.values())
    unseen = max(1.0, sum(d1[min(v, 3)] for v in uni.values())) / total / (len(uni) + 1)

    def lower(c):
        return (uni[c] - d1[min(uni[c], 3)]) / total + unseen if c in uni else unseen

    def p(a, b, c):
        own = {g: v for g, v in bi.items() if g[0] == b}
        q = lower(c)
        if own:
            q = max(0, bi[b, c] - d2[min(bi[b, c], 3)]) / sum(own.values()) + sum(d2[min(v, 3)] for v in own.values()) / sum(own.values()) * q
        own = {g: v for g, v in tri.items() if g[:2] == (a, b)}
        if own:
            q = max(0, tri[a, b, c] - d3[min(tri[a, b, c], 3)]) / sum(own.values()) + sum(d3[min(v, 3)] for v in own.values()) / sum(own.values()) * q
        return q
    return p


def test_losses(spark):
    rows = [r for r in odd_rows() if len(r[1] or "") < 2000]
    trained = [r[1] or "" for r in rows[::2]]
    p = slow_model(trained)
    model = quality.train(spark.createDataFrame([(t,) for t in trained], "text string"), 5)
    got = Counter((r.doc_id, r.n, round(r.nll, 6)) for r in quality.losses(docs(spark, rows), model, 5, group_blocks=1).collect())
    want = Counter()
    for r in rows:
        c = [quality.START] * 2 + [ord(x) for x in r[1] or ""] + [quality.END]
        want[r[0], len(c) - 2, round(-sum(math.log(p(*g)) for g in zip(c, c[1:], c[2:], strict=False)), 6)] += 1
    assert got == want


def test_classify(spark):
    rng = random.Random(7)
    good = [" ".join("".join(rng.choice(["th", "an", "er", "re", "on"]) for _ in range(rng.randint(1, 4))) for _ in range(40)) for _ in range(300)]
    bad = [re.sub(" ", "!! ", g.upper()) for g in good[:40]]
    rows = [(i, t, "en" if i % 3 else None, "a", 0, *["x"] * 10) for i, t in enumerate(good + bad)] + odd_rows()
    labels = spark.createDataFrame([(i, int(i < 300), 0, "x") for i in range(0, 340, 2)] + [(None, 1, 0, "x"), (9999, None, None, "x")], "doc_id long, quality int, toxic int, lang string")
    got = {r.doc_id: r for r in quality.classify(docs(spark, rows), labels, keep=0.98, least=20).collect() if r.doc_id is not None and r.doc_id >= 0}
    assert sum(got[i].kept for i in range(200, 300)) >= 95 and not any(got[i].kept for i in range(300, 340))
    nothing = quality.classify(docs(spark), labels.limit(0))
    assert nothing.count() == len(odd_rows()) and nothing.where("not kept").count() == 0
    assert quality.classify(docs(spark, []), labels).count() == 0


def test_counts_grow_with_the_input(spark, monkeypatch):
    n, own = 45_000, {}
    rows = spark.range(n).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang")
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    real = quality.train
    monkeypatch.setattr(quality, "train", lambda texts, shards: own.update(texts=texts.count()) or real(texts, shards))
    quality.classify(rows, labels)
    assert 22_000 < own["texts"] < 23_000


def test_links_of_a_node_are_a_forest():
    """A family just around the limit gives fewer links than members, and these join what all pairs join."""
    rng, base = random.Random(11), [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        w = list(base)
        for i in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            w[i] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    import pyarrow as pa
    flat, sizes = near.shingles(pa.array(texts))
    sets = np.split(flat, np.cumsum(sizes)[:-1])
    grp = np.array([i if i % 3 else 0 for i in range(90)])
    t = {"cls": np.arange(90), "grp": grp, "n_shingles": sizes, "sketch": near.sketches(flat, sizes)}
    found = near.links_of(t, sets, None, most=1000)

    def parts(links):
        up = list(range(90))

        def top(i):
            while up[i] != i:
                i = up[i]
            return i
        for a, b in [*links, *((0, i) for i in range(0, 90, 3))]:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return [top(i) for i in range(90)]

    pairs = [(a, b) for a in range(90) for b in range(a) if 100 * len({*sets[a]} & {*sets[b]}) >= 75 * len({*sets[a]} | {*sets[b]})]
    assert len(found) < len({*grp}) <= len(pairs) and parts(found) == parts(pairs)


def test_grammar_goes_on_until_no_pair_is_frequent():
    """260 copies of 1,000 different ids end as few symbols, and a short range needs few of the rules."""
    x = np.tile(np.arange(1000, dtype=np.uint32) + 5, 260)
    g = repair.compress(x, 2000, 2)
    assert len(g.sequence) <= 260 and (g.ids() == x).all() and g.ids(123_456, 123_460).tolist() == x[123_456:123_460].tolist()
    part = g._needed(np.array(g._inside(int(g.sequence[0]), 10, 14)))
    assert len(part.rules) <= 3 < len(g.rules)
    pairs = Counter(zip(g.sequence[:-1].tolist(), g.sequence[1:].tolist(), strict=True))
    assert max(pairs.values()) < 4


def test_token_files_order_of_shared_ids(spark, tmp_path):
    """Different texts of one doc_id, and of none, start at the same place however the rows are dealt."""
    rows = [(i, f"text {k} of {i}", "en", "a", 0, *["x"] * 10) for i in (5, None) for k in range(20)]
    got = []
    for n in (1, 5):
        at = str(tmp_path / f"t{n}")
        repair.write_tokens(docs(spark, rows[::n] + [r for i, r in enumerate(rows) if i % n]).repartition(n), at, WORDS)
        got.append(sorted((r.start, r.n_tokens, bytes(r.ids)) for r in repair.read_tokens(spark, at).collect()))
    assert got[0] == got[1] and len(got[0]) == 40


def test_tagger_adds_what_patterns_miss():
    """Trained on windows with unusual spans and look-alikes written in: held-out recall by kind, and look-alikes left alone."""
    rng = random.Random(3)
    parts = [" ".join(rng.choice(["the", "of", "and", "ation", "12", "in 2024,", "a@b.example.com", "10.0.0.1"]) for _ in range(12))[:64] for _ in range(500)]
    x, y = private.written_windows(parts[:400], 6)
    model, hits, asked, wrong = tagger.train(x, y, 9, 250), Counter(), Counter(), 0
    for i in range(600):
        kind, text = i % 6, parts[400 + i % 100]
        body = private.unusual(rng, kind) if kind < 4 else private.harmless(rng)
        at = rng.choice([m.end() for m in re.finditer(" ", text)])
        whole = f"{text[:at]}{body} {text[at:]}"
        base, starts = sorted(private.base_spans(whole)), private.windows(whole)
        if kind < 4 and any(s < at + len(body) and e > at for _, s, e in base):
            continue
        tags = tagger.decode(model, np.stack([private.window_codes(whole, s) for s in starts])) if starts else np.empty((0, 64), np.int64)
        own = private.more_spans(whole, base, private.reconcile(starts, tags, len(whole)))
        touch = [k for k, s, e in own if s < at + len(body) and e > at]
        asked[kind] += 1
        hits[kind] += kind in touch
        wrong += len(own) - len(touch) + (len(touch) if kind > 3 else 0)
    assert all(hits[k] > 0.6 * asked[k] > 20 for k in range(4)) and wrong <= 12, (hits, asked, wrong)


def test_more_spans_checks():
    checks = [("(202) 555-0143", 3, True), ("2024-01-15 12", 3, False), ("4111.1111.1111.1111", 2, True), ("4111.1111.1111.1112", 2, False), ("192 . 168 . 0 . 1", 1, True),
              ("192 . 168 . 0 . 256", 1, False), ("name@intranet", 0, True), ("name (at) host.org", 0, True), ("@handle", 0, False), ("$1,234,567.89", 3, False)]
    for body, kind, good in checks:
        text = f"x {body}, y"
        assert private.more_spans(text, [], [(kind, 1, 3 + len(body))]) == ([(kind, 2, 2 + len(body))] if good else [])
    assert private.more_spans("a 555-123-4567", [(3, 0, 4)], [(3, 2, 14)]) == []
    many = [(1, i, i + 2) for i in range(0, 400_000, 4)]
    assert len(private.more_spans("5 " * 200_000, many, [(3, i, i + 20) for i in range(0, 300_000, 30)])) == 0
