"""Cross-tokenizer alignment against plain loops over all token pairs."""
import hashlib
from collections import Counter

import public_tokenizers as P
import pytest

from frameloom.llm import align

from .fixture import docs, odd_rows

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return align.Both(*FILES)


def spans(table, ids):
    out, at = [], 0
    for i in ids:
        n = int(table.lens[i])
        out.append((at, at + n))
        at += n
    return out


def plain(both, texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), and the count of each pair."""
    links, firsts = [], []
    for x in texts:
        found, told = Counter(), (0, 0, 0, "")
        if x:
            (a,), (b,) = both.encode([x])
            raw = (" " + x).encode()
            if both.bytes_a.of(a).tobytes() == raw == both.bytes_b.of(b).tobytes():
                sa, sb = spans(both.bytes_a, a), spans(both.bytes_b, b)
                for i, (s, e) in zip(a, sa, strict=True):
                    for j, (u, v) in zip(b, sb, strict=True):
                        if max(s, u) < min(e, v):
                            found[(i, j)] += 1
                shared = sorted({e for _, e in sa} & {e for _, e in sb})
                groups, lo = [], 0
                for hi in shared:
                    groups.append(",".join(str(i) for i, (s, e) in zip(a, sa, strict=True) if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, (s, e) in zip(b, sb, strict=True) if lo <= s and e <= hi))
                    lo = hi
                told = (len(a), len(b), len(shared), hashlib.sha256(";".join(groups).encode()).hexdigest())
        links.append(found)
        firsts.append(told)
    count = Counter(p for f in links for p in f)
    top = Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    rows = [(t[0], t[1], t[2], sum(f.values()), sum(m for p, m in f.items() if count[p] == top[p[0]]), sum(m * count[p] for p, m in f.items()), t[3]) for f, t in zip(links, firsts, strict=True)]
    return rows, count


def texts():
    more = ["  two  blanks", "▁ sign", "ﬁ ligature é", "<s> <|endoftext|> </s> <0x41>", "\n\n\ta\r\n", "tail ", " ", "\x00null", "a" * 500, "中文字 \U0001f600\U0001f600"]
    return [(800 + i, x, "en", "s", 0, *["x"] * 10) for i, x in enumerate(more)]


@pytest.mark.parametrize("options", [{}, {"parts": 3, "records": 40, "fan": 3}, {"parts": 2, "records": 900, "fan": 100}])
def test_plain_loops(spark, both, options):
    rows = [r for r in odd_rows() + texts() if len(r[1] or "") < 9000]
    want, count = plain(both, [r[1] for r in rows])
    made = align.align(docs(spark, rows).repartition(3), *FILES, **options)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[n] for n in names) for r in made.documents.collect()) == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))
    if options.get("fan") != 3:
        assert {(r.a, r.b): r.n for r in made.pairs.collect()} == dict(count)


def test_long_text(both):
    """A very long text is aligned whole."""
    x = odd_rows()[9][1] * 3
    c = align.cut(both, [x, None, ""])
    assert c.links[0] == c.n_a[0] + c.n_b[0] - c.groups[0] and c.links[1:].sum() == 0 and c.digests[1:] == ["", ""]


def test_empty(spark):
    made = align.align(docs(spark, []), *FILES)
    assert made.documents.collect() == [] and made.pairs.collect() == []
    none = align.align(docs(spark, [(1, None, None, None, 0, *["x"] * 10)]), *FILES).documents.collect()
    assert [tuple(r) for r in none] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_frames_and_heap():
    import numpy as np
    a, b = np.arange(0, 9000, 3), np.arange(0, 9000, 2)
    runs = [align.pack(a, np.ones(len(a), np.int64)), align.pack(b, np.full(len(b), 2))]
    got = {k: sum(n for _, n in same) for k, same in align.merge(runs)}
    assert list(got) == sorted({*a.tolist(), *b.tolist()}) and got[6] == 3 and got[3] == 1 and got[2] == 2


def test_parts_are_the_library(both):
    """Texts of plain characters, encoded part by part, get the library's ids; also when what is kept is dropped."""
    import random
    rng, few = random.Random(4), align.Both(*FILES, most=3)
    signs = ["a", "B", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "×", "²", "½", "ª", "9", "12", ".", "!?", "—", "€", "_", "<|endoftext|>", "ŉ", "ƀ", "«"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(3000)]
    want = [e.ids for e in both.a.encode_batch([f" {x}" for x in texts], add_special_tokens=False)]
    assert all(align.PLAIN.fullmatch(x) for x in texts)
    assert both.encode(texts)[0] == want and few.encode(texts)[0] == want
