"""One query for each operator over its whole table, and SQL where SQL can say the same."""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from ..sources.artifacts import shared_folder
from .align import align
from .bpe import digests, tokens
from .common import table
from .exact import exact_groups
from .licences import scan, scan_sql
from .mixing import mix
from .near import near_groups
from .nearest import search
from .phrases import collocations
from .private import find, summary
from .quality import classify
from .repair import read_tokens, write_tokens
from .shards import assign
from .topk import top_products


def op1_mix(spark, sf_dir):
    placed = mix(table(spark, sf_dir, "documents")).placed
    return placed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_shards(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_licences(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def op5_token_files(spark, sf_dir):
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_near_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))


def op7_private(spark, sf_dir):
    return summary(find(table(spark, sf_dir, "documents")))


def op8_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(tokens(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op9_nearest(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))


def op10_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_topk(spark, sf_dir):
    return top_products(table(spark, sf_dir, "embeddings"))


def op12_align(spark, sf_dir):
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(table(spark, sf_dir, "documents"), *files).documents


def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


Q = {f.__name__: f for f in (op1_mix, op2_shards, op3_exact_dedup, op4_licences, op5_token_files, op6_near_dedup, op7_private,
                             op8_byte_bpe, op9_nearest, op10_quality, op11_topk, op12_align, op13_collocations)}

S = {
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)""",
    "op4_licences": scan_sql(),
    "op6_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN w = [''] THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
              FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (nx + ny - c)),
        r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
        FROM s JOIN m ON m.x = s.doc_id""",
    "op9_nearest": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op13_collocations": r"""
        WITH p AS (SELECT row_number() OVER () AS piece, lang, w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS w FROM documents)),
        q AS (SELECT piece, lang, unnest(string_split_regex(w, '[\x20\x09]+')) AS w, generate_subscripts(string_split_regex(w, '[\x20\x09]+'), 1) AS i FROM p),
        u AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
              FROM q WHERE w <> '' WINDOW o AS (PARTITION BY piece ORDER BY i)),
        k(k) AS (VALUES (1), (2), (3), (4), (5)),
        g AS (SELECT lang, 1 AS k, w1 AS phrase FROM u UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM u UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM u
              UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM u UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM u),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g WHERE phrase IS NOT NULL GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        e AS MATERIALIZED (SELECT * FROM f WHERE f >= 100),
        c AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM e WHERE k > 1),
        x AS (SELECT c.*, i.k AS i, array_to_string(w[1:i.k], ' ') AS head, array_to_string(w[i.k + 1:], ' ') AS tail FROM c JOIN k AS i ON i.k < c.m),
        y AS (SELECT x.lang, x.phrase, x.a, x.i, h.f AS l, t.f AS r, n.n, CAST(1000 * x.a::HUGEINT * n.n // (h.f::HUGEINT * t.f) AS BIGINT) AS score
              FROM x JOIN e AS h ON h.lang = x.lang AND h.phrase = x.head JOIN e AS t ON t.lang = x.lang AND t.phrase = x.tail JOIN n ON n.lang = x.lang),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS o FROM y),
        d AS (SELECT lang, array_to_string(w[1:m - 1], ' ') AS phrase, a FROM c UNION SELECT lang, array_to_string(w[2:], ' '), a FROM c),
        v AS (SELECT z.*, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS INTEGER) AS rank
              FROM z WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM d WHERE d.lang = z.lang AND d.phrase = z.phrase AND d.a >= z.a))
        SELECT lang, rank, phrase, a, l, r, n, score FROM v WHERE rank <= 2000""",
}
