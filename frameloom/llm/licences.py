"""Licence scans: parts of a text against licence templates by their word bigrams."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What public licences and the notices for them say.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of normalised text: ASCII other than letters and digits.
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Words that many texts hold; a search for licences starts from others where it can.
COMMON = frozenset("a above all and any as at by copy following for from general in included including into is it its may not of or other provided public purpose released "
                   "shall source subject that the this to under use version whom with without you".split())


def words_of(text: Column) -> Column:
    """Words of the normalised text: A-Z lower-cased, marks and white space gone."""
    return F.split(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), MARKS, " ")), " ")


def bigrams(words: Column) -> Column:
    """The bag of pairs of neighbouring words as a set: a pair's n-th repetition carries its number."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    def number(all_: Column) -> Column:
        return F.transform(all_, lambda p, i: F.concat(p, F.lit("#"), F.size(F.filter(F.slice(all_, 1, i), lambda q: q == p)).cast("string")))
    return F.transform(F.array(pairs), number)[0]


def parts(text: Column) -> Column:
    """What a template is held against: the sentences, lines and paragraphs of a text, and the whole.

    Sentences end at line feeds, and once more only at paragraphs, so one that is wrapped over lines is whole too.
    """
    ends = r"([.!?])[\x20\x09-\x0D]+"
    sentences = F.split(F.regexp_replace(text, ends, "$1\n"), "\n")
    joined = F.translate(F.regexp_replace(text, "\n\n+", "\x01"), "\n", " ")
    wrapped = F.split(F.regexp_replace(joined, ends, "$1\x01"), "\x01")
    return F.array_distinct(F.concat(sentences, wrapped, F.split(text, "\n"), F.split(text, "\n\n+"), F.array(text)))


def template_bigrams(text: str) -> list[str]:
    words = "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text).split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return [f"{p}#{pairs[:i].count(p)}" for i, p in enumerate(pairs)]


def needed_words(known: list[list[str]], least: float) -> list[str]:
    """Words of which a text holds at least one wherever a template can match.

    A match shares ``least / (2 - least)`` of a template's m bigrams, so it can't do without any of
    the words that stand in more than the rest of them.  Words in use come first, then long ones, common ones last.
    """
    words: dict[str, None] = {}
    for grams in known:
        spare = len(grams) - len(grams) * least / (2 - least)
        left = [g.split("#")[0].split() for g in grams]
        for word in sorted({w for g in left for w in g}, key=lambda w: (w not in words, w in COMMON, -len(w), w)):
            if len(grams) - len(left) > spare:
                break
            words[word] = None
            left = [g for g in left if word not in g]
    return list(words)


def scan(docs: DataFrame, templates=tuple(TEMPLATES), least: float = 0.75) -> DataFrame:
    """One row for each document and licence found in it: doc_id, licence, dice, n_parts.

    A part has the licence of the template of the highest Dice coefficient of their bags of bigrams, of
    equals the first name, if that is ``least`` or more; dice is the document's best for a
    licence, n_parts how many of its different parts have it.  Only templates whose size
    can reach that with the part's size are candidates: with m and n bigrams, n must lie from
    m * least / (2 - least) to m * (2 - least) / least.  Null, empty and one-word texts match
    nothing; rows that repeat a doc_id are put together.  Texts without any of ``needed_words`` can't
    match and are passed over by plain substring searches.  The templates are a constant of the
    plan, so nothing is broadcast or joined; only matches are shuffled.
    """
    known = [(name, grams) for name, text in templates if (grams := template_bigrams(text))]
    sizes = [len(g) for _, g in known]
    table = F.array(*[F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("n")) for name, g in known])
    lo, hi = min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least

    needed = needed_words([g for _, g in known], least)

    def may(text: Column) -> Column:
        return F.exists(F.array(F.lower(text)), lambda t: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in needed]))

    # Each step's arrays come out of a generator, so no later step makes them again; explode_outer, as
    # for explode the optimiser adds a filter on the size, which would.
    own = F.filter(parts(F.col("text")), may)
    sized = F.filter(F.transform(own, words_of), lambda w: (F.size(w) - 1 >= lo) & (F.size(w) - 1 <= hi))
    pairs = docs.select("doc_id", "text").where(may(F.col("text"))).select("doc_id", F.explode_outer(sized).alias("words")).where("words is not null")
    pairs = pairs.select("doc_id", F.explode_outer(F.transform(F.array("words"), bigrams)).alias("pairs"))
    n = F.size("pairs")
    fits = F.filter(table, lambda t: (n >= t["n"] * least / (2 - least)) & (n <= t["n"] * (2 - least) / least))
    dice = F.transform(fits, lambda t: F.struct((-2.0 * F.size(F.array_intersect(t["grams"], F.col("pairs"))) / (t["n"] + n)).alias("minus"), t["licence"].alias("licence")))
    best = F.filter(F.array(F.array_min(dice)), lambda t: t["minus"] <= -least)
    hits = pairs.select("doc_id", F.array_sort("pairs").alias("grams"), F.explode_outer(best).alias("hit")).where("hit is not null")
    hits = hits.select("doc_id", "grams", F.col("hit.licence").alias("licence"), (-F.col("hit.minus")).alias("dice"))
    best = hits.groupBy("doc_id", "licence", "grams").agg(F.max("dice").alias("dice"))
    return best.groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"), F.count(F.lit(1)).alias("n_parts"))


def scan_sql(templates=tuple(TEMPLATES), least: float = 0.75) -> str:
    """The same in SQL of another engine; there the templates are a table and parts are joined to those of fitting size."""
    def text(x):
        return "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({text(n)}, [{', '.join(map(text, g))}])" for n, t in templates if (g := template_bigrams(t)))
    return rf"""
        WITH t(licence, b) AS (VALUES {rows}),
        d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        p AS (SELECT doc_id, unnest(list_distinct(list_concat(list_concat(list_concat(
                  string_split(regexp_replace(text, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)),
                  string_split(regexp_replace(translate(regexp_replace(text, '\n\n+', chr(1), 'g'), chr(10), ' '), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1))),
                  string_split(text, chr(10))),
                  list_append(string_split_regex(text, '\n\n+'), text)))) AS part FROM d),
        w AS (SELECT doc_id, string_split(trim(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w FROM p),
        q AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS q FROM w),
        g AS (SELECT DISTINCT doc_id, list_sort(list_transform(range(1, len(q) + 1), lambda i: q[i] || '#' || len(list_filter(q[1:i - 1], lambda x: x = q[i])))) AS g
              FROM q WHERE len(q) BETWEEN 1 AND 1000),
        h AS (SELECT doc_id, licence, g, max(2.0 * len(list_intersect(g, b))::DOUBLE / (len(g) + len(b))) AS dice
              FROM g JOIN t ON len(g) BETWEEN len(b) * {least} / (2 - {least}) AND len(b) * (2 - {least}) / {least} GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY dice DESC, licence) AS nth FROM h)
        SELECT doc_id, licence, max(dice) AS dice, count(*) AS n_parts FROM r WHERE nth = 1 AND dice >= {least} GROUP BY 1, 2"""
