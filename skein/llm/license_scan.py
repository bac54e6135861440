"""Licence scans: lines, and windows of words across lines, against licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.native import ascii_lower, lines_of

THRESHOLD = 0.8
#: Well-known notices by SPDX id; fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Templates become literals in the plan; beyond this many, scan in several passes.
MOST_TEMPLATES = 2000


def bigrams(text: str) -> list[str]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _anchors(templates, threshold: float) -> list[str]:
    """Words of which each line that can reach the threshold has at least one.

    Dice >= t needs an overlap of at least m * t / (2 - t) of a template's m bigrams; so one of any
    m - that + 1 bigrams is in the line, and with it the bigram's longer word.
    """
    out = set()
    for _, text in templates:
        grams = bigrams(text)
        need = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        by_rarity = sorted(grams, key=lambda g: (-max(map(len, g.split())), g))
        out |= {max(g.split(), key=lambda w: (len(w), w)) for g in by_rarity[: len(grams) - need + 1]}
    return sorted(out)


def _words(line: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(ascii_lower(line), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.array_distinct(F.when(F.size(words) >= 2, pairs).otherwise(F.array().cast("array<string>")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _passages(words: Column, known, threshold: float) -> Column:
    """Windows of ``words`` that reach the threshold, as (start, end, license, dice) by place; see ``scan``."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    kinds, every = [], set()
    for i, (name, text) in enumerate(known):
        grams, own = bigrams(text), _anchors([(name, text)], threshold)
        need, most = math.ceil(len(grams) * low - 1e-9), math.floor(len(grams) * high + 1e-9)
        arrays = [F.array(*map(F.lit, x)).alias(k) for k, x in (("grams", grams), ("anchors", own))]
        kinds.append(F.struct(F.lit(i).alias("at"), F.lit(name).alias("license"), F.lit(len(grams)).alias("m"), F.lit(need).alias("need"), F.lit(most).alias("most"), *arrays))
        every |= set(own)
    found = "array<struct<rank:double,start:int,back:int,at:int,end:int,license:string,dice:double>>"

    def window(grams: Column, t: Column, p: Column, q: Column) -> Column:
        own = F.slice(grams, p, q - p + 1)
        dice = 2.0 * F.size(F.array_intersect(own, t["grams"])) / (F.size(F.array_distinct(own)) + t["m"])
        return F.struct((-dice).alias("rank"), p.alias("start"), (-q).alias("back"), t["at"].alias("at"), q.alias("end"), t["license"].alias("license"), dice.alias("dice"))

    def windows(grams: Column, t: Column) -> Column:
        """Those that begin and end with bigrams of the template; any other has a better one within it."""
        places = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.array_contains(t["grams"], F.element_at(grams, i)))

        def pairs(at: Column) -> Column:
            dense = F.filter(F.sequence(F.lit(1), F.size(at) - t["need"] + 1), lambda j: F.element_at(at, (j + t["need"] - 1).cast("int")) - F.element_at(at, j) < t["most"])
            ends = lambda j: F.filter(F.slice(at, j + t["need"] - 1, t["most"] - t["need"] + 1), lambda q: q - F.element_at(at, j) < t["most"])
            tried = F.flatten(F.transform(dense, lambda j: F.transform(ends(j), lambda q: window(grams, t, F.element_at(at, j), q))))
            return F.when(F.size(at) >= t["need"], F.filter(tried, lambda x: x["dice"] >= threshold)).otherwise(F.array().cast(found))

        return _let(places, pairs)

    def apart(all_: Column) -> Column:
        meets = lambda a, x: (a["start"] <= x["end"] + 1) & (x["start"] <= a["end"] + 1)
        return F.aggregate(F.array_sort(all_), F.array().cast(found), lambda acc, x: F.when(F.exists(acc, lambda a: meets(a, x)), acc).otherwise(F.concat(acc, F.array(x))))

    def search(present: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
        likely = F.filter(F.array(*kinds), lambda t: F.arrays_overlap(t["anchors"], present))
        run = _let(pairs, lambda grams: apart(F.flatten(F.transform(likely, lambda t: windows(grams, t)))))
        return F.when((F.size(present) > 0) & (F.size(words) >= 2), run).otherwise(F.array().cast(found))

    return _let(F.array_intersect(words, F.array(*map(F.lit, sorted(every)))), search)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with ``n_lines``, ``hits``: array of (line, license, dice) in line order, and ``passages``.

    A line's candidates are the templates whose size fits: with n and m distinct bigrams, Dice >= t
    needs m * t / (2 - t) <= n <= m * (2 - t) / t.  The best template wins, then the first in order of
    id; hits below the threshold are left out.  Null and empty texts: one line, no hits.  Lines of
    fewer than two words have no bigrams.  Repeated rows are scanned alike; input columns called
    ``n_lines``, ``hits`` or ``passages`` are replaced.  Row by row, without any exchange.

    ``passages``, array of (line, last_line, license, dice) in order of place, sees notices that are
    wrapped or stand within longer text: every window of the whole text's words, across line breaks,
    of up to m * (2 - t) / t bigrams is compared.  Of windows that share words the one with the highest
    Dice stays, then the first, the longest, the first template.  A text is searched only if it has an
    anchor word, and only from and to bigrams of the template, which loses no window.
    """
    templates = sorted(templates)
    if not 0 < len(templates) <= MOST_TEMPLATES:
        raise ValueError(f"1 to {MOST_TEMPLATES} templates")
    if not any(bigrams(text) for _, text in templates):
        raise ValueError("a template of two words or more is needed")
    known = [(name, g) for name, text in templates if (g := bigrams(text))]
    worded = [(name, text) for name, text in templates if bigrams(text)]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    anchors = F.array(*map(F.lit, _anchors(templates, threshold)))
    least = math.ceil(min(len(g) for _, g in known) * low - 1e-9)

    def best(grams: Column) -> Column:
        n = F.size(grams)
        tried = [
            F.when(n.between(math.ceil(len(g) * low - 1e-9), math.floor(len(g) * high + 1e-9)), 2.0 * F.size(F.array_intersect(grams, F.array(*map(F.lit, g)))) / (n + len(g))).otherwise(0.0)
            for _, g in known
        ]
        found = F.array(*[F.struct(d.alias("dice"), F.lit(-i).alias("at"), F.lit(name).alias("license")) for i, (d, (name, _)) in enumerate(zip(tried, known, strict=True))])
        return F.array_max(found)

    out = [c for c in docs.columns if c not in ("n_lines", "hits", "passages")]
    lines = lines_of(F.col(text_col))
    cut = F.transform(lines, lambda x, i: F.struct(i.alias("line"), _words(x).alias("words")))
    likely = F.filter(cut, lambda x: (F.size(x["words"]) > least) & F.arrays_overlap(x["words"], anchors))
    scored = F.transform(likely, lambda x: F.struct(x["line"].alias("line"), best(_bigrams(x["words"])).alias("best")))

    def placed(cut: Column) -> Column:
        def lined(found: Column) -> Column:
            at = F.flatten(F.transform(cut, lambda x: F.array_repeat(x["line"], F.size(x["words"]))))
            told = _let(at, lambda at: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.element_at(at, x["start"]).alias("line"), F.element_at(at, x["end"] + 1).alias("last_line"), x["license"].alias("license"), x["dice"].alias("dice"))))
            sorted_ = F.transform(F.array_sort(told), lambda x: F.struct(*[x[k].alias(k) for k in ("line", "last_line", "license", "dice")]))
            return F.when(F.size(found) > 0, sorted_).otherwise(F.array().cast("array<struct<line:int,last_line:int,license:string,dice:double>>"))

        words = F.flatten(F.transform(cut, lambda x: x["words"]))
        return _let(words, lambda w: _let(_passages(w, worded, threshold), lined))

    kept = F.transform(F.filter(scored, lambda x: x["best"]["dice"] >= threshold), lambda x: F.struct(x["line"].alias("line"), x["best"]["license"].alias("license"), x["best"]["dice"].alias("dice")))
    return docs.select(*out, F.size(lines).cast("long").alias("n_lines"), kept.alias("hits"), _let(cut, placed).alias("passages"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence lines of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = scan(docs)
    return done.select(
        "doc_id", "n_lines", F.size("hits").cast("long").alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",").alias("licenses"),
        F.coalesce(F.round(F.array_max(F.transform("hits", lambda h: h["dice"])), 6), F.lit(0.0)).alias("best_dice"),
    )


def op5_license_passages(spark, sf_dir: str) -> DataFrame:
    """Notices wherever they stand; ``op5_license_scan`` keeps to whole lines, as its SQL does."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_lines", F.size("passages").cast("long").alias("n_passages"), "passages")


def _sql() -> str:
    rows = ", ".join("(%d, '%s', [%s])" % (i, name, ", ".join(f"'{g}'" for g in bigrams(text))) for i, (name, text) in enumerate(sorted(TEMPLATES)))
    return f"""
WITH t(tid, license, tg) AS (VALUES {rows}),
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
w AS (SELECT doc_id, pos, list_filter(string_split(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
      FROM l),
g AS (SELECT doc_id, pos, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gs FROM w),
s AS (SELECT doc_id, pos, tid, license, 2.0 * len(list_intersect(gs, tg)) / (len(gs) + len(tg)) AS dice FROM g, t WHERE len(gs) > 0),
b AS (SELECT doc_id, pos, first(license ORDER BY dice DESC, tid) AS license, max(dice) AS dice FROM s GROUP BY doc_id, pos HAVING max(dice) >= 0.8),
h AS (SELECT doc_id, count(*) AS n_hits, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, round(max(dice), 6) AS best_dice FROM b GROUP BY doc_id)
SELECT d.doc_id, len(ls) AS n_lines, coalesce(n_hits, 0) AS n_hits, coalesce(licenses, '') AS licenses, CAST(coalesce(best_dice, 0.0) AS DOUBLE) AS best_dice
FROM d LEFT JOIN h USING (doc_id)
"""


OP5_SQL = _sql()
