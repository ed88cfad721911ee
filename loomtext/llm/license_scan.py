"""License scans by a positional index of licences' rare words.

A template is a licence's notice as words, with key phrases that must stand in it.
It is found at a place where all its key phrases stand word for word, as far from each
other as in the template, and at least ``least`` percent of its words agree.  Words
between key phrases may differ.

``frequencies`` counts, over all documents, in how many of them each licence word
stands.  By these counts ``Index`` orders a template's key words from the rarest on and
keeps the places of the first ``RARE`` of them.  A file's licence words are looked up
from the rarest on: only those that are some template's rarest lead to templates, the
places of further rare words, less their place in the template, are intersected with
those of the first, and at what is left key phrases are verified.  A template that is
found has all its key words there, so nothing is lost; the counts decide speed only.

Texts are read whole, A-Z lower-cased; words are runs of characters other than
``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  A null or empty text has no words and no
matches.  Repeated rows stay repeated, null ids stay null, other columns are ignored,
an empty table gives an empty one.  Rows are scanned where they lie, without a shuffle;
a text must fit a worker several times over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, lowered, texts, tokens

#: Words of a template that its places are narrowed down by before key phrases are verified.
RARE = 3
#: Percent of a template's words that must agree.
LEAST = 50
#: The score of a phrase of ``BASE`` that stands in no template's words.
BARE = 0.5
CHARS = lowered(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


@dataclass(frozen=True)
class Template:
    """A notice (words in lower case), the label that it gives, and the phrases it cannot do without."""

    label: str
    text: str
    keys: Sequence[str] = field(default=())
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def spans(self) -> list[tuple[int, int]]:
        """First and last but one place of each key phrase's first occurrence; the whole text if there is none."""
        out, own = [], self.words
        for key in self.keys or [self.text]:
            k = key.split()
            at = next((i for i in range(len(own) - len(k) + 1) if own[i : i + len(k)] == k), None)
            if at is None or not k:
                raise ValueError(f"not a phrase of the template: {key!r}")
            out.append((at, at + len(k)))
        return out


#: Phrases that give a label wherever they stand.
BASE = [Template("gpl", "gnu general public license", base=True), Template("apache", "apache license", base=True), Template("cc-by", "cc by", base=True), Template("mit", "mit license", base=True)]

#: Usual notices of public licences.
NOTICES = [
    Template("mit", "released under the mit license", ["the mit license"]),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    Template("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license", "obtain a copy of the license"]),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["you can redistribute it and or modify it", "gnu general public license as published by"]),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee is hereby granted"]),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    Template("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    Template("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0 universal"]),
]

FOUND = "array<struct<template:int,label:string,base:boolean,start:bigint,words:int,matched:int>>"


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def _coded(batch: pa.RecordBatch, words: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, texts as codes) of slices of a batch: a licence word is its place in ``words``, any other word -1."""
    known = pa.array([b"\n", *(w.encode() for w in words)], pa.large_binary())
    for start, held in texts(batch, "text"):
        codes = pc.fill_null(pc.index_in(tokens(b"\n".join(t.translate(CHARS) for t in held)), value_set=known), -1).to_numpy()
        ends = np.append(np.flatnonzero(codes == 0), len(codes))
        codes = np.where(codes > 0, codes - 1, -1)
        yield start, [codes[a + 1 : b] for a, b in zip(np.append(-1, ends[:-1]), ends, strict=True)]


def frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many of ``docs`` each of ``words`` stands: a task sends at most a row for each word, and so does the sum of them."""

    def count(it):
        seen = np.zeros(len(words), np.int64)
        for batch in it:
            for _, held in _coded(batch, words):
                for codes in held:
                    seen[np.unique(codes[codes >= 0])] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in at], pa.string()), pa.array(seen[at])], ["word", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lean(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(words, 0) | {r["word"]: r["n"] for r in rows.collect()}


class Index:
    """Templates by their rarest words: it grows with the templates alone."""

    def __init__(self, templates: Sequence[Template], frequency: dict[str, int]):
        self.templates = list(templates)
        self.words = vocabulary(templates)
        code = {w: i for i, w in enumerate(self.words)}
        self.texts = [np.array([code[w] for w in t.words]) for t in self.templates]
        self.spans = [t.spans() for t in self.templates]
        self.rare: list[list[tuple[int, int]]] = []  # (code, place), the rarest first
        self.by_rarest: dict[int, list[int]] = {}
        for i, (t, spans) in enumerate(zip(self.templates, self.spans, strict=True)):
            places: dict[int, int] = {}
            for a, b in spans:
                for p in range(a, b):
                    places.setdefault(code[t.words[p]], p)
            order = sorted(places.items(), key=lambda x: (frequency.get(self.words[x[0]], 0), x))
            self.rare.append(order[:RARE])
            self.by_rarest.setdefault(order[0][0], []).append(i)
        self.leads = np.zeros(len(self.words) + 1, bool)  # the last for -1
        self.leads[list(self.by_rarest)] = True

    def find(self, codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
        """(template, start, words that agree) of each place where a template is found."""
        if not self.leads[codes].any():
            return []
        at = np.flatnonzero(codes >= 0)
        order = np.argsort(codes[at], kind="stable")
        at, own = at[order], codes[at][order]
        where = lambda c: at[np.searchsorted(own, c) : np.searchsorted(own, c, "right")]
        out = []
        for lead in np.unique(own[self.leads[own]]).tolist():
            for i in self.by_rarest[lead]:
                starts = where(lead) - self.rare[i][0][1]
                for c, place in self.rare[i][1:]:
                    if not len(starts):
                        break
                    starts = np.intersect1d(starts, where(c) - place, assume_unique=True)
                text = self.texts[i]
                for a, b in self.spans[i]:
                    starts = starts[(starts + a >= 0) & (starts + b <= len(codes))]
                    starts = starts[(codes[starts[:, None] + np.arange(a, b)] == text[a:b]).all(1)] if len(starts) else starts
                if len(starts):
                    places = starts[:, None] + np.arange(len(text))
                    inside = (places >= 0) & (places < len(codes))
                    agree = ((codes[np.clip(places, 0, len(codes) - 1)] == text) & inside).sum(1)
                    good = 100 * agree >= least * len(text)
                    out += [(i, int(s), int(n)) for s, n in zip(starts[good], agree[good], strict=True)]
        return sorted(out)


def scan(docs: DataFrame, templates: Sequence[Template] = (*BASE, *NOTICES), id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words and found, an array of (template, label, base, start, words, matched), for each row of ``docs``.

    ``template`` is the place in ``templates``; ``start`` may be negative where a text begins within a notice.
    """
    words = vocabulary(templates)
    held = docs.sparkSession.sparkContext.broadcast(Index(templates, frequencies(docs, words, text_col)))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(it):
        index = held.value
        kind = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int32()), ("matched", pa.int32())]))
        of = [(t.label, t.base, len(t.words)) for t in index.templates]
        for batch in it:
            sizes, found = [], []
            for _, own in _coded(batch, index.words):
                for codes in own:
                    sizes.append(len(codes))
                    found.append([dict(zip(("template", "label", "base", "start", "words", "matched"), (i, of[i][0], of[i][1], s, of[i][2], n), strict=True)) for i, s, n in index.find(codes, least)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "found"])

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, found {FOUND}")


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """A row for each row of ``scan``: its base phrases, its labels, and a score.

    The score is the largest share of a notice's words that agree; where there is only a base
    phrase ``BARE``, where there is nothing 0.
    """
    base = F.filter("found", lambda m: m["base"])
    best = F.array_max(F.transform(F.filter("found", lambda m: ~m["base"]), lambda m: m["matched"] / m["words"]))
    score = F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size(base) > 0, BARE).otherwise(0.0))
    starts = F.transform(base, lambda m: m["start"])
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), _labels(base).alias("base_labels"), _labels(F.col("found")).alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(documents(spark, sf_dir)))


def _oracle(templates: Sequence[Template]) -> str:
    rows = []
    for i, t in enumerate(templates):
        key = {p for a, b in t.spans() for p in range(a, b)}
        rows += [f"({i}, '{t.label}', {t.base}, {p}, '{w}', {p in key}, {len(t.words)}, {len(key)})" for p, w in enumerate(t.words)]
    return rf"""
WITH t(template, label, base, place, word, is_key, size, n_keys) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT rid, generate_subscripts(ws, 1) - 1 AS spot, unnest(ws) AS word FROM d),
m AS (SELECT rid, template, any_value(label) AS label, any_value(base) AS base, spot - place AS start, count(*) AS matched, any_value(size) AS size FROM w JOIN t USING (word) GROUP BY rid, template, spot - place HAVING count(*) FILTER (is_key) = any_value(n_keys) AND 100 * count(*) >= {LEAST} * any_value(size)),
g AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(CASE WHEN base THEN {BARE} ELSE matched / size END) AS score FROM m GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN g USING (rid)
"""


ORACLE = _oracle([*BASE, *NOTICES])
