"""License scan: an exact set-similarity join of text blocks with license templates.

A template of n words meets every window of ceil(``slack`` * n) consecutive words of a text, at every start. A window
matches when it holds at least ``threshold`` of the template's distinct words. The join orders words by their number of
documents in the whole table, rarest first (ties by the word), and

* prefix filter: a match holds one of the first |T| - need + 1 words of the template, need = ceil(threshold * |T|), so only
  the neighbourhoods of those words are looked at;
* length filter: a neighbourhood needs ``need`` words at least;
* positional filter: with the first common word at place i of the template, at most |T| - i words of the template and as many
  words of the neighbourhood as do not come before that word in the order can be common.

What passes is verified exactly, by one sweep over the places of the template's words. Windows that start between such
places hold no more than the window of the next place. The templates are a parameter table of bounded size
(``max_template_words``); documents never meet each other, so there is one pass for the word counts and one for the join,
with no shuffle of text.

Defined results: null text is empty; texts without words have no places, no labels and score 0; repeated rows are
each scanned; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyops.llm.common import texts
from skyops.llm.words import ALNUM_TABLE

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short license statements and the opening sentences of well-known licenses, by label.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "copyright all rights reserved"),
]

#: a window has so many times the words of its template
SLACK = 1.5


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


def document_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each word of a bounded vocabulary, over all documents."""

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text"):
                seen.update(vocabulary.intersection(words_of(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                             names=["word", "n"])

    rows = texts(docs).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}


def matching_stretches(ids: list[int], lo: int, hi: int, own: frozenset[int], need: int, width: int) -> list[list[int]]:
    """[first word, end word, most distinct words of ``own`` in one window] of each stretch of words lo ... hi - 1 that
    overlapping windows of ``width`` words with at least ``need`` distinct words of ``own`` cover, from word to word of ``own``."""
    at = [i for i in range(lo, hi) if ids[i] in own]
    held: Counter = Counter()
    out, b = [], 0
    for a, first in enumerate(at):
        while b < len(at) and at[b] < first + width:
            held[ids[at[b]]] += 1
            b += 1
        if len(held) >= need:
            if out and first < out[-1][1]:
                out[-1] = [out[-1][0], at[b - 1] + 1, max(out[-1][2], len(held))]
            else:
                out.append([first, at[b - 1] + 1, len(held)])
        held[ids[first]] -= 1
        if not held[ids[first]]:
            del held[ids[first]]
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                  threshold: float = 0.9, slack: float = SLACK, max_template_words: int = 200_000) -> DataFrame:
    """Per document: doc_id, n_words, places (start and label of each phrase), matches (label, number of the template, first
    and end word of each stretch of matching windows, and its best containment; by template, then by first word)."""
    split = [(label, words_of(t.encode())) for label, t in templates]
    if sum(len(t) for _, t in split) > max_template_words:
        raise ValueError(f"the templates have more than {max_template_words} words")
    vocabulary = frozenset(w for _, t in split for w in t)
    df = document_frequency(docs, vocabulary) if vocabulary else {}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (df.get(w, 0), w)))}
    ordered = [sorted({rank[w] for w in t}) for _, t in split]
    sets = [frozenset(t) for t in ordered]
    needs = [ceil(threshold * len(t) - 1e-9) for t in sets]
    widths = [ceil(slack * len(t) - 1e-9) for _, t in split]
    index: dict[int, list[tuple[int, int]]] = {}  # prefix word -> (template, place in its order)
    for k, t in enumerate(ordered):
        for place, w in enumerate(t[: len(t) - needs[k] + 1]):
            index.setdefault(w, []).append((k, place))
    prefix = frozenset(w for w in vocabulary if rank[w] in index)
    needles = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def neighbourhoods(spots: list[tuple[int, int]], width: int, n: int) -> list[list[int]]:
        """[first, end, least place] of the merged surroundings of the prefix words at ``spots`` (ascending)."""
        out: list[list[int]] = []
        for i, place in spots:
            lo, hi = max(0, i - width + 1), min(n, i + width)
            if out and lo < out[-1][1]:
                out[-1] = [out[-1][0], hi, min(place, out[-1][2])]
            else:
                out.append([lo, hi, place])
        return out

    def matches(words: list[bytes]) -> list[dict]:
        out: list[dict] = []
        if prefix.isdisjoint(words):
            return out
        ids = [rank.get(w, -1) for w in words]
        spots: dict[int, list[tuple[int, int]]] = {}
        for i, w in enumerate(ids):
            for k, place in index.get(w, ()):
                spots.setdefault(k, []).append((i, place))
        for k in sorted(spots):
            t, need = ordered[k], needs[k]
            for lo, hi, place in neighbourhoods(spots[k], widths[k], len(ids)):
                if hi - lo < need or min(len(t) - place, sum(w >= t[place] for w in ids[lo:hi])) < need:
                    continue
                out += [{"label": split[k][0], "template": k, "first": first, "end": end, "containment": n / len(t)}
                        for first, end, n in matching_stretches(ids, lo, hi, sets[k], need, widths[k])]
        return out

    def scan(batches):
        for batch in batches:
            n, places, found = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                n.append(len(words))
                joined = b" " + b" ".join(words) + b" "
                at = []
                for needle, label in needles:
                    i, word, seen = joined.find(needle), 0, 0
                    while i >= 0:
                        word, seen = word + joined.count(b" ", seen, i), i
                        at.append({"word": word, "label": label})
                        i = joined.find(needle, i + 1)
                places.append(at)
                found.append(matches(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()),
                 pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                 pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("template", pa.int64()), ("first", pa.int64()), ("end", pa.int64()),
                                                     ("containment", pa.float64())])))],
                names=["doc_id", "n_words", "places", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(scan, f"doc_id {kind}, n_words bigint, places array<struct<word:bigint,label:string>>, "
                                        "matches array<struct<label:string,template:bigint,first:bigint,end:bigint,containment:double>>")
