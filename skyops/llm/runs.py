"""Periodic runs of words, found by descending-LCP Kruskal.

A run is a stretch of words with smallest period q (words q apart are identical) and length >= max(``min_length``, 2q) that no neighbouring
word extends keeping period q. Two suffixes of a text are joined at their longest common prefix (LCP). Classes of suffixes start as single
positions; the neighbours in suffix order are united by decreasing LCP, with a union-find whose sets hold their positions in order.
When two sets meet at LCP l, positions i and i + p that become neighbours in the united set with p <= l seed a run: the words from i to
i + p + l have period p, and the LCP cannot be longer. Why these are all runs, each once, after dropping the seeds that the word before i extends:

* a run (start s, period q, length n) makes s and s + q share an LCP of n - q >= q, and nothing between them shares as much with s, or the
  stretch would have a smaller period (Fine and Wilf); so they are neighbours when their sets meet;
* if a seed's stretch had a smaller period, that period's divisor g of p would put i + g into the set of i earlier, between i and i + p.

Seeds need p + l >= ``min_length`` and l >= p, so l >= ceil(min_length / 2): only texts in which so many words stand twice, and in them only neighbours
that share so many, take part. Suffix order and LCPs come from prefix doubling over these texts; any order of the words does, so they are
compared by their 64-bit hashes (two different words agree with probability 2^-64). A task handles slices of about 1 MB of text (a longer text
alone, whole); nothing is shuffled.

Defined results: null, empty and blank texts have no words and no runs; equal rows give equal results, row by row; null doc_ids stay; an empty table
gives an empty table; other columns are ignored. Words are runs of bytes, so text that is not valid UTF-8 is handled byte by byte.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyops.llm.common import slices, texts
from skyops.llm.words import NOT_SPACE, grams, hash_spans, mix, spans

#: a run as the operator returns it
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _suffix_order(word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Prefix doubling: all positions, text by text in suffix order, and for 1, 2, 4 ... words the classes of positions that share so many
    (numbered by where they begin in that order)."""
    n = len(word)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    end = off[text + 1]
    place, at = np.zeros(n, np.int32), np.arange(n)
    by = np.lexsort((word, text))
    new = np.concatenate([[True], (word[by][1:] != word[by][:-1]) | (text[by][1:] != text[by][:-1])])
    place[by] = np.maximum.accumulate(np.where(new, at, 0))
    size = np.diff(np.append(np.flatnonzero(new), n))
    tied, levels, step = by[np.repeat(size > 1, size)], [place], 1
    while len(tied):
        ahead = tied + step
        follow = np.where(ahead < end[tied], place[np.minimum(ahead, n - 1)], -1)  # a shorter text comes first
        by = np.lexsort((follow, place[tied]))
        tied, follow = tied[by], follow[by]
        own, at = place[tied], np.arange(len(tied))
        new_own = np.concatenate([[True], own[1:] != own[:-1]])
        new = new_own | np.concatenate([[True], follow[1:] != follow[:-1]])
        place = place.copy()
        place[tied] = own + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_own, at, 0))
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        levels.append(place)
        step *= 2
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    return order, levels


def _lcp(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Words that positions ``a`` and ``b`` of the same text share, ``end`` being that text's end."""
    total, last = np.zeros(len(a), np.int64), len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + total, b + total
        same = (x < end) & (y < end) & (levels[k][np.minimum(x, last)] == levels[k][np.minimum(y, last)])
        total[same] += 1 << k
    return total


def _unite(order: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """Kruskal over neighbours in suffix order (``lcp[k]`` is that of order[k] and order[k + 1], 0 if they share too little): (i, p, l) of positions
    i and i + p that become neighbours at LCP l >= p."""
    seeds: list[tuple[int, int, int]] = []
    joined = np.append(lcp > 0, False)
    kept = np.flatnonzero(joined | np.roll(joined, 1))  # the others stay alone
    order, lcp = order[kept], np.append(lcp, 0)[kept]
    joins = np.flatnonzero(lcp)
    joins = joins[np.argsort(-lcp[joins], kind="stable")]
    parent = list(range(len(order)))
    held: list[list[int]] = [[p] for p in order.tolist()]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, l in zip(joins.tolist(), lcp[joins].tolist(), strict=True):
        x, y = root(k), root(k + 1)
        if len(held[x]) < len(held[y]):
            x, y = y, x
        large, small = held[x], held[y]
        parent[y], held[y] = x, []
        at, n, places = 0, len(large), []
        for t, p in enumerate(small):
            at = bisect_left(large, p, at)
            places.append(at)
            if at and p - large[at - 1] <= l and (t == 0 or small[t - 1] < large[at - 1]):
                seeds.append((large[at - 1], p - large[at - 1], l))
            if at < n and large[at] - p <= l and (t + 1 == len(small) or large[at] < small[t + 1]):
                seeds.append((p, large[at] - p, l))
        if len(small) > 16:
            large += small
            large.sort()
        else:
            for at, p in zip(reversed(places), reversed(small), strict=True):
                large.insert(at, p)
    return seeds


def _repeating(word: np.ndarray, off: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in which some ``shared`` words stand twice: their numbers, their words and the offsets into these."""
    gram, gram_off = grams(word, off, shared)
    of = np.repeat(np.arange(len(off) - 1), np.diff(gram_off))
    gram = mix(gram ^ mix(of.astype(np.uint64)))
    by = np.argsort(gram, kind="stable")
    twice = by[1:][gram[by[1:]] == gram[by[:-1]]]
    chosen = np.unique(of[twice])
    size = np.diff(off)[chosen]
    new = np.concatenate([[0], np.cumsum(size)])
    return chosen, word[np.repeat(off[chosen] - new[:-1], size) + np.arange(new[-1])], new


def text_runs(word: np.ndarray, off: np.ndarray, min_length: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the texts of a slice, from the words' hashes and the texts' offsets into them: text, start (word of the text), length and
    period, in order of text, start and period."""
    shared = (min_length + 1) // 2
    texts_of, word, off = _repeating(word, off, shared)
    if not len(texts_of):
        return (np.zeros(0, np.int64),) * 4
    order, levels = _suffix_order(word, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    a, b = order[:-1], order[1:]
    lcp = np.where(text[a] == text[b], _lcp(a, b, levels, off[text[a] + 1]), 0)
    i, p, l = np.array(_unite(order, np.where(lcp >= shared, lcp, 0)), np.int64).reshape(-1, 3).T
    whole = (p + l >= min_length) & ((i == off[text[i]]) | (word[i - 1] != word[i + p - 1]))
    i, p, l = i[whole], p[whole], l[whole]
    by = np.lexsort((p, i))
    i, p, l = i[by], p[by], l[by]
    return texts_of[text[i]], i - off[text[i]], p + l, p


def find_runs(docs: DataFrame, min_length: int = 12, collapse: bool = True) -> DataFrame:
    """Rows: doc_id, n_words, runs (start in words from 0, length, period; by start and period), and, if ``collapse``, collapsed: the text's words
    joined by one space without those that any run contains after that run's first period."""

    def run(batches):
        for batch in batches:
            for i, j, data, off in slices(batch.column("text")):
                starts, ends, words = spans(data, off, NOT_SPACE)
                text, start, length, period = text_runs(hash_spans(data, starts, ends, fold=False), words, min_length)
                per_text = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=j - i))])
                runs = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"]))
                out = [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(words), pa.int64()), runs]
                if collapse:
                    dropped = np.zeros(len(starts) + 1, np.int64)
                    np.add.at(dropped, words[text] + start + period, 1)
                    np.add.at(dropped, words[text] + start + length, -1)
                    keep = np.cumsum(dropped)[:-1] == 0
                    bodies = []
                    raw = data.tobytes()
                    for k in range(j - i):
                        kept = raw[off[k]: off[k + 1]].split()
                        if per_text[k] < per_text[k + 1]:
                            kept = [w for w, stays in zip(kept, keep[words[k]: words[k + 1]].tolist(), strict=True) if stays]
                        bodies.append(b" ".join(kept))
                    out.append(pa.array(bodies, pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "runs", *["collapsed"] * collapse])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts(docs).mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUN}" + ", collapsed binary" * collapse)
    return found.withColumn("collapsed", found.collapsed.cast("string")) if collapse else found
