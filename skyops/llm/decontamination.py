"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items (bounded, see ``max_chars``) goes to every task. Each document's
words stream through it; the state holds the longest suffix of the words read so far that occurs in some item.
Where that match has at least ``window`` words (or is a whole shorter item), its words are hit.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined results: null or empty text and text without words give no words and no hits; items without words, and
rows of items whose id or text is null, are ignored; repeated items or documents count as they stand (an item id
once per document); an empty item table leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyops.llm.common import small_batches, texts
from skyops.llm.words import ALNUM_TABLE

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """All substrings of several word sequences; per state the items in which its substrings occur."""

    def __init__(self, sequences: Iterable[tuple[str, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.next, self.link, self.length, self.items, self.whole = [{}], [-1], [0], [set()], [()]
        own: list[tuple[str, list[int]]] = []
        for item, words in sequences:
            if words:
                own.append((item, [self.ids.setdefault(w, len(self.ids)) for w in words]))
        for _, seq in own:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        for item, seq in own:
            at = 0
            for c in seq:
                at = up = self.next[at][c]
                while up > 0 and item not in self.items[up]:
                    self.items[up].add(item)
                    up = self.link[up]
            if len(seq) < window:
                self.whole[at] = self.whole[at] + ((len(seq), item),)
        self.shortest = min((min(len(s), window) for _, s in own), default=0)
        self.short = any(self.whole)

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.whole.append(())
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # the sequence so far already occurs in an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """(end, length, items) wherever the longest match ending at a word holds a window; ids -1: unknown words."""
        known = np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(known))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:  # no window fits between unknown words
                continue
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if (q := self.next[state].get(c)) is not None:
                    state, length = q, length + 1
                if length >= self.window:
                    u = state
                    while self.length[self.link[u]] >= self.window:
                        u = self.link[u]
                    yield i + 1, length, self.items[u]
                if self.short and length:
                    u = state
                    while u > 0:
                        for n, item in self.whole[u]:
                            if n <= length:
                                yield i + 1, n, {item}
                        u = self.link[u]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


def automaton_of(items: DataFrame, window: int = 10, max_chars: int = 50_000_000) -> SuffixAutomaton:
    """The automaton of ``items`` (item_id, text); raises beyond ``max_chars`` characters in all items."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).dropna()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > max_chars:
        raise ValueError(f"the items have {size} characters; the bound of the automaton is {max_chars}")
    return SuffixAutomaton(((r.item, words_of(r.text.encode())) for r in rows.orderBy("item", "text").collect()), window)


SPANS = "array<struct<first:bigint,end:bigint,char_first:bigint,char_end:bigint>>"


def hit_runs(automaton: SuffixAutomaton, raw: bytes) -> tuple[int, list[list[int]], set[str]]:
    """Number of words, the disjoint runs of hit words (first, end), and the items found in a text."""
    words = words_of(raw)
    ids = np.fromiter(map(automaton.ids.get, words, repeat(-1)), np.int64, len(words))
    runs: list[list[int]] = []
    found: set[str] = set()
    for end, length, items in automaton.matches(ids):
        found |= items
        first = end - length
        while runs and runs[-1][0] >= first:
            runs.pop()
        if runs and runs[-1][1] >= first:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([first, end])
    return len(words), runs, found


def in_chars(raw: bytes, runs: list[list[int]]) -> list[tuple[int, int]]:
    """Runs of words as (first, end) characters of the text."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(raw.translate(ALNUM_TABLE))]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[at[a][0]]), int(chars[at[b - 1][1]])) for a, b in runs]


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids as strings, sorted), spans (hit runs: words from ``first``
    to before ``end``, and the same in characters of the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton_of(items, window))
    span = pa.struct([(k, pa.int64()) for k in ("first", "end", "char_first", "char_end")])

    def scan(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n, runs, found = hit_runs(shared.value, raw := text.as_py())
                rows.append((n, sum(b - a for a, b in runs), sorted(found),
                             [{"first": a, "end": b, "char_first": c, "char_end": d}
                              for (a, b), (c, d) in zip(runs, in_chars(raw, runs), strict=True)]))
            n, hit, found, spans = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()),
                 pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(span))],
                names=["doc_id", "n_words", "n_hit", "items", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(scan, f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, spans {SPANS}")


def as_bytes(column: pa.Array) -> pa.Array:
    """A string column as it stands, its bytes unchecked."""
    return column.view(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without contaminated spans: hit runs are cut out of the text (``n_chars``, if there, is counted anew);
    a document whose hit words are more than ``max_coverage`` of its words goes as a whole. Clean rows and all other
    columns stay as they are, null texts included. In a text that is cut, bytes that are not UTF-8 become U+FFFD."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton_of(items, window))
    at = docs.columns.index("text")
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches):
        for batch in batches:
            keep, changed, counts = [], {}, {}
            held = as_bytes(batch.column(at))
            for i, value in enumerate(held):
                raw = value.as_py() or b""
                text = raw.decode(errors="replace")
                raw = text.encode()
                n, runs, _ = hit_runs(shared.value, raw)
                keep.append(sum(b - a for a, b in runs) <= max_coverage * n)
                if runs and keep[-1]:
                    pieces, last = [], 0
                    for first, end in in_chars(raw, runs):
                        pieces.append(text[last:first])
                        last = end
                    body = "".join(pieces) + text[last:]
                    changed[i], counts[i] = body.encode(), len(body)
            columns = batch.columns
            if changed:
                columns[at] = pa.array([changed.get(i, v) for i, v in enumerate(held.to_pylist())], held.type).view(columns[at].type)
                if count_at is not None:
                    columns[count_at] = pa.array([counts.get(i, v) for i, v in enumerate(columns[count_at].to_pylist())], columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(cut, docs.schema)
