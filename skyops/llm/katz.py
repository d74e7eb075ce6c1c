"""Katz backoff language model: counts, Good-Turing discounts, exactly normalised backoff weights, and scores of whole texts.

Tokens are words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; 64-bit hashes stand for them) and one end per text. Symbols of the model are all
words seen twice or more in training (a caller can ask for the most frequent ``max_vocabulary`` only), the end, and one class of all other words.
The chain is

* with ``order`` 3, triple seen in training: discount(c) * c(g, h, w) / D(g, h); else alpha(g, h) times what follows (a history (g, h) that training
  has not has an alpha of 1, and a text's first token has the start alone before it, so the pair tells its probability);
* bigram seen in training: discount(c) * c(h, w) / D(h);
* else alpha(h) * p(w), with p(w) = (c(w) + 0.5) / (N + 0.5 K) over the K symbols;
* a word of the class: times (c(word) + 0.5) / (N' + 0.5 (V' + 1)), N' and V' being tokens and words of the class in training.

Every step sums to one: alpha(h) is the mass that the discounts leave over that of the symbols never seen after h. Good-Turing discounts apply to
counts up to 5 (where the counts of counts give no discount between 0 and 1, (c - 0.5) / c), pairs and triples each by their own counts of counts; a
history without discounted followers has D(h) = c(h) + 1, so mass is left; a history followed by every symbol is not discounted at all.

Word counts are one table, pair counts another. The most frequent words (``max_shared`` of them, some 40 bytes a word) are broadcast with their ids
and backoff weights, which only decides where a symbol is looked up. All other symbols are numbered by falling count, so an id tells its count by a
short table. :func:`encode` reads each text once: a block of texts sends its distinct other words to the buckets of their hashes, gets ids (or the counts of
the class's words) back, and is kept as packed ids. Pairs of a broadcast history are dealt by the pair's hash, pairs of another history by the
history's, so the bucket that holds them works out its D and alpha. Tasks add up their pairs before the shuffle and send them packed, one row for
a bucket and a block, so a frequent pair or word is one entry per block. Scoring looks the most frequent pairs up where the block is read
(``max_frequent`` of them, broadcast) and sends each block's other pairs to their buckets, with the documents they stand in; one sum comes back for each
document that a bucket touched, so what is shuffled is bounded by the tokens whatever the number of buckets.

Triples are counted in the bucket of their last two symbols, which thus has the counts of its pairs too. From there they go to the buckets of their
histories (those of the ``max_histories`` most frequent pairs, whose alpha and D are broadcast, by the triple's hash), with the counts that tell the
pairs' probabilities, so that a bucket works out alpha and D of its histories. Blocks send their triples there, but for the ``max_triples`` most
frequent, which are broadcast; what a bucket has not seen goes on to the bucket of its last pair, with the documents of all blocks in one row.

Defined results: null and empty texts are the end alone; repeated rows count and score as they stand; a null doc_id is not held out by
callers' rules; without training texts c = N = V = 0 and pairs are unseen; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyops.llm.common import slices, stage, texts
from skyops.llm.words import mix, word_hashes

U = np.uint64
#: counts up to this one are discounted
K_DISCOUNT = 5
#: ids of symbols have so many bits
ID_BITS = 31
MASK = (1 << ID_BITS) - 1
#: tokens that a task packs at once
BLOCK_TOKENS = 2_000_000
#: packed integers of so many bytes or more are compressed
COMPRESSED = 256


def pack(values: np.ndarray) -> bytes:
    """Nonnegative integers in as few whole bytes each as the largest needs, all lowest bytes first; the first byte is that width, then come their
    number if they are compressed (8 is added to the width), and the bytes."""
    values = values.astype("<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    if len(raw) < COMPRESSED:
        return bytes([width]) + raw
    return bytes([width + 8]) + len(values).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: memoryview | bytes) -> np.ndarray:
    width = data[0]
    if width > 8:
        width -= 8
        raw = np.frombuffer(pa.decompress(memoryview(data)[9:], width * int.from_bytes(memoryview(data)[1:9], "little"), "zstd"), np.uint8)
    else:
        raw = np.frombuffer(data, np.uint8, offset=1)
    raw = raw.reshape(width, -1).T
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel().astype(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_sorted(data: memoryview | bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def pack_histories(keys: np.ndarray) -> bytes:
    """Sorted pair keys, their first and second symbols apart."""
    step, then = np.diff(keys >> ID_BITS, prepend=0), keys & MASK
    first = pack(step)
    return len(first).to_bytes(8, "little") + first + pack(np.where(step > 0, then, np.diff(then, prepend=0)))


def unpack_histories(data: memoryview | bytes) -> np.ndarray:
    data = memoryview(data)
    size = 8 + int.from_bytes(data[:8], "little")
    step, then = unpack(data[8:size]), unpack(data[size:])
    begin = np.flatnonzero(step > 0)
    if len(begin) and begin[0]:  # keys that begin with symbol 0
        begin = np.append(0, begin)
    run = np.cumsum(then)
    before = np.repeat(run[begin] - then[begin], np.diff(np.append(begin, len(then)))) if len(begin) else 0
    return (np.cumsum(step) << ID_BITS) | (run - before)


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts (or sums of weights)."""
    if weights is None:
        return np.unique(values, return_counts=True)
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(weights, first) if len(values) else weights


class Vocabulary:
    """Ids of the most frequent words' hashes: a sorted array with an index on the hashes' top bits. Ids: words 0 ... n - 1, most frequent first,
    then the end, the class, the start; rarer symbols' ids begin at ``first_rare``."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, counts = hashes[order], counts[order]
        by_count = np.argsort(-counts, kind="stable")
        self.counts, self.rank = counts[by_count], np.empty(len(counts), np.int64)
        self.rank[by_count] = np.arange(len(counts))
        self.bits = max(1, int(len(hashes)).bit_length())
        self.first = np.searchsorted(self.hashes >> U(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U)).astype(np.int32)
        n = len(hashes)
        self.end, self.other, self.start, self.first_rare = n, n + 1, n + 2, n + 3

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids; ``other`` for words that are not here."""
        top = (hashes >> U(64 - self.bits)).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        out = np.full(len(hashes), self.other, np.int64)
        todo = np.flatnonzero(at < stop)
        at, stop = at[todo], stop[todo]
        while len(todo):
            hit = self.hashes[at] == hashes[todo]
            out[todo[hit]] = self.rank[at[hit]]
            at = at + 1
            more = ~hit & (at < stop)
            todo, at, stop = todo[more], at[more], stop[more]
        return out


@dataclass
class Symbols:
    """All symbols' counts: of broadcast words, the end and the class by id, of rarer symbols by the first id of each count."""

    vocabulary: Vocabulary
    counts: np.ndarray
    rare_counts: np.ndarray  # falling
    rare_first: np.ndarray  # first id of each of them
    rare_starts: np.ndarray  # first id of each of them in each bucket of words
    buckets: int  # of words
    least: int  # words of so many occurrences or more are symbols
    size: int  # number of symbols, with the end and the class
    n: int

    def count(self, ids: np.ndarray) -> np.ndarray:
        out = self.counts[np.minimum(ids, len(self.counts) - 1)]
        rare = ids >= self.vocabulary.first_rare
        if rare.any():
            out[rare] = self.rare_counts[np.searchsorted(self.rare_first, ids[rare], "right") - 1]
        return out

    def p(self, ids: np.ndarray) -> np.ndarray:
        return (self.count(ids) + 0.5) / (self.n + 0.5 * self.size)


def backoff(count: np.ndarray, cut: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of alpha and of D, and whether a history is not discounted, from its pairs' count, the mass the discounts leave, and its followers' p."""
    unseen = 1.0 - seen
    whole = (count > 0) & (unseen < 1e-12)  # followed by every symbol
    left = np.where(whole, 0.0, np.where(cut > 0, cut, 1.0))
    d = np.where(count > 0, count + np.where(whole | (cut > 0), 0.0, 1.0), 1.0)
    alpha = np.where(count > 0, left / d / np.where(whole, 1.0, unseen), 1.0)
    return np.log10(np.maximum(alpha, 1e-300)), np.log10(d), whole


@dataclass
class Katz:
    """The fitted model. words: (hash, n) of the words that are not broadcast; encoded: the texts given to ``fit``; pairs: (bucket, keys, counts), packed;
    symbols, shared: the broadcast arrays."""

    words: DataFrame
    encoded: DataFrame
    pairs: DataFrame
    symbols: Broadcast
    shared: Broadcast
    buckets: int
    n: int
    v: int
    frequent: Broadcast  # sorted keys of the most frequent pairs and their counts
    triples: Broadcast | None = None  # with order 3; ``pairs`` has (sizes, before, times) then, the symbols before each pair and their counts


@dataclass
class Arrays:
    """What every scoring task holds."""

    symbols: Symbols
    vocabulary: Vocabulary
    log_p: np.ndarray  # log10 p of broadcast words, end, class
    log_alpha: np.ndarray  # of each broadcast history: words, end, class, start
    log_d: np.ndarray
    whole: np.ndarray  # histories without discount
    factor: np.ndarray  # discount factors of counts 0 ... K_DISCOUNT
    log_count: np.ndarray  # log10 of discounted counts
    n: int
    v: int
    n_other: int
    v_other: int

    def rare_histories(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sorted ids of the rarer histories of a bucket's pairs, with log10 alpha, log10 D and whether they are whole. All their pairs are there."""
        rare = keys >> ID_BITS >= self.vocabulary.first_rare
        ids, at = np.unique(keys[rare] >> ID_BITS, return_inverse=True)
        sums = [np.bincount(at, x, len(ids)) for x in pair_masses(keys[rare], counts[rare], self.factor, self.symbols)]
        return ids, *backoff(*sums)

    def pair_log(self, keys: np.ndarray, counts: np.ndarray, rare: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """log10 probability of each pair key, given its training count (0: unseen); ``rare``: the rarer histories that occur."""
        h, w = keys >> ID_BITS, keys & ((1 << ID_BITS) - 1)
        first = self.vocabulary.first_rare
        log_p = self.log_p[np.minimum(w, len(self.log_p) - 1)]
        if (far := w >= first).any():
            log_p[far] = np.log10(self.symbols.p(w[far]))
        at = np.minimum(h, first - 1)
        log_alpha, log_d, whole = self.log_alpha[at], self.log_d[at], self.whole[at]
        if rare is not None and (far := h >= first).any():
            at = np.searchsorted(rare[0], h[far])
            log_alpha[far], log_d[far], whole[far] = (x[at] for x in rare[1:])
        plain = np.log10(np.maximum(counts, 1))
        low = (counts <= K_DISCOUNT) & ~whole
        seen = np.where(low, self.log_count[np.minimum(counts, K_DISCOUNT)], plain) - log_d
        return np.where(counts > 0, seen, log_alpha + log_p)


    def d_of(self, ids: np.ndarray, rare: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """D of histories, and whether they are whole; ``rare``: the rarer histories that occur."""
        first = self.vocabulary.first_rare
        at = np.minimum(ids, first - 1)
        log_d, whole = self.log_d[at], self.whole[at]
        if (far := ids >= first).any():
            at = np.searchsorted(rare[0], ids[far])
            log_d[far], whole[far] = rare[2][at], rare[3][at]
        return 10.0 ** log_d, whole

    def seen_p(self, counts: np.ndarray, d: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Probability of pairs seen in training."""
        return np.where((counts <= K_DISCOUNT) & ~whole, self.factor[np.minimum(counts, K_DISCOUNT)], 1.0) * counts / d


@dataclass
class Triples:
    """What scoring tasks hold of the triples: discounts, the most frequent histories, and the most frequent triples that begin with them."""

    factor: np.ndarray
    log_count: np.ndarray
    histories: np.ndarray  # sorted pair keys
    log_alpha: np.ndarray
    log_d: np.ndarray
    whole: np.ndarray
    keys: np.ndarray  # sorted; place of the history, then the follower
    log_p: np.ndarray

    def place(self, histories: np.ndarray) -> np.ndarray:
        """Places among the frequent histories; -1 for others."""
        return counts_of(histories, self.histories, np.arange(1, len(self.histories) + 1)) - 1

    def frequent(self, place: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which triples are among the frequent ones, and their log10 probability there."""
        if not len(self.keys):
            return np.zeros(len(place), bool), np.zeros(len(place))
        key = (np.maximum(place, 0) << ID_BITS) | follow
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (place >= 0) & (self.keys[at] == key), self.log_p[at]

    def seen_log(self, counts: np.ndarray, log_d: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """log10 probability of triples seen ``counts`` times."""
        low = (counts <= K_DISCOUNT) & ~whole
        return np.where(low, self.log_count[np.minimum(counts, K_DISCOUNT)], np.log10(np.maximum(counts, 1))) - log_d

    def bucket(self, histories: np.ndarray, place: np.ndarray, follow: np.ndarray, buckets: int, start: int) -> np.ndarray:
        """Buckets of triples: by the history, but by the triple for frequent histories and for first tokens, which have the start twice before them."""
        spread = (place >= 0) | (histories & MASK == start)
        return bucket_of(np.where(spread, histories ^ (follow + 1) * 0x9E3779B97F4A7C1, histories), buckets)


def pair_masses(keys: np.ndarray, counts: np.ndarray, factor: np.ndarray, symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pair: its count, what the discount takes of it, and its follower's p."""
    cut = np.where(counts <= K_DISCOUNT, counts * (1 - factor[np.minimum(counts, K_DISCOUNT)]), 0.0)
    return counts.astype(float), cut, symbols.p(keys & ((1 << ID_BITS) - 1))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.view(U) ^ U(0x2545F4914F6CDD1D)) % U(buckets)).astype(np.int64)


def pair_bucket(keys: np.ndarray, buckets: int, first_rare: int) -> np.ndarray:
    """Buckets of pairs: by the pair for broadcast histories, by the history for rarer ones, which have few pairs each."""
    h = keys >> ID_BITS
    return bucket_of(np.where(h >= first_rare, h, keys), buckets)


def pair_keys(vocabulary: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pair keys of all tokens (words and ends), and each one's document."""
    n = len(off) - 1
    size = np.diff(off)
    at = np.repeat(np.arange(n), size) + np.arange(len(ids))  # places of the words when each document has one more
    after = np.full(len(ids) + n, vocabulary.end, np.int64)
    after[at] = ids
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[off[:-1] + np.arange(n)] = vocabulary.start
    doc = np.repeat(np.arange(n, dtype=np.int32), size + 1)
    return (before << ID_BITS) | after, doc


def triple_keys(vocabulary: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`pair_keys`, and the symbol before each pair (the start, where the pair begins with it)."""
    keys, doc = pair_keys(vocabulary, ids, off)
    before = np.empty_like(keys)
    before[1:] = keys[:-1] >> ID_BITS
    before[off[:-1] + np.arange(len(off) - 1)] = vocabulary.start
    return before, keys, doc


def block_triples(vocabulary: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct histories of a block, each token's triple (the place of its history, then itself), and each one's document."""
    before, keys, doc = triple_keys(vocabulary, ids, off)
    before <<= ID_BITS
    before |= keys >> ID_BITS
    histories, found = np.unique(before, return_inverse=True)
    del before
    found <<= ID_BITS
    keys &= MASK
    found |= keys
    return histories, found, doc


def _ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as writer:
        writer.write_table(t)
    return sink.getvalue().to_pybytes()


def _texts(batch: pa.RecordBatch):
    """(block, documents, ids, offsets) of encoded rows."""
    for block, docs, ids in zip(*(batch.column(c) for c in ("block", "docs", "ids")), strict=True):
        info = pa.ipc.open_stream(docs.as_buffer()).read_all()
        yield block.as_py(), info, unpack(ids.as_buffer()), np.concatenate([[0], np.cumsum(np.asarray(info.column("n_tokens")) - 1)]).astype(np.int64)


def _blocks(batches):
    """Runs of documents of about ``BLOCK_TOKENS`` tokens: (number, doc_ids, train flags, hashes, offsets)."""
    held, tokens, number = [], 0, 0

    def joined(parts):
        ids, train, hashes, words = zip(*parts, strict=True)
        parts.clear()
        sizes = np.concatenate([np.diff(w) for w in words])
        return number, pa.concat_arrays(ids), np.concatenate(train), np.concatenate(hashes), np.concatenate([[0], np.cumsum(sizes)])

    for batch in batches:
        train = np.asarray(batch.column("train").to_pandas()).astype(bool)
        for i, j, data, off in slices(batch.column("text")):
            hashes, words = word_hashes(data, off)
            held.append((batch.column("doc_id").slice(i, j - i), train[i:j], hashes, words))
            tokens += len(hashes) + j - i
            if tokens >= BLOCK_TOKENS:
                yield joined(held)
                tokens, number = 0, number + 1
    if held:
        yield joined(held)


def _input(docs: DataFrame, train: Column) -> DataFrame:
    return texts(docs.withColumn("train", F.coalesce(train, F.lit(True))), "train")


def word_counts(docs: DataFrame, train: Column) -> DataFrame:
    """(hash, n) of all words of the training texts."""

    def run(batches):
        for _, _, own, hashes, off in _blocks(batches):
            h, n = counted(hashes[np.repeat(own, np.diff(off))])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["hash", "n"])

    return _input(docs, train).where("train").mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def _word_buckets(words: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            b = bucket_of(np.asarray(batch.column("hash")), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), *batch.columns], names=["bucket", "hash", "n"])

    return words.select("hash", "n").mapInArrow(run, "bucket int, hash bigint, n bigint")


_FOUND = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("docs", pa.binary()), ("ids", pa.binary())])


def encode(docs: DataFrame, train: Column, words: DataFrame, symbols: Broadcast) -> DataFrame:
    """(block, docs, ids): blocks of texts as packed symbol ids, with a table of their documents: doc_id, train, n_tokens, n_known, n_other (words of
    the class), base and class_log (sums of log10(c + 0.5) of all tokens and of the class's words). ``words`` are those that are not broadcast."""

    def split(batches):
        """A block's documents (kind 0; words that are not broadcast are numbered) and, for each bucket, those words' hashes (kind 1)."""
        part = TaskContext.get().partitionId()
        for number, ids, own, hashes, off in _blocks(batches):
            v = symbols.value.vocabulary
            code = v.ids(hashes)
            at = np.flatnonzero(code == v.other)
            far, place = np.unique(hashes[at], return_inverse=True)
            bucket = bucket_of(far, symbols.value.buckets)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(far), np.int64)
            rank[order] = np.arange(len(far))
            code[at] = v.first_rare + rank[place]
            edge = np.searchsorted(bucket[order], np.arange(symbols.value.buckets + 1))
            info = pa.table({"doc_id": ids, "train": own, "n_tokens": np.diff(off) + 1})
            rows = [(0, -1 - document_bucket((part << 32) | number), 0, _ipc(info), pack(code))]
            for b in np.flatnonzero(np.diff(edge)).tolist():
                rows.append((1, b, int(edge[b]), pack(np.diff(far[order[edge[b]: edge[b + 1]]], prepend=U(0))), b""))
            kind, b, first, docs, ids = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array([(part << 32) | number] * len(rows), pa.int64()), pa.array(b, pa.int32()),
                                              pa.array(first, pa.int64()), pa.array(docs, pa.binary()), pa.array(ids, pa.binary())],
                                             names=["kind", "block", "bucket", "first", "docs", "ids"])

    def resolve(key, entries: pa.Table, own: pa.Table) -> pa.Table:
        """Ids (0: the class) and, for the class, counts of the words that blocks ask for; blocks pass as they are."""
        s, bucket = symbols.value, key[0].as_py()
        if bucket < 0:
            return entries.select(["kind", "block", "first", "docs", "ids"])
        h, n = np.zeros(0, U), np.zeros(0, np.int64)
        if own.num_rows:
            h, n = np.asarray(own.column("hash")).view(U), np.asarray(own.column("n"))
            order = np.argsort(h)
            h, n = h[order], n[order]
        ids = np.zeros(len(h), np.int64)
        held = np.flatnonzero(n >= s.least)
        held = held[np.argsort(-n[held], kind="stable")]
        level = np.searchsorted(-s.rare_counts, -n[held])
        ids[held] = s.rare_starts[level, bucket] + np.arange(len(held)) - np.searchsorted(level, level)
        out = []
        for i in range(entries.num_rows):
            asked = np.cumsum(unpack(entries.column("docs")[i].as_buffer()).view(U), dtype=U)
            id_, count = counts_of(asked, h, ids), counts_of(asked, h, n)
            out.append((1, entries.column("block")[i].as_py(), entries.column("first")[i].as_py(), pack(np.where(id_ > 0, 0, count)), pack(id_)))
        return _batch(out, _FOUND)

    def put_in(t: pa.Table) -> pa.Table:
        """``docs`` and ``ids`` are counts and ids of words in the rows that :func:`resolve` adds."""
        s, v = symbols.value, symbols.value.vocabulary
        block, found = (t.filter(pa.array(np.asarray(t.column("kind")) == k)) for k in (0, 1))
        info = pa.ipc.open_stream(block.column("docs")[0].as_buffer()).read_all()
        code = unpack(block.column("ids")[0].as_buffer())
        order = np.argsort(np.asarray(found.column("first"))).tolist() if found.num_rows else []
        ids, counts = (np.concatenate([np.zeros(0, np.int64), *(unpack(found.column(c)[i].as_buffer()) for i in order)]) for c in ("ids", "docs"))
        far = np.flatnonzero(code >= v.first_rare)
        place = code[far] - v.first_rare
        other = ids[place] == 0
        code[far] = np.where(other, v.other, ids[place])
        far, c = far[other], counts[place[other]]
        n_tokens = np.asarray(info.column("n_tokens"))
        doc, size = np.repeat(np.arange(len(n_tokens)), n_tokens - 1), len(n_tokens)
        logs = np.log10(s.count(code) + 0.5)
        logs[far] = np.log10(c + 0.5)
        columns = {"n_known": n_tokens - 1 - np.bincount(doc[far[c == 0]], minlength=size) + (s.counts[v.end] > 0),
                   "n_other": np.bincount(doc[far], minlength=size), "base": np.bincount(doc, logs, size) + np.log10(s.counts[v.end] + 0.5),
                   "class_log": np.bincount(doc[far], logs[far], size)}
        for name, x in columns.items():
            info = info.append_column(name, pa.array(x.astype(np.float64 if name in ("base", "class_log") else np.int64)))
        return pa.table({"block": block.column("block"), "docs": pa.array([_ipc(info)], pa.binary()), "ids": pa.array([pack(code)], pa.binary())})

    rows = _input(docs, train).mapInArrow(split, "kind int, block bigint, bucket int, first bigint, docs binary, ids binary")
    own = _word_buckets(words, symbols.value.buckets)
    found = rows.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(resolve, "kind int, block bigint, first bigint, docs binary, ids binary")
    blocks = found.groupBy("block").applyInArrow(put_in, "block bigint, docs binary, ids binary")
    return stage(blocks, "encoded")


def pair_counts(encoded: DataFrame, symbols: Broadcast, buckets: int) -> DataFrame:
    """(bucket, keys, counts, r1 ... r6): the training pairs of a bucket, and how many occur 1 ... 6 times."""
    names = [f"r{r}" for r in range(1, K_DISCOUNT + 2)]

    def split(batches):
        for batch in batches:
            for _, info, ids, off in _texts(batch):
                v = symbols.value.vocabulary
                keys, doc = pair_keys(v, ids, off)
                keys, n = counted(keys[info.column("train").to_numpy()[doc]])
                bucket = pair_bucket(keys, buckets, v.first_rare)
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                held = np.flatnonzero(np.diff(edge))
                parts = [order[edge[b]: edge[b + 1]] for b in held.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([pack_sorted(keys[p]) for p in parts], pa.binary()),
                                                  pa.array([pack(n[p]) for p in parts], pa.binary())], names=["bucket", "keys", "counts"])

    def add(t: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_sorted(x.as_buffer()) for x in t.column("keys")])
        n = np.concatenate([unpack(x.as_buffer()) for x in t.column("counts")])
        keys, n = counted(keys, n)
        of = np.bincount(np.minimum(n, K_DISCOUNT + 2), minlength=K_DISCOUNT + 3)
        return pa.table({"bucket": t.column("bucket")[:1], "keys": pa.array([pack_sorted(keys)], pa.binary()), "counts": pa.array([pack(n)], pa.binary())}
                        | {c: pa.array([int(of[r])]) for r, c in enumerate(names, 1)})

    rows = encoded.mapInArrow(split, "bucket int, keys binary, counts binary")
    return rows.groupBy("bucket").applyInArrow(add, "bucket int, keys binary, counts binary, " + ", ".join(f"{c} bigint" for c in names))


def _parts(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Rows in the order of their buckets, each bucket's edge, and the buckets that have rows."""
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, edge, np.flatnonzero(np.diff(edge)).tolist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


_TRIPLES = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "sizes", "before", "times"))])
_COUNTED = "bucket int, keys binary, counts binary, sizes binary, before binary, times binary, "


def triple_counts(encoded: DataFrame, symbols: Broadcast, buckets: int) -> DataFrame:
    """As :func:`pair_counts`, with the symbols that stand before each pair (sizes: how many; before, times: which, and how often), and with
    t1 ... t6: how many triples occur 1 ... 6 times. A pair that begins with the start is no triple's end."""
    names = [f"{c}{r}" for c in "rt" for r in range(1, K_DISCOUNT + 2)]

    def split(batches):
        for batch in batches:
            for _, info, ids, off in _texts(batch):
                v = symbols.value.vocabulary
                before, keys, doc = triple_keys(v, ids, off)
                own = info.column("train").to_numpy()[doc]
                pairs, at = np.unique(keys[own], return_inverse=True)
                triples, n = counted((at << ID_BITS) | before[own])
                at = triples >> ID_BITS
                bucket = pair_bucket(pairs, buckets, v.first_rare)
                order, edge, held = _parts(bucket, buckets)
                inner, inner_edge, _ = _parts(bucket[at], buckets)
                size = np.bincount(at, minlength=len(pairs))
                rows = []
                for b in held:
                    p, t = order[edge[b]: edge[b + 1]], inner[inner_edge[b]: inner_edge[b + 1]]
                    rows.append((b, pack_sorted(pairs[p]), pack(size[p]), pack(triples[t] & MASK), pack(n[t])))
                yield from _batch(rows, _TRIPLES).to_batches()

    def add(t: pa.Table) -> pa.Table:
        def all_of(column, read=unpack):
            return np.concatenate([read(x.as_buffer()) for x in t.column(column)])

        pairs, at = np.unique(np.repeat(all_of("keys", unpack_sorted), all_of("sizes")), return_inverse=True)
        triples, n = counted((at << ID_BITS) | all_of("before"), all_of("times"))
        at = triples >> ID_BITS
        total = np.bincount(at, n, len(pairs)).astype(np.int64)
        own = n[pairs[at] >> ID_BITS != symbols.value.vocabulary.start]
        of = np.concatenate([np.bincount(np.minimum(x, K_DISCOUNT + 2), minlength=K_DISCOUNT + 3)[1: K_DISCOUNT + 2] for x in (total, own)])
        packed = [pack_sorted(pairs), pack(total), pack(np.bincount(at, minlength=len(pairs))), pack(triples & MASK), pack(n)]
        return pa.table({"bucket": t.column("bucket")[:1], **{c: pa.array([x], pa.binary()) for c, x in zip(("keys", "counts", "sizes", "before", "times"), packed, strict=True)},
                         **{c: pa.array([int(x)]) for c, x in zip(names, of, strict=True)}})

    rows = encoded.mapInArrow(split, "bucket int, keys binary, sizes binary, before binary, times binary")
    return rows.groupBy("bucket").applyInArrow(add, _COUNTED + ", ".join(f"{c} bigint" for c in names))


def _counted_triples(batches):
    """Per bucket: its pairs' keys and counts, and of its triples the place of the pair, the history's key and the count."""
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("keys", "counts", "sizes", "before", "times")), strict=True):
            keys, counts, sizes, before, times = (x.as_buffer() for x in row)
            keys, counts = unpack_sorted(keys), unpack(counts)
            at = np.repeat(np.arange(len(keys)), unpack(sizes))
            yield keys, counts, at, (unpack(before) << ID_BITS) | (keys[at] >> ID_BITS), unpack(times)


def fit_triples(pairs: DataFrame, shared: Broadcast, of: list[int], frequent: tuple[np.ndarray, np.ndarray], max_histories: int, max_triples: int) -> Triples:
    """Discounts of triples; alpha and D of the most frequent histories, out of sums of which each task sends one row a history; the most frequent of
    these histories' triples. ``of``: the counts of counts; ``frequent``: frequent pairs and their counts."""
    vocabulary = shared.value.vocabulary
    factor, start, end = discounts(of), vocabulary.start, vocabulary.end
    keys, n = (x[frequent[0] & MASK != end] for x in frequent)
    size = np.bincount(np.log2(n).astype(int), minlength=64)[::-1].cumsum()[::-1]  # pairs of 2^t occurrences or more
    hot = keys[n >= 1 << int(np.flatnonzero(np.append(size, 0) <= max_histories)[0])] if max_histories and len(n) else keys[:0]
    empty = np.zeros(0)
    out = Triples(factor, np.log10(np.maximum(factor * np.arange(K_DISCOUNT + 1), 1e-300)), hot, empty, empty, empty.astype(bool), hot[:0], empty)
    if not len(hot):
        return out

    def hot_triples(batches):
        for keys, counts, at, history, times in _counted_triples(batches):
            place = np.where(history & MASK == start, -1, out.place(history))
            yield keys, counts, at, place, times, np.flatnonzero(place >= 0)

    def sums(batches):
        total, sizes, a = np.zeros((3, len(hot))), np.zeros(64, np.int64), shared.value
        for keys, counts, at, place, times, held in hot_triples(batches):
            p = a.seen_p(counts, *a.d_of(keys >> ID_BITS, a.rare_histories(keys, counts)))
            c, place = times[held], place[held]
            cut = np.where(c <= K_DISCOUNT, c * (1 - factor[np.minimum(c, K_DISCOUNT)]), 0.0)
            for k, x in enumerate((c, cut, p[at[held]])):
                total[k] += np.bincount(place, x, len(hot))
            sizes += np.bincount(np.log2(c).astype(int), minlength=64)
        held = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([held, -1 - np.arange(64)])), *(pa.array(np.concatenate([x[held], s])) for x, s in zip(
            total, (sizes.astype(float), np.zeros(64), np.zeros(64)), strict=True))], names=["h", "c", "cut", "p"])

    columns = pairs.select("keys", "counts", "sizes", "before", "times")
    rows = (columns.mapInArrow(sums, "h bigint, c double, cut double, p double")
            .groupBy("h").agg(F.sum("c").alias("c"), F.sum("cut").alias("cut"), F.sum("p").alias("p")).toPandas())  # at most ``max_histories`` rows, and 64
    h, total = rows["h"].to_numpy(np.int64), np.zeros((3, len(hot)))
    total[:, h[h >= 0]] = rows[["c", "cut", "p"]].to_numpy(float)[h >= 0].T
    out.log_alpha, out.log_d, out.whole = backoff(*total)
    sizes = np.zeros(65)
    sizes[-1 - h[h < 0]] = rows["c"].to_numpy(float)[h < 0]
    sizes = sizes[::-1].cumsum()[::-1]
    least = int(np.flatnonzero(sizes <= max_triples)[0])

    def chosen(batches):
        for keys, _, at, place, times, held in hot_triples(batches):
            held = held[times[held] >= 1 << least]
            yield pa.RecordBatch.from_arrays([pa.array((place[held] << ID_BITS) | (keys[at[held]] & MASK)), pa.array(times[held])], names=["key", "n"])

    if sizes[least]:
        rows = columns.mapInArrow(chosen, "key bigint, n bigint").toPandas().sort_values("key")  # at most ``max_triples`` rows
        out.keys, n = rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        place = out.keys >> ID_BITS
        out.log_p = out.seen_log(n, out.log_d[place], out.whole[place])
    return out


def discounts(of: list[int]) -> np.ndarray:
    """Discount factors of the counts 0 ... K_DISCOUNT by Good and Turing, from the counts of counts 1 ... K_DISCOUNT + 1."""
    n = [0, *of]
    out = np.ones(K_DISCOUNT + 1)
    left = (K_DISCOUNT + 1) * n[K_DISCOUNT + 1] / n[1] if n[1] else 1.0
    for r in range(1, K_DISCOUNT + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - left) / (1 - left) if n[r] and left < 1 else 1.0
        out[r] = good if 0 < good < 1 else (r - 0.5) / r
    return out


def history_sums(pairs: DataFrame, size: int, factor: np.ndarray, symbols: Broadcast) -> np.ndarray:
    """Per history of an id below ``size``: its pairs' count, the mass (in counts) the discounts leave, and the followers' p. One row per history and
    task is shuffled."""

    def run(batches):
        total = np.zeros((3, size))
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
                key, n = unpack_sorted(keys.as_buffer()), unpack(counts.as_buffer())
                near = key >> ID_BITS < size
                key, n = key[near], n[near]
                for k, v in enumerate(pair_masses(key, n, factor, symbols.value)):
                    total[k] += np.bincount(key >> ID_BITS, v, size)
        held = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(held), *(pa.array(t[held]) for t in total)], names=["h", "c", "cut", "p"])

    rows = (pairs.select("keys", "counts").mapInArrow(run, "h bigint, c double, cut double, p double")
            .groupBy("h").agg(F.sum("c").alias("c"), F.sum("cut").alias("cut"), F.sum("p").alias("p")).toPandas())
    out = np.zeros((3, size))
    out[:, rows["h"].to_numpy(np.int64)] = rows[["c", "cut", "p"]].to_numpy(float).T
    return out


def frequent_pairs(pairs: DataFrame, size: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the pairs of 2^t occurrences or more whose history's id is below ``size``, with the smallest t that gives ``limit``
    pairs at most. The others are found in their buckets: which pairs are here decides where they are looked up, not what they score."""

    def sizes(batches):
        total = np.zeros(64, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
                near = unpack_sorted(keys.as_buffer()) >> ID_BITS < size
                total += np.bincount(np.log2(unpack(counts.as_buffer())[near]).astype(int), minlength=64)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array(total)], names=["t", "n"])

    of = {r.t: r.n for r in pairs.select("keys", "counts").mapInArrow(sizes, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    least, held = 64, 0
    while least > 0 and held + of.get(least - 1, 0) <= limit:
        least -= 1
        held += of.get(least, 0)

    def chosen(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
                key, n = unpack_sorted(keys.as_buffer()), unpack(counts.as_buffer())
                held = (n >= 1 << least) & (key >> ID_BITS < size)
                yield pa.RecordBatch.from_arrays([pa.array(key[held]), pa.array(n[held])], names=["key", "n"])

    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = pairs.select("keys", "counts").mapInArrow(chosen, "key bigint, n bigint").toPandas().sort_values("key")  # at most ``limit`` rows
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def counts_of(keys: np.ndarray, have: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each key by the sorted keys ``have``, 0 for others."""
    if not len(have):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, counts[at], 0)


def fit(docs: DataFrame, train: Column, max_vocabulary: int | None = None, bucket_tokens: int = 2_000_000, least_buckets: int = 16,
        max_frequent: int = 1 << 18, max_shared: int = 1 << 17, bucket_words: int = 500_000, order: int = 2, max_histories: int = 1 << 15,
        max_triples: int = 1 << 17) -> Katz:
    """Fit on the rows of ``docs`` where ``train`` holds (null counts as true): pairs, with ``order`` 3 triples too. With ``max_vocabulary``, words beyond
    it join the class; where words tie at that cut, all of them do. ``max_shared``, ``max_frequent``, ``max_histories`` and ``max_triples`` bound what is
    broadcast and change no result."""
    if order not in (2, 3):
        raise ValueError(f"order 2 or 3, not {order}")
    spark = docs.sparkSession
    words = stage(word_counts(docs, train), "word-counts")
    ends = docs.where(F.coalesce(train, F.lit(True))).count()
    by_count = sorted(((r.n, r.words) for r in words.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    total, distinct = sum(n * k for n, k in by_count), sum(k for _, k in by_count)

    def cut(limit: int | None) -> int:
        """The least count above 1 that ``limit`` words at most reach."""
        size = 0
        for n, k in by_count:
            size += k
            if n < 2:
                break
            if limit is not None and size > limit:
                return n + 1
        return 2

    least = cut(max_vocabulary)
    shared = max(least, cut(max_shared))
    levels = [(n, k) for n, k in by_count if least <= n < shared]  # of rarer symbols
    inside, n_inside = sum(k for n, k in by_count if n >= least), sum(n * k for n, k in by_count if n >= least)
    if inside > (1 << ID_BITS) - 4:
        raise ValueError(f"there can be {(1 << ID_BITS) - 4} symbols at most")
    frequent = words.where(F.col("n") >= shared).toPandas()  # at most ``max_shared`` rows
    vocabulary = Vocabulary(frequent["hash"].to_numpy(np.int64).view(U), frequent["n"].to_numpy(np.int64))
    n_other, v_other = total - n_inside, distinct - inside
    n, v = total + ends, distinct + (ends > 0)

    word_buckets = max(least_buckets, -(-distinct // bucket_words))
    rare_counts = np.array([c for c, _ in levels], np.int64)
    held = np.zeros((len(levels), word_buckets), np.int64)  # rarer symbols by count and bucket
    if levels:
        rare = words.where((F.col("n") >= least) & (F.col("n") < shared))
        rows = _word_buckets(rare, word_buckets).groupBy("bucket", "n").agg(F.count("*").alias("k")).toPandas()
        held[np.searchsorted(-rare_counts, -rows["n"].to_numpy(np.int64)), rows["bucket"].to_numpy(np.int64)] = rows["k"].to_numpy(np.int64)
    starts = vocabulary.first_rare + (np.cumsum(held.ravel()) - held.ravel()).reshape(held.shape)
    counts = np.concatenate([vocabulary.counts, [ends, n_other]])
    table = Symbols(vocabulary, counts, rare_counts, starts[:, 0].copy(), starts, word_buckets, least, inside + 2, n)
    symbols = spark.sparkContext.broadcast(table)
    far = words.where(F.col("n") < shared)
    encoded = encode(docs, train, far, symbols)

    buckets = max(least_buckets, -(-n // bucket_tokens))
    pairs = stage((pair_counts if order == 2 else triple_counts)(encoded, symbols, buckets), "pair-counts", "bucket")
    of = pairs.agg(*(F.sum(f"{c}{r}") for c in "rt"[:order - 1] for r in range(1, K_DISCOUNT + 2))).first()
    of = [int(x or 0) for x in of]
    factor = discounts(of[:K_DISCOUNT + 1])
    log_alpha, log_d, whole = backoff(*history_sums(pairs, vocabulary.first_rare, factor, symbols))
    arrays = Arrays(table, vocabulary, np.log10(table.p(np.arange(len(table.counts)))), log_alpha, log_d, whole, factor,
                    np.log10(np.maximum(factor * np.arange(K_DISCOUNT + 1), 1e-300)), n, v, n_other, v_other)
    often = frequent_pairs(pairs, vocabulary.first_rare, max_frequent)
    model = Katz(far, encoded, pairs, symbols, spark.sparkContext.broadcast(arrays), buckets, n, v, spark.sparkContext.broadcast(often))
    if order == 3:
        triples = fit_triples(pairs, model.shared, of[K_DISCOUNT + 1:], often, max_histories, max_triples)
        model.triples = spark.sparkContext.broadcast(triples)
    return model


_SCHEMA = "bucket int, block bigint, keys binary, counts binary, docs binary"
_SUMS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("at", pa.binary()), ("sums", pa.binary())])


def bucket_sums(docs: DataFrame, model: Katz, encoded: DataFrame | None = None) -> DataFrame:
    """(block, kind, at, sums): per block and bucket the documents it touched and their sums of pairs (kind 0); kind -1 holds the block's documents."""
    shared, buckets, frequent = model.shared, model.buckets, model.frequent
    if encoded is None:
        encoded = encode(docs, F.col("train"), model.words, model.symbols)

    def split(batches):
        """A block's pairs with their documents, and its documents (a negative bucket)."""
        for batch in batches:
            for block, info, ids, off in _texts(batch):
                a = shared.value
                keys, doc = pair_keys(a.vocabulary, ids, off)
                n = counts_of(keys, *frequent.value)
                common = n > 0
                pair = np.bincount(doc[common], a.pair_log(keys[common], n[common]), len(off) - 1).astype(float)
                keys, doc = keys[~common], doc[~common]
                order = np.argsort(keys, kind="stable")
                keys, doc = keys[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(keys)))
                keys = keys[first]
                bucket = pair_bucket(keys, buckets, a.vocabulary.first_rare)
                place = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[place], np.arange(buckets + 1))
                rows = [(-1 - document_bucket(block), _ipc(info.append_column("pair", pa.array(pair))), b"", b"")]
                for b in np.flatnonzero(np.diff(edge)).tolist():
                    at = place[edge[b]: edge[b + 1]]
                    size = n[at]
                    inside = np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    rows.append((b, pack_sorted(keys[at]), pack(size), pack(doc[inside])))
                b, k, n, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([block] * len(b), pa.int64()), *(pa.array(x, pa.binary()) for x in (k, n, d))],
                                                 names=["bucket", "block", "keys", "counts", "docs"])

    def look_up(t: pa.Table) -> pa.Table:
        """Sums per document of one bucket's entries, block by block."""
        blocks = t.column("block").to_pylist()
        have, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, block in enumerate(blocks):
            if block == -1:
                have, count = unpack_sorted(t.column("keys")[i].as_buffer()), unpack(t.column("counts")[i].as_buffer())
        rare = shared.value.rare_histories(have, count)
        out = []
        for i, block in enumerate(blocks):
            if block == -1:
                continue
            keys = unpack_sorted(t.column("keys")[i].as_buffer())
            size, doc = unpack(t.column("counts")[i].as_buffer()), unpack(t.column("docs")[i].as_buffer())
            value = shared.value.pair_log(keys, counts_of(keys, have, count), rare)
            touched = np.flatnonzero(np.bincount(doc))
            out.append((block, 0, pack_sorted(touched), np.bincount(doc, np.repeat(value, size))[touched].tobytes()))
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(c, t.type) for c, t in zip(columns, _SUMS, strict=True)], schema=_SUMS)

    entries = encoded.mapInArrow(split, _SCHEMA)
    pairs = model.pairs.select("bucket", F.lit(-1).cast("bigint").alias("block"), "keys", "counts", F.lit(b"").alias("docs"))
    return entries.union(pairs).groupBy("bucket").applyInArrow(_or_documents(look_up), "block bigint, kind int, at binary, sums binary")


_ENTRIES = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()),
                      *((c, pa.binary()) for c in ("keys", "sizes", "follow", "counts", "docs", "blocks"))])
_ENTRIES_DDL = "bucket int, kind int, block bigint, keys binary, sizes binary, follow binary, counts binary, docs binary, blocks binary"


def triple_sums(docs: DataFrame, model: Katz, encoded: DataFrame | None = None) -> DataFrame:
    """:func:`bucket_sums` of a model with triples. Rows on the way: a block's documents (kind -1) and sums of its documents (0), which pass all buckets,
    entries (1) and what was counted in training (2)."""
    shared, buckets, frequent, triples = model.shared, model.buckets, model.frequent, model.triples
    if encoded is None:
        encoded = encode(docs, F.col("train"), model.words, model.symbols)

    def split(batches):
        """A block's documents, and its triples but for the frequent ones."""
        for batch in batches:
            for block, info, ids, off in _texts(batch):
                a, hot = shared.value, triples.value
                start, at_first = a.vocabulary.start, off[:-1] + np.arange(len(off) - 1)
                histories, found, doc = block_triples(a.vocabulary, ids, off)
                del ids
                order = np.argsort(found, kind="stable")
                found, doc = found[order], doc[order]
                del order
                begin = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
                times = np.diff(np.append(begin, len(found)))
                at, follow = found[begin] >> ID_BITS, found[begin] & MASK
                del found
                place = np.where(histories & MASK == start, -1, hot.place(histories))
                done, value = hot.frequent(place[at], follow)
                first = np.flatnonzero((histories & MASK == start)[at])  # a text's first token is told by the start and itself
                n = counts_of((start << ID_BITS) | follow[first], *frequent.value)
                first, n = first[n > 0], n[n > 0]
                done[first], value[first] = True, a.pair_log((start << ID_BITS) | follow[first], n)
                value[~done] = 0.0
                pair = np.bincount(doc, np.repeat(value, times), len(at_first))
                bucket = hot.bucket(histories[at], place[at], follow, buckets, start)
                bucket[done] = buckets
                order, edge, held = _parts(bucket, buckets)
                yield from _batch([(-1 - document_bucket(block), -1, block, _ipc(info.append_column("pair", pa.array(pair))), b"", b"", b"", b"", b"")],
                                  _ENTRIES).to_batches()
                for b in held:
                    t = order[edge[b]: edge[b + 1]]
                    own, size = np.unique(at[t], return_counts=True)
                    n = times[t]
                    inside = np.repeat(begin[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    yield from _batch([(b, 1, block, pack_histories(histories[own]), pack(size), pack(follow[t]), pack(n), pack(doc[inside]), b"")], _ENTRIES).to_batches()

    def regroup(batches):
        """Counted triples go to their histories' buckets. follow, counts: followers and counts; docs, blocks: the last pair's count, and the D of its
        history (twice, and one if it is whole) where that is not broadcast."""
        for keys, counts, at, history, times in _counted_triples(batches):
            a, hot = shared.value, triples.value
            held = np.flatnonzero(history & MASK != a.vocabulary.start)
            at, history, times = at[held], history[held], times[held]
            d, whole = a.d_of(keys >> ID_BITS, a.rare_histories(keys, counts))
            d = np.where(keys >> ID_BITS >= a.vocabulary.first_rare, 2 * np.rint(d).astype(np.int64) + whole, 0)
            histories, own = np.unique(history, return_inverse=True)
            place = hot.place(histories)
            follow = keys[at] & MASK
            order = np.argsort((own << ID_BITS) | follow, kind="stable")
            at, times, own, follow = at[order], times[order], own[order], follow[order]
            alone = place[own] < 0  # alpha and D are to be worked out
            order, edge, buckets_held = _parts(hot.bucket(histories[own], place[own], follow, buckets, a.vocabulary.start), buckets)
            rows = []
            for b in buckets_held:
                t = order[edge[b]: edge[b + 1]]
                mine, size = np.unique(own[t], return_counts=True)
                rows.append((b, 2, -1, pack_histories(histories[mine]), pack(size), pack(follow[t]), pack(times[t]), pack(np.where(alone[t], counts[at[t]], 0)),
                             pack(np.where(alone[t], d[at[t]], 0))))
            yield from _batch(rows, _ENTRIES).to_batches()

    def read(t: pa.Table, i: int) -> tuple[np.ndarray, ...]:
        """Distinct histories, each triple's place among them, followers and counts of a row."""
        keys = unpack_histories(t.column("keys")[i].as_buffer())
        at = np.repeat(np.arange(len(keys)), unpack(t.column("sizes")[i].as_buffer()))
        return keys, at, unpack(t.column("follow")[i].as_buffer()), unpack(t.column("counts")[i].as_buffer())

    def look_up(t: pa.Table) -> pa.Table:
        """Sums of what a bucket has seen, and of the alphas; what it has not seen goes on as pairs, a row for each bucket of pairs."""
        a, hot, kinds, blocks = shared.value, triples.value, t.column("kind").to_pylist(), t.column("block").to_pylist()
        none = np.zeros(0, np.int64)
        history, follow, count, pair, d = [none], [none], [none], [none], [none]
        for i, kind in enumerate(kinds):
            if kind == 2:
                keys, at, w, n = read(t, i)
                for held, x in zip((history, follow, count, pair, d), (keys[at], w, n, unpack(t.column("docs")[i].as_buffer()),
                                                                      unpack(t.column("blocks")[i].as_buffer())), strict=True):
                    held.append(x)
        history, follow, count, pair, d = (np.concatenate(x) for x in (history, follow, count, pair, d))
        histories, at = np.unique(history, return_inverse=True)
        near, whole = a.d_of(np.minimum(history & MASK, a.vocabulary.first_rare - 1), ())
        far = history & MASK >= a.vocabulary.first_rare
        whole = np.where(far, d & 1 == 1, whole)
        p = a.seen_p(pair, np.where(far, np.maximum(d >> 1, 1), near), whole)
        cut = np.where(count <= K_DISCOUNT, count * (1 - hot.factor[np.minimum(count, K_DISCOUNT)]), 0.0)
        log_alpha, log_d, whole = backoff(*(np.bincount(at, x, len(histories)) for x in (count, cut, p)))
        place = hot.place(histories)
        for own, common in ((log_alpha, hot.log_alpha), (log_d, hot.log_d), (whole, hot.whole)):
            own[place >= 0] = common[place[place >= 0]]
        key = (at << ID_BITS) | follow
        order = np.argsort(key)
        key, count = key[order], count[order]
        rows, left = [], []
        for i, kind in enumerate(kinds):
            if kind != 1:
                continue
            keys, own, follow, times = read(t, i)
            doc = unpack(t.column("docs")[i].as_buffer())
            at = counts_of(keys, histories, np.arange(1, len(histories) + 1)) - 1
            known, at = at >= 0, np.maximum(at, 0)
            common = hot.place(keys)
            alpha = np.zeros(len(keys))
            alpha[known] = log_alpha[at[known]]
            alpha[common >= 0] = hot.log_alpha[common[common >= 0]]
            n = np.where(known[own], counts_of((at[own] << ID_BITS) | follow, key, count), 0)
            value = alpha[own]
            seen = n > 0
            value[seen] = hot.seen_log(n[seen], log_d[at[own[seen]]], whole[at[own[seen]]])
            last = ((keys & MASK)[own] << ID_BITS) | follow
            n = np.where(seen, 1, counts_of(last, *frequent.value))
            near = ~seen & (n > 0)
            value[near] += a.pair_log(last[near], n[near])
            touched = np.flatnonzero(np.bincount(doc))
            rows.append((-1 - document_bucket(blocks[i]), 0, blocks[i], pack_sorted(touched), b"", b"", b"", np.bincount(doc, np.repeat(value, times))[touched].tobytes(), b""))
            far = np.repeat(n == 0, times)
            left.append((np.repeat(last, times)[far], doc[far], np.full(far.sum(), blocks[i])))
        if left:
            last, doc, block = (np.concatenate(x) for x in zip(*left, strict=True))
            order = np.lexsort((doc, block, last))
            last, doc, block = last[order], doc[order], block[order]
            keys, begin, times = np.unique(last, return_index=True, return_counts=True)
            order, edge, held = _parts(pair_bucket(keys, buckets, a.vocabulary.first_rare), buckets)
            for b in held:
                at = order[edge[b]: edge[b + 1]]
                n = times[at]
                inside = np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                own, which = np.unique(block[inside], return_inverse=True)
                rows.append((b, 1, -1, pack_sorted(keys[at]), pack(n), pack_sorted(own), b"", pack(doc[inside]), pack(which)))
        return _batch(rows, _ENTRIES)

    def pairs_of(t: pa.Table) -> pa.Table:
        """Sums of the pairs of one bucket, block by block."""
        kinds = t.column("kind").to_pylist()
        have, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, kind in enumerate(kinds):
            if kind == 2:
                have, count = unpack_sorted(t.column("keys")[i].as_buffer()), unpack(t.column("counts")[i].as_buffer())
        rare = shared.value.rare_histories(have, count)
        parts = []
        for i, kind in enumerate(kinds):
            if kind == 1:
                keys = unpack_sorted(t.column("keys")[i].as_buffer())
                value = np.repeat(shared.value.pair_log(keys, counts_of(keys, have, count), rare), unpack(t.column("sizes")[i].as_buffer()))
                block = unpack_sorted(t.column("follow")[i].as_buffer())[unpack(t.column("blocks")[i].as_buffer())]
                parts.append((block, unpack(t.column("docs")[i].as_buffer()), value))
        if not parts:
            return pa.table([[]] * 4, schema=_SUMS)
        block, doc, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(block, kind="stable")
        doc, value = doc[order], value[order]
        blocks, begin = np.unique(block[order], return_index=True)
        out = []
        for b, i, j in zip(blocks.tolist(), begin.tolist(), [*begin[1:].tolist(), len(doc)], strict=True):
            touched = np.flatnonzero(np.bincount(doc[i:j]))
            out.append((b, 0, pack_sorted(touched), np.bincount(doc[i:j], value[i:j])[touched].tobytes()))
        return _batch(out, _SUMS)

    def first(t: pa.Table) -> pa.Table:
        return look_up(t) if t.column("bucket")[0].as_py() >= 0 else t

    def second(t: pa.Table) -> pa.Table:
        """Buckets of pairs; a block's documents take in their sums."""
        if t.column("bucket")[0].as_py() >= 0:
            return pairs_of(t)
        kinds, blocks, infos = t.column("kind").to_pylist(), t.column("block").to_pylist(), {}
        for i, kind in enumerate(kinds):
            if kind == -1:
                info = pa.ipc.open_stream(t.column("keys")[i].as_buffer()).read_all()
                infos[blocks[i]] = info, info.column("pair").to_numpy().copy()
        for i, kind in enumerate(kinds):
            if kind == 0:
                infos[blocks[i]][1][unpack_sorted(t.column("keys")[i].as_buffer())] += np.frombuffer(t.column("docs")[i].as_buffer())
        return _batch([(b, -1, b"", _ipc(info.drop_columns("pair").append_column("pair", pa.array(pair)))) for b, (info, pair) in infos.items()], _SUMS)

    none = F.lit(b"")
    entries = encoded.mapInArrow(split, _ENTRIES_DDL).union(model.pairs.select("keys", "counts", "sizes", "before", "times").mapInArrow(regroup, _ENTRIES_DDL))
    counted_pairs = model.pairs.select("bucket", F.lit(2).alias("kind"), F.lit(-1).cast("bigint").alias("block"), "keys", none.alias("sizes"), none.alias("follow"),
                                       "counts", none.alias("docs"), none.alias("blocks"))
    return (entries.groupBy("bucket").applyInArrow(first, _ENTRIES_DDL).union(counted_pairs)
            .groupBy("bucket").applyInArrow(second, "block bigint, kind int, at binary, sums binary"))


def document_bucket(block: int) -> int:
    """A bucket below 2^30 for a block's documents."""
    return ((block >> 32) * 1009 + (block & 0xFFFFFFFF)) % (1 << 30)


def score(docs: DataFrame, model: Katz, encoded: DataFrame | None = None) -> DataFrame:
    """Per text: doc_id, train (the column's value), n_tokens, n_known, base_score, score. ``docs`` has a boolean column ``train``. ``encoded`` is
    ``model.encoded`` where ``docs`` and ``train`` are those of :func:`fit`, so that texts are read once."""
    shared = model.shared

    def merge(t: pa.Table) -> pa.Table:
        """All sums of a block with its documents."""
        kinds = t.column("kind").to_pylist()
        info = pa.ipc.open_stream(t.column("sums")[kinds.index(-1)].as_buffer()).read_all()
        pair = info.column("pair").to_numpy().copy()
        for i, kind in enumerate(kinds):
            if kind >= 0:
                pair[unpack_sorted(t.column("at")[i].as_buffer())] += np.frombuffer(t.column("sums")[i].as_buffer())
        a = shared.value
        tokens, n_other, base, other = (np.asarray(info.column(c)) for c in ("n_tokens", "n_other", "base", "class_log"))
        return pa.table({"doc_id": info.column("doc_id"), "train": info.column("train"), "n_tokens": tokens, "n_known": info.column("n_known"),
                         "base_score": base - tokens * np.log10(a.n + 0.5 * (a.v + 1)),
                         "score": pair + other - n_other * np.log10(a.n_other + 0.5 * (a.v_other + 1))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    sums = bucket_sums if model.triples is None else triple_sums
    return (sums(docs, model, encoded).groupBy("block")
            .applyInArrow(merge, f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"))


def _or_documents(look_up):
    """Rows of documents (negative buckets) pass as they are."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() >= 0:
            return look_up(t)
        return pa.table([t.column("block"), pa.array([-1] * t.num_rows, pa.int32()), t.column("docs"), t.column("keys")], schema=_SUMS)

    return run
