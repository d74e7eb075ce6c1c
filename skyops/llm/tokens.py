"""Token-ID output as ORC: one row per document, in ascending doc_id order over the files.

Row: doc_id, part (number of the file's task), local_start (ids of all documents before it in the part), n_tokens,
ids. ORC stores the integer columns in run-length encoding, keeps a row index per ``stride`` rows and a Bloom filter on doc_id, so
readers split files by stripes and skip stripes and row groups by doc_id. Documents are dealt by ranges of doc_id, sorted and encoded
as a stream within each task; ids of different documents never meet in one task's memory beyond a batch.

With a tokenizer file whose normaliser and splitter are ``NORMALISER`` and ``SPLITTER`` (white space dropped, lower case, runs of letters, single digits, runs of
marks), the ids of a text are those of its lower-cased pieces in turn: the stretches between ASCII white space, cut further where they hold Latin letters, ASCII marks
and digits alone; the ids of a Latin word come straight from the merge model. A worker process keeps the ids of pieces
from one task to the next, in flat arrays with one slot for 2^-``SLOT_BITS`` of all hashes, and encodes the new pieces of a slice of texts together; pieces are told apart
by 64-bit hashes. With any other tokenizer file the texts are encoded whole.

Defined results: null and empty text have the end id alone; equal doc_ids are ordered by a hash of the text; null doc_ids come first; an empty
table gives an empty directory of files; other columns are ignored, whatever their names; bytes that are not UTF-8 count as U+FFFD. Ranges are of (doc_id, hash of the
text), so a doc_id with a third of the rows spreads over tasks.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skyops.llm.common import slices, texts
from skyops.llm.words import NOT_SPACE, hash_spans, spans

#: the piece table of a worker: 2^SLOT_BITS slots of 16 bytes and their ids, and the longest piece that is kept (bytes)
SLOT_BITS, LONGEST = 20, 48
#: fixed values: the normaliser and splitter for which ids go by pieces
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: a word of letters of ASCII and Latin-1
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: kinds of bytes: white space, letters, marks, digits, and all that the splitter may treat otherwise (' starts suffixes like 's, < special tokens)
_SPACE, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<"]] = _MARK
_KIND[48:58] = _DIGIT
_AFTER_C3 = np.zeros(256, bool)
_AFTER_C3[0x80:0xC0] = True
_AFTER_C3[[0x97, 0xB7]] = False  # the signs of multiplication and division


def pieces_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of the pieces of a slice, and the texts' n + 1 offsets into them. Stretches between white space that hold Latin letters, marks and digits
    alone are cut into runs of letters, runs of marks and single digits."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_AFTER_C3[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    starts, ends, words = spans(data, off, NOT_SPACE)
    cut = np.flatnonzero(((kind[1:] != kind[:-1]) & (kind[1:] != _SPACE) & (kind[:-1] != _SPACE)) | ((kind[1:] == _DIGIT) & (kind[:-1] == _DIGIT))) + 1
    stretch = np.searchsorted(starts, cut, "right") - 1
    others = np.concatenate([[0], np.cumsum(kind == _OTHER, dtype=np.int32)])
    keep = (cut > starts[stretch]) & (others[ends[stretch]] == others[starts[stretch]])  # a text's first byte is no cut
    cut = cut[keep]
    if not len(cut):
        return starts, ends, words
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, off)


class PieceIds:
    """Ids of texts, by way of the ids of their pieces (bytes without ASCII white space), kept as unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_pieces = (spec.get("normalizer"), spec.get("pre_tokenizer")) == (NORMALISER, SPLITTER) and spec.get("post_processor") is None
        # the model alone, for words that need no normalising: their bytes stand as the letters that the splitter names them by
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: "".join(x for x, _ in byte_level.pre_tokenize_str(chr(c))) for c in range(0xC0, 0x100)}
        # slot (top bits of a piece's hash) -> hash, and where its ids are; a piece takes the place of the one that has its slot
        self.keys, self.head, self.size = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 1  # the first is the end id's

    def _append(self, ids: np.ndarray) -> int:
        """Put ``ids`` behind the others; those that no slot names any more are dropped when they would outgrow the store."""
        if self.used + len(ids) > len(self.store):
            live = np.flatnonzero(self.keys)
            size = self.size[live]
            place = np.cumsum(size, dtype=np.int64) - size
            kept = self.store[np.repeat(self.head[live] - place, size) + np.arange(size.sum())]
            self.store = np.zeros(max(len(self.store), 2 * (1 + len(kept) + len(ids))), np.uint32)
            self.store[1: 1 + len(kept)] = kept
            self.head[live], self.used = 1 + place, 1 + len(kept)
        at = self.used
        self.store[at: at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode the pieces: where their ids are, and how many each has."""
        plain, words, others = [], [], []
        for k, p in enumerate(pieces):
            if p.isalpha() and p.islower():  # a-z alone
                plain.append(k)
            elif _WORD.fullmatch(p):
                words.append(k)
            else:
                others.append(k)
        bare = [pieces[k].decode() for k in plain] + [pieces[k].decode().lower().translate(self.letters) for k in words]
        ids = [e.ids for e in self.bare.encode_batch_fast(bare, add_special_tokens=False)]
        if others:
            ids += [e.ids for e in self.tokenizer.encode_batch_fast([pieces[k].decode(errors="replace") for k in others], add_special_tokens=False)]
        by = np.array(plain + words + others)
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        at = self._append(np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())))
        head, size = np.empty(len(ids), np.int32), np.empty(len(ids), np.int32)
        head[by], size[by] = at + np.cumsum(n) - n, n
        return head, size

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, each followed by ``end_id``, and how many each has."""
        raw = data.tobytes()
        if not self.by_pieces:
            whole = self.tokenizer.encode_batch_fast([raw[a:b].decode(errors="replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], add_special_tokens=False)
            ids = [[*e.ids, end_id] for e in whole]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        # special tokens are matched as they are written, so a slice that may hold one is not lower-cased beforehand
        fold = b"<|" not in raw
        starts, ends, words = pieces_of(data, off)
        key = hash_spans(data, starts, ends, fold)
        slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != key)
        if len(new):
            raw = raw.lower() if fold else raw
            new_key, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            a, b = starts[new[first]], ends[new[first]]
            # ids move when the store is cleared, so the slots are read after this
            new_head, new_size = self._learn([raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        head, size = self.head[slot], self.size[slot]
        if len(new):
            head[new], size[new] = new_head[which], new_size[which]
            kept = np.flatnonzero(b - a <= LONGEST)
            into, last = np.unique((new_key[kept] >> np.uint64(64 - SLOT_BITS)).astype(np.int64), return_index=True)
            kept = kept[last]
            self.keys[into], self.head[into], self.size[into] = new_key[kept], new_head[kept], new_size[kept]
        self.store[0] = end_id  # one more piece of each text
        head, size = np.insert(head, words[1:], 0), np.insert(size, words[1:], 1)
        place = np.cumsum(size, dtype=np.int64) - size
        ids = self.store[np.repeat(head - place, size) + np.arange(size.sum())]
        return ids, np.add.reduceat(size, words[:-1] + np.arange(len(off) - 1), dtype=np.int64)


@cache
def piece_ids(path: str) -> PieceIds:
    """The cache of this worker process."""
    return PieceIds(path)


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, stride: int = 1000,
                    stripe_bytes: int = 64 << 20) -> None:
    """Encode every document, append ``end_id`` and write the ORC files under ``path``."""

    def encode(batches):
        pieces, done = piece_ids(tokenizer_path), 0
        for batch in batches:
            for i, j, data, off in slices(batch.column("text")):
                ids, n = pieces.encode(data, off, end_id)
                offsets = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("part").slice(i, j - i), pa.array(done + offsets[:-1], pa.int64()), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4")))],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"])
                done += int(offsets[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    (texts(docs).withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
     .drop("hash").withColumn("part", F.spark_partition_id())
     .mapInArrow(encode, f"doc_id {kind}, part int, local_start bigint, n_tokens bigint, ids array<int>")
     .write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", stride)
     .option("orc.stripe.size", stripe_bytes).orc(path))


def read_token_orc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The written rows. Filters on doc_id reach the files' statistics, row indexes and Bloom filters."""
    return spark.read.schema(f"doc_id {id_type}, part int, local_start bigint, n_tokens bigint, ids array<int>").orc(path)


def token_digest(written: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    parts = written.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, off = np.asarray(ids.values).astype("<u4", copy=False), np.asarray(ids.offsets)
            crc = [zlib.crc32(memoryview(values[a:b])) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")), pa.array(crc, pa.int64())],
                                             names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    schema = T.StructType([f for f in written.schema if f.name != "ids"]).add("ids_crc32", T.LongType())
    return (written.mapInArrow(digest, schema).join(offsets, "part")
            .select("doc_id", (F.col("local_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))
