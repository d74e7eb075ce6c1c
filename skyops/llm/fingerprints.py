"""Document fingerprints by locally consistent parsing.

The bytes of a text are parsed level by level. At each level runs of one name become one symbol; deterministic coin tossing (the lowest bit in
which a symbol differs from its left neighbour, and that bit's value, three times over) gives labels below 8 that differ between
neighbours; a phrase starts at each local maximum of the labels. A phrase's name is a hash of the names in it. Where a phrase starts
depends only on a few symbols around it, so equal substrings are cut into equal phrases but near their ends, wherever they stand. A level has about
a third of the names of the one below.

A fingerprint holds the ``size`` smallest 32-bit names of the phrases of level ``base`` and above and of the one phrase that spans the text, in
hex; the likeness of two fingerprints estimates the Jaccard index of the names (bottom-k sketch). Names of level 3 span about 30 bytes.

Defined results: null and empty texts have the empty fingerprint, like itself (1.0) and unlike any other (0.0); documents are ordered by
doc_id, then text; repeated rows are documents of their own; a single document is its own successor; an empty table gives no rows; other
columns are ignored. doc_id must be an integer column; null doc_ids come first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyops.llm.common import SLICE_BYTES, slices, texts
from skyops.llm.words import _powers, mix

U = np.uint64


def _lowest_difference(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing: 2 * (lowest bit in which a symbol differs from the one before) + that bit. First symbols of documents use bit 0."""
    one = x.dtype.type(1)
    z = np.empty_like(x)
    z[1:] = x[1:] ^ x[:-1]
    z[first] = one
    low = z & (~z + one)
    return (np.bitwise_count(low - one) * np.uint8(2) + ((x & low) != 0)).astype(np.uint8)


def parse(names: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and document offsets of the next level. ``off``: offsets of documents, none of them empty."""
    starts = np.ones(len(names), bool)
    starts[1:] = names[1:] != names[:-1]
    starts[off[:-1]] = True
    at = np.flatnonzero(starts)
    if len(at) < len(names):  # runs of one name
        length = np.diff(np.append(at, len(names))).astype(U)
        names = np.where(length > U(1), mix(names[at] + length * U(0xD6E8FEB86659FD93)), names[at])
        off = np.searchsorted(at, off)
    first = off[:-1]
    label = _lowest_difference(names, first)
    label = _lowest_difference(_lowest_difference(label, first), first)
    # documents' first symbols start phrases; elsewhere local maxima do
    cut = np.zeros(len(names), bool)
    cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    cut[off[1:] - 1] = False
    cut[first] = True
    at = np.flatnonzero(cut)
    end = np.append(at[1:], len(names))
    power, inverse = _powers(len(names) + 1)
    total = np.zeros(len(names) + 1, U)
    np.cumsum(names * power[: len(names)], dtype=U, out=total[1:])
    return mix((total[end] - total[at]) * inverse[at] + (end - at).astype(U)), np.searchsorted(at, off)


def signatures(data: np.ndarray, off: np.ndarray, size: int = 32, base: int = 3) -> list[np.ndarray]:
    """Sorted 32-bit names of each document's fingerprint."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(off) - 1)]
    docs = np.flatnonzero(np.diff(off) > 0)
    names, off, level = mix(data.astype(U) + U(1)), np.append(off[docs], off[-1]), 0
    while len(docs):
        done = np.diff(off) == 1
        for d in np.flatnonzero(done if level < base else np.ones(len(docs), bool)).tolist():
            own = names[off[d]: off[d + 1]] >> U(32)
            out[docs[d]].append(np.partition(own, size)[:size] if len(own) > size else own)
        if done.any():
            keep = np.repeat(~done, np.diff(off))
            off = np.concatenate([[0], np.cumsum(np.diff(off)[~done])])
            names, docs = names[keep], docs[~done]
        if len(docs):
            names, off = parse(names, off)
            level += 1
    return [np.unique(np.concatenate(x))[:size].astype(np.uint32) if x else np.zeros(0, np.uint32) for x in out]


def likeness(a: np.ndarray, b: np.ndarray, size: int = 32) -> float:
    """Estimated Jaccard index of two signatures."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:size]
    return float((np.isin(both, a) & np.isin(both, b)).sum() / len(both))


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, size: int = 32, base: int = 3) -> DataFrame:
    """Rows: doc_id, n_bytes, fingerprint."""

    def run(batches):
        for batch in batches:
            for i, j, data, off in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(off)),
                                                  pa.array([to_hex(s) for s in signatures(data, off, size, base)], pa.string())],
                                                 names=["doc_id", "n_bytes", "fingerprint"])

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, fingerprint string")


def range_of(key: np.ndarray, spread: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of (key, spread) by sorted bounds of keys. A key that is m bounds at once is hot: its m ranges divide the 64-bit spread evenly."""
    low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
    share = ((spread >> 1) + (1 << 62)) / 2.0**63
    return np.where(high > low, low + 1 + np.minimum((share * (high - low)).astype(np.int64), high - low - 1), low).astype(np.int32)


def with_successors(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text, part, halo: each part is a range of (doc_id, text hash), null doc_ids first, closed by a copy of the next part's first document
    (halo = 1; the last part by the first document of all). Documents of one doc_id follow by their texts' hashes. Only the parts' bounds and the ids
    and hashes of their first documents reach the driver; the bounds come back as a broadcast, the firsts as a broadcast table of a row per part."""
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = (texts(docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))).withColumn("key", key).withColumn("spread", F.xxhash64("text")))
    found = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).cast("double").alias("d")).approxQuantile(
        "d", [i / parts for i in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    bounds = spark.sparkContext.broadcast(np.array(sorted(int(b) for b in found), np.int64))

    @F.pandas_udf("int")
    def part(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_of(k.to_numpy(np.int64), h.to_numpy(np.int64), bounds.value))

    rows = rows.withColumn("part", part("key", "spread"))
    firsts = sorted((r.part, *r.first) for r in rows.groupBy("part").agg(F.min(F.struct("key", "spread")).alias("first")).collect())
    if not firsts:
        return rows.withColumn("halo", F.lit(0))
    closes = spark.createDataFrame([(p, k, h, firsts[i - 1][0]) for i, (p, k, h) in enumerate(firsts)], "part int, key bigint, spread bigint, to int")
    heads = rows.join(F.broadcast(closes), ["part", "key", "spread"]).groupBy("to").agg(F.min(F.struct("doc_id", "text", "key", "spread")).alias("head"))
    halo = heads.select("head.*", F.col("to").alias("part"), F.lit(1).alias("halo"))
    return rows.withColumn("halo", F.lit(0)).unionByName(halo).repartition("part").sortWithinPartitions("part", "halo", "key", "spread", "text")


def edited(raw: bytes, after: bytes) -> bytes:
    """The last quarter of the code points (rounded down) replaced by the first as many of ``after``. Bytes that are not UTF-8 count as U+FFFD."""
    text = raw.decode(errors="replace")
    n = len(text) // 4
    return (text[: len(text) - n] + after[: 4 * n + 4].decode(errors="replace")[:n]).encode() if n else raw


def fingerprint_edits(docs: DataFrame, size: int = 32, base: int = 3) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness of its fingerprint to
    that of its edited text, and to the next document's)."""

    def flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(items), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)

    def run(batches):
        held = None  # the row that waits for its successor
        for batch in batches:
            col = {c: batch.column(c) for c in batch.schema.names}
            for i, j, data, off in slices(col["text"], SLICE_BYTES):
                own = signatures(data, off, size, base)
                part, ids, halo = (col[c].slice(i, j - i).to_pylist() for c in ("part", "doc_id", "halo"))
                raw = [x.as_py() for x in col["text"].slice(i, j - i)]
                rows = list(zip(part, ids, halo, raw, own, strict=True))
                rows = rows if held is None else [held, *rows]
                held = rows[-1]
                pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[2]]
                if not pairs:
                    continue
                new = [edited(a[3], b[3]) for a, b in pairs]
                prints = signatures(*flat(new), size, base)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a[1] for a, _ in pairs], pa.int64()), pa.array([len(a[3].decode(errors="replace")) for a, _ in pairs], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in new]), pa.array([to_hex(a[4]) for a, _ in pairs]),
                     pa.array([to_hex(s) for s in prints]), pa.array([likeness(a[4], s, size) for (a, _), s in zip(pairs, prints, strict=True)], pa.float64()),
                     pa.array([likeness(a[4], b[4], size) for a, b in pairs], pa.float64())],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_successors(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                                 "near_edited double, near_next double")
