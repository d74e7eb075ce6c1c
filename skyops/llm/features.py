"""Hashed word and word-pair features of texts, and sums of their counts over tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyops.llm.common import slices, texts
from skyops.llm.words import grams, word_hashes


def hashed_features(data: np.ndarray, off: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, documents' offsets) of the words and of the word pairs of a slice."""
    hashes, words = word_hashes(data, off)
    pairs, at = grams(hashes, words, 2)
    # a word that follows itself is one feature, whatever the word: rare words repeated in a row have no counts of their own
    left = np.repeat(words[:-1] - at[:-1], np.diff(at)) + np.arange(len(pairs))
    pairs[hashes[left] == hashes[left + 1]] = 0
    shift = np.uint64(64 - bits)
    return [((hashes >> shift).astype(np.int64), words), ((pairs >> shift).astype(np.int64), at)]


def document_sums(parts: list[tuple[np.ndarray, np.ndarray]], values: np.ndarray) -> np.ndarray:
    """Per document: sum of the values of its features."""
    total = 0.0
    for buckets, off in parts:
        run = np.concatenate([[0.0], np.cumsum(values[buckets])])
        total = total + run[off[1:]] - run[off[:-1]]
    return total


def _counts(rows: DataFrame, n: int, bits: int, members) -> np.ndarray:
    """Counts of each feature bucket in all rows (row 0) and in those of each of ``n`` sets (rows 1, 2, ...); ``members``: of a batch, which rows are
    in each set. Each task adds up its documents before the shuffle; what comes back is one row per bucket."""
    size = 1 << bits

    def count(batches):
        total = np.zeros((n + 1, size), np.int64)
        for batch in batches:
            inside = members(batch)
            for i, j, data, off in slices(batch.column("text")):
                for buckets, at in hashed_features(data, off, bits):
                    total[0] += np.bincount(buckets, minlength=size)
                    for k, member in enumerate(inside, 1):
                        own = np.repeat(member[i:j], np.diff(at))
                        if own.any():
                            total[k] += np.bincount(buckets[own], minlength=size)
        held = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), *(pa.array(t[held]) for t in total)],
                                         names=["bucket", *(f"c{k}" for k in range(len(total)))])

    names = [f"c{k}" for k in range(n + 1)]
    found = (rows.mapInArrow(count, "bucket bigint, " + ", ".join(f"{c} bigint" for c in names))
             .groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).toPandas())
    out = np.zeros((len(names), size), np.int64)
    out[:, found["bucket"].to_numpy(np.int64)] = found[names].to_numpy(np.int64).T
    return out


def class_counts(docs: DataFrame, samples: list[np.ndarray], bits: int) -> np.ndarray:
    """Counts of each feature bucket in all documents (row 0) and in the documents of each sample (rows 1, 2, ...).

    ``samples``: sorted doc_ids of bounded samples."""

    def members(batch):
        ids = np.asarray(batch.column("doc_id").fill_null(-(2**63)))
        return [np.isin(ids, sample) for sample in samples]

    return _counts(texts(docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))), len(samples), bits, members)


def joined_counts(docs: DataFrame, ids: DataFrame, bits: int) -> np.ndarray:
    """Counts of each feature bucket in all documents (row 0) and in those whose doc_id is in ``ids`` (row 1), which can have any number of rows: a
    join finds them, so neither the driver nor a task holds them all. It is a merge join at every size, so its cost grows with the input alone."""
    own = ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().withColumn("own", F.lit(True))
    rows = texts(docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))).join(own.hint("merge"), "doc_id", "left").select("text", "own")
    return _counts(rows, 1, bits, lambda batch: [np.asarray(batch.column("own").is_valid())])


def fold_counts(docs: DataFrame, ids: DataFrame, folds: int, bits: int) -> np.ndarray:
    """As :func:`joined_counts`, of the ids of each ``fold`` (0, 1, ...) apart: rows 1, 2, ... ``ids`` has an id once at most."""
    own = ids.select(F.col("doc_id").cast("bigint").alias("doc_id"), "fold")
    rows = texts(docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))).join(own.hint("merge"), "doc_id", "left").select("text", "fold")

    def members(batch):
        fold = np.asarray(batch.column("fold").fill_null(-1))
        return [fold == k for k in range(folds)]

    return _counts(rows, folds, bits, members)


def sample_ids(labels: DataFrame, where: Column, limit: int) -> np.ndarray:
    """Sorted doc_ids of at most ``limit`` labelled rows, those of the smallest hashes of doc_id."""
    rows = (labels.where(where).select(F.col("doc_id").cast("bigint").alias("doc_id")).dropna()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect())
    return np.unique(np.array([r.doc_id for r in rows], np.int64))
