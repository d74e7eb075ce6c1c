"""Quality classifier by importance resampling.

Two generative models over hashed words and word pairs: one of the target (all labelled rows of good quality, found by a join; a caller can ask
for at most ``sample`` of them, by hash of doc_id) and one of all raw texts. A text's log weight is the log of the ratio of its probabilities. Rows are
drawn without replacement in proportion to their weights by Gumbel top-k: the k largest of log weight + Gumbel noise. The noise comes from
a hash of doc_id and the seed, so a task that runs again draws the same. Unless given, k is the number of rows whose log weight is at
least that of all but 1 - ``keep_share`` of the labelled good rows that were held out of the target model: a fifth of them, or, with ``cross``, each
in turn (the model is then fitted on all of them, and each row's weight at the cut comes from the other four fifths).

The k-th largest key, and the held-out weight at the cut, are found exactly by counting key bits, 16 at a time; no global sort, and only
histograms reach the driver.

Defined results: null and empty texts have no features and log weight 0; rows that tie with the k-th key are all selected; repeated rows
share their key; without labelled rows both models are equal but for smoothing; an empty table gives no rows; other columns pass through
``keep_selected`` and are ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyops.llm.common import slices, small_batches, stage, texts, unused
from skyops.llm.features import document_sums, fold_counts, hashed_features, joined_counts
from skyops.llm.words import mix


#: parts of the good labelled rows
FOLDS = 5


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("held"), doc_id), F.lit(FOLDS))


def split_labels(labels: DataFrame, sample: int | None = None) -> DataFrame:
    """(doc_id, held): the ids of good labelled rows, and whether they are in the fifth that is held out of the target model."""
    ids = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("bigint").alias("doc_id")).dropna().distinct()
    if sample is not None:
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return ids.withColumn("held", _fold(F.col("doc_id")) == 0)


def fit_log_ratio(docs: DataFrame, target: DataFrame | np.ndarray, bits: int = 14, smooth: float = 0.5) -> np.ndarray:
    """Per bucket: log of its probability in the texts of ``target`` (a table of doc_ids, or a few of them) over that in all texts."""
    if isinstance(target, np.ndarray):
        target = docs.sparkSession.createDataFrame([(int(i),) for i in target], "doc_id bigint")
    return _ratio(*joined_counts(docs, target, bits), smooth)


def _ratio(raw: np.ndarray, good: np.ndarray, smooth: float) -> np.ndarray:
    if not good.sum():
        return np.zeros(len(good))
    # the raw model is smoothed like a target sample of the same size, so unseen buckets weigh the same in both
    raw = raw * (good.sum() / raw.sum())
    return np.log((good + smooth) / (good.sum() + smooth * len(good))) - np.log((raw + smooth) / (raw.sum() + smooth * len(raw)))


def fit_folds(docs: DataFrame, good: DataFrame, bits: int = 14, smooth: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fit_log_ratio` of all rows of ``good`` (doc_id, once each), and for each fold that of the other folds; texts are read once."""
    raw, *folds = fold_counts(docs, good.withColumn("fold", _fold(F.col("doc_id").cast("bigint"))), FOLDS, bits)
    whole = sum(folds)
    return _ratio(raw, whole, smooth), np.stack([_ratio(raw, whole - own, smooth) for own in folds])


def held_out_weights(docs: DataFrame, good: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, key_bits): the least log weight of each id of ``good`` by the model that its fold is held out of, as bits in its order. Texts stay where
    they are: every row is scored, as its fold is told by its id, and the ids of ``good`` are picked then."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for batch in batches:
            fold = np.asarray(batch.column("fold").fill_null(0))
            for i, j, data, off in slices(batch.column("text")):
                size = shared.value.shape[1]
                parts = hashed_features(data, off, int(np.log2(size)))
                parts = [(buckets + size * np.repeat(fold[i:j], np.diff(at)), at) for buckets, at in parts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(_ordered(document_sums(parts, shared.value.ravel())))],
                                                 names=["doc_id", "key_bits"])

    rows = texts(docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))).withColumn("fold", _fold(F.col("doc_id")))
    return (rows.mapInArrow(run, "doc_id bigint, key_bits bigint").join(good.select("doc_id"), "doc_id", "left_semi")
            .groupBy("doc_id").agg(F.min("key_bits").alias("key_bits")))


def _scores(data: np.ndarray, off: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = hashed_features(data, off, int(np.log2(len(ratio))))
    return sum(np.diff(at) for _, at in parts), document_sums(parts, ratio)


def _key(weight: np.ndarray, noise: np.ndarray, seed: int) -> np.ndarray:
    u = ((mix(noise.view(np.uint64) + np.uint64(seed)) >> np.uint64(12)).astype(np.float64) + 0.5) / 2**52
    return weight - np.log(-np.log(u))


def _ordered(key: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles."""
    bits = (key + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def score(docs: DataFrame, ratio: np.ndarray, seed: int = 0) -> DataFrame:
    """Rows: doc_id, n_features, log_weight, gumbel_key, key_bits and weight_bits (integers in the order of gumbel_key and log_weight)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch in batches:
            noise = np.asarray(batch.column("noise"))
            for i, j, data, off in slices(batch.column("text")):
                n, weight = _scores(data, off, shared.value)
                key = _key(weight, noise[i:j], seed)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(weight), pa.array(key), pa.array(_ordered(key)),
                                                  pa.array(_ordered(weight))],
                                                 names=["doc_id", "n_features", "log_weight", "gumbel_key", "key_bits", "weight_bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (texts(docs).withColumn("noise", F.xxhash64("doc_id"))
            .mapInArrow(run, f"doc_id {kind}, n_features bigint, log_weight double, gumbel_key double, key_bits bigint, weight_bits bigint"))


def kth_largest(scored: DataFrame, k: int) -> int:
    """The k-th largest ``key_bits`` of all rows (the smallest, if there are fewer), in four counting passes."""
    top, rest = 0, k
    for level, shift in enumerate((48, 32, 16, 0)):
        rows = scored if not level else scored.where(F.shiftright("key_bits", shift + 16) == top)
        found = rows.groupBy(F.shiftright("key_bits", shift).alias("b")).agg(F.count("*").alias("n")).collect()
        if not found:
            return 0
        for r in sorted(found, key=lambda r: -r.b):
            top = r.b
            if r.n >= rest:
                break
            rest -= r.n
    return top


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, keep_share: float = 0.9995, seed: int = 0, sample: int | None = None,
             cross: bool = False, **fit) -> tuple[DataFrame, np.ndarray, int]:
    """The scored rows with ``selected``, the fitted ratio, and the smallest selected key."""
    known = stage(split_labels(labels, sample), "resample-labels")
    if cross:
        ratio, others = fit_folds(docs, known, **fit)
    else:
        ratio = fit_log_ratio(docs, known.where("not held"), **fit)
    scored = stage(score(docs, ratio, seed), "resample")
    if k is None:
        held_out = (held_out_weights(docs, known, others) if cross else
                    scored.join(known.where("held").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("weight_bits").alias("key_bits")))
        held_out = stage(held_out, "resample-held")  # one weight an id
        n = held_out.count()
        least = kth_largest(held_out, n - int((1 - keep_share) * n)) if n else -(2**63)
        k = scored.where(F.col("weight_bits") >= least).count()
    cut = kth_largest(scored, k) if k else 2**63 - 1
    return scored.withColumn("selected", (F.col("key_bits") >= cut) & F.lit(k > 0)).drop("key_bits", "weight_bits"), ratio, cut


def keep_selected(docs: DataFrame, labels: DataFrame, seed: int = 0, **options) -> DataFrame:
    """``docs`` without the rows that :func:`resample` leaves out; scored again in place, so no text is shuffled."""
    _, ratio, cut = resample(docs, labels, seed=seed, **options)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    schema, n, at = docs.schema, len(docs.columns), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            noise, keep = np.asarray(batch.column(n)), []
            for i, j, data, off in slices(batch.column(at).fill_null("")):
                keep.append(_ordered(_key(_scores(data, off, shared.value)[1], noise[i:j], seed)) >= cut)
            mask = pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=schema.names).filter(mask)

    small_batches(docs.sparkSession)
    return docs.select("*", F.xxhash64("doc_id").alias(unused(docs, "_noise")[0])).mapInArrow(run, schema)
