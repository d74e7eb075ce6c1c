"""Resampling, mixing and toxicity: against plain computations, held-out accuracy, edge rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyops.llm import features, mixing, queries, resampling, toxicity

SF1, SF2 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
EDGES = [None, "", " \n", "one", "one one", "x" * 3000, "w " * 20000, "same text", "same text"]


def label_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n=120, seed=0):
    r = random.Random(seed)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    return [" ".join(r.choices(good if i % 4 else bad, k=r.randrange(20, 60))) for i in range(n)]


# importance resampling

def plain_features(text):
    w = (text or "").encode().lower().split()
    return [("w", x) for x in w] + [("p", "same" if a == b else (a, b)) for a, b in zip(w, w[1:])]


def test_log_weight_is_the_ratio_of_the_two_models(spark, make_docs):
    """With far more buckets than features nearly all hashed counts are plain counts."""
    texts = corpus() + EDGES
    docs = make_docs(texts)
    target = np.array([i for i in range(120) if i % 4 and i % 3], np.int64)
    ratio = resampling.fit_log_ratio(docs, target, bits=20)
    raw, good = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(plain_features(t))
        if i in set(target.tolist()):
            good.update(plain_features(t))
    size, scale = 1 << 20, sum(good.values()) / sum(raw.values())
    g, q = sum(good.values()) + 0.5 * size, sum(raw.values()) * scale + 0.5 * size
    exact = 0
    for r in resampling.score(docs, ratio).collect():
        f = plain_features(texts[r.doc_id])
        want = sum(math.log((good[x] + 0.5) / g) - math.log((raw[x] * scale + 0.5) / q) for x in f)
        exact += r.log_weight == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert r.n_features == len(f) and r.log_weight == pytest.approx(want, abs=2)  # some five buckets are shared
    assert exact > 0.7 * len(texts)


def test_gumbel_top_k_is_exact_and_repeatable(spark, make_docs):
    docs = make_docs(corpus() + EDGES)
    labels = label_rows(spark, [(i, int(i % 4 > 0), 0) for i in range(0, 120, 2)])
    for k in (0, 1, 7, 100, 10**6):
        rows = resampling.resample(docs, labels, k=k)[0].collect()
        cut = sorted((r.gumbel_key for r in rows), reverse=True)[k - 1] if 0 < k <= len(rows) else (math.inf if not k else -math.inf)
        assert all(r.selected == (r.gumbel_key >= cut) for r in rows) and len(rows) == 129
    again = resampling.resample(docs.repartition(7), labels, k=7)[0]
    assert {r.doc_id for r in again.where("selected").collect()} == {r.doc_id for r in resampling.resample(docs, labels, k=7)[0].where("selected").collect()}


def test_gumbel_noise_samples_by_weight():
    key = resampling._key(np.repeat(np.log([1.0, 3.0]), 50_000), np.arange(100_000), 4)
    top = np.stack([key[:50_000], key[50_000:]]).argmax(0).mean()
    assert top == pytest.approx(0.75, abs=0.01)


def test_ordered_bits_follow_doubles():
    x = np.sort(np.concatenate([np.random.default_rng(0).normal(0, 1e3, 1000), [0.0, -0.0, 1e-300, -1e-300, np.inf, -np.inf]]))
    assert (np.diff(resampling._ordered(x)) >= 0).all() and resampling._ordered(np.array([0.0]))[0] == resampling._ordered(np.array([-0.0]))[0]


def test_clean_rows_stay_and_junk_goes(spark):
    docs, labels = spark.read.parquet(f"{SF2}/documents.parquet"), spark.read.parquet(f"{SF2}/labels.parquet")
    kept = resampling.keep_selected(docs.withColumn("log_weight", F.lit("x")), labels)
    rows = kept.join(labels, "doc_id").groupBy("quality").count().collect()
    total = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    share = {r.quality: r["count"] / total[r.quality] for r in rows}
    assert share[1] > 0.995 and share.get(0, 0) < 0.1 and kept.columns[-1] == "log_weight"


def test_resampling_without_labels_or_rows(spark, make_docs):
    docs, labels = make_docs(EDGES), label_rows(spark, [(0, 0, 0)]).limit(0)
    assert resampling.keep_selected(docs, labels).count() == len(EDGES)
    assert resampling.resample(docs.limit(0), labels)[0].count() == 0


def test_all_labelled_rows_fit_the_target(spark, make_docs):
    """Each good row has a word of its own, whose weight tells whether the row is one of the target model's: four fifths are, however many there are."""
    n = 25_000
    docs, labels = make_docs([f"u{i}" for i in range(n)]), spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    scored, _, _ = resampling.resample(docs, labels, bits=20)
    assert scored.where("log_weight > 0").count() / n == pytest.approx(0.8, abs=0.02)  # some two per cent share a bucket


def test_the_cut_is_that_of_the_held_out_rows(spark, make_docs):
    docs = make_docs(corpus(600))
    labels = label_rows(spark, [(i, int(i % 4 > 0), 0) for i in range(600)])
    held = {r.doc_id for r in resampling.split_labels(labels).where("held").collect()}
    for share in (0.9, 0.5, 1.0):
        rows = resampling.resample(docs, labels, keep_share=share)[0].collect()
        weights = sorted(r.log_weight for r in rows if r.doc_id in held)
        least = weights[int((1 - share) * len(weights))]
        assert sum(r.selected for r in rows) == sum(r.log_weight >= least for r in rows)


def test_crossed_rows_all_fit_and_all_set_the_cut(spark, make_docs):
    """Every good row is in the target model; each one's weight at the cut is that of a model fitted without its fifth."""
    texts = corpus(300)
    docs, labels = make_docs([*enumerate(texts), (4, texts[5]), (None, "g1 g2")]), label_rows(spark, [(i, int(i % 4 > 0), 0) for i in range(300)])
    good = resampling.split_labels(labels)
    ratio, others = resampling.fit_folds(docs, good)
    assert np.allclose(ratio, resampling.fit_log_ratio(docs, good))
    fold = {r.doc_id: r.fold for r in good.withColumn("fold", resampling._fold(F.col("doc_id"))).collect()}
    want = {}
    for k in range(resampling.FOLDS):
        rest = np.array([i for i, f in fold.items() if f != k], np.int64)
        assert np.allclose(others[k], resampling.fit_log_ratio(docs, rest))
        for r in resampling.score(docs, others[k]).collect():
            if fold.get(r.doc_id) == k:
                want[r.doc_id] = min(want.get(r.doc_id, math.inf), r.log_weight)
    bits = {r.doc_id: r.key_bits for r in resampling.held_out_weights(docs, good, others).collect()}
    got = resampling._ordered(np.array(list(bits.values())).view(float)).view(float)  # the bits are their own inverse's
    assert dict(zip(bits, got)) == pytest.approx(want, abs=1e-9) and sorted(bits) == sorted(fold)
    for share in (0.9, 1.0):
        rows = resampling.resample(docs, labels, keep_share=share, cross=True)[0].collect()
        least = sorted(want.values())[int((1 - share) * len(want))]
        assert sum(r.selected for r in rows) == sum(r.log_weight >= least for r in rows)


def test_the_pipeline_fits_on_all_good_rows(spark, make_docs, monkeypatch):
    """Each good row has a word of its own, whose weight tells whether the row is one of the target model's."""
    import corpus_pipeline
    docs, labels = make_docs([f"u{i}" for i in range(500)]), spark.range(250).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels)
    seen, fitted = [], resampling.resample
    monkeypatch.setattr(resampling, "resample", lambda *a, **k: seen.append(fitted(*a, **k, bits=20)) or seen[-1])
    corpus_pipeline.quality(spark, docs, "").count()
    assert seen[0][0].where("log_weight > 0").count() >= 249  # four fifths of the 250, were a fifth held out
    assert resampling.resample(docs.limit(0), labels, cross=True)[0].count() == 0
    assert resampling.keep_selected(docs, labels.limit(0), cross=True).count() == 500


def test_joined_counts_are_those_of_the_ids(spark, make_docs):
    docs = make_docs([*enumerate(corpus(30) + EDGES), (3, "g1 again"), (None, "no id"), (None, None)])
    ids = spark.createDataFrame([(3,), (3,), (7,), (31,), (99,), (None,)], "doc_id long")
    assert (features.joined_counts(docs, ids, 12) == features.class_counts(docs, [np.array([3, 7, 31, 99])], 12)).all()


# mixing

def test_rates_reach_feasible_targets(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    members, model, rates = mixing.fit_mixture(docs, labels, shares=queries.MIX_SHARES)
    rows = mixing.with_rates(members, rates).toPandas()
    p = rows[[f"p_{n}" for n in model.names]].to_numpy()
    assert np.allclose(p.sum(1), 1) and (rows["rate"] >= 0).all() and len(rows) == docs.count()
    got = (rows["rate"] * rows["n_tokens"]).to_numpy() @ p
    assert np.allclose(got, rates.got) and np.abs(got - rates.target).max() <= 1e-4 * rates.target.sum() and rates.gap <= 1e-4


def test_rates_minimise_the_squares(spark):
    """Against projected gradient in plain numpy on an infeasible problem, run to the end."""
    r = np.random.default_rng(1)
    p, n = r.dirichlet([1, 1], 40), r.integers(1, 100, 40)
    members = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in zip(n, p)], "n_tokens long, p_x double, p_y double")
    target = {"x": 0.0, "y": 3000.0}
    with pytest.warns(UserWarning, match="not settled"):
        mixing.fit_rates(members, ["x", "y"], target, tolerance=0.0, max_steps=10)
    rates = mixing.fit_rates(members, ["x", "y"], target, tolerance=1e-3)
    assert rates.gap > 0.01
    capped = mixing.fit_rates(members, ["x", "y"], target, tolerance=1e-3, top=1.0)
    assert capped.of(p).max() <= 1.0 and capped.of(p).min() >= 0.0
    s, t = n @ p, np.array([0.0, 3000.0])
    x = np.ones(40)
    for _ in range(200_000):
        x = np.maximum(0, x - 0.5 * p @ (((n * x) @ p - t) / s))
    loss = lambda v: (((n * v) @ p - t) ** 2 / s).sum()
    most = np.ones(40)
    for _ in range(50_000):
        most = np.clip(most - 0.5 * p @ (((n * most) @ p - t) / s), 0, 1)
    assert loss(capped.of(p)) <= loss(most) + 0.005 * loss(np.ones(40))
    assert loss(rates.of(p)) <= loss(x) + 0.005 * loss(np.ones(40)) and (rates.of(p) >= 0).all()


def test_mixture_edges(spark, make_docs):
    docs = make_docs(corpus() + EDGES).withColumn("rate", F.lit("r")).withColumn("n_tokens", F.lit(0))
    labels = label_rows(spark, [(i, int(i % 4 > 0), 0) for i in range(60)])
    members, model, rates = mixing.fit_mixture(docs, labels, factors={"quality0_toxic0": 0.0})
    rows = {r.doc_id: r for r in mixing.with_rates(members, rates).collect()}
    assert rows[120].n_tokens == 0 and rows[120].p_quality1_toxic0 == pytest.approx(0.75, abs=1e-6)
    out = mixing.mix_documents(docs, model, rates, at_most_once=True)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept >= {i for i in range(120) if i % 4} and not kept & {i for i in range(0, 120, 4)}
    none = label_rows(spark, [(1, 1, 1)]).limit(0)
    _, model, rates = mixing.fit_mixture(docs, none, shares={"all": 1.0})
    assert model.names == ["all"] and mixing.mix_documents(docs, model, rates).count() == docs.count()
    members, _, rates = mixing.fit_mixture(docs.limit(0), labels, shares={"quality0_toxic0": 1.0})
    assert mixing.with_rates(members, rates).count() == 0


def test_features_do_not_cross_documents(spark, make_docs):
    counts = features.class_counts(make_docs(["a b", "c d"]), [np.array([1])], 16)
    assert counts[0].sum() == 6 and counts[1].sum() == 3


# toxicity

def brute_kernel(s, t):
    """Sum over pairs of equal subsequences of ORDER characters of DECAY ** (span in s + span in t)."""
    from itertools import combinations
    total = 0.0
    for i in combinations(range(len(s)), toxicity.ORDER):
        for j in combinations(range(len(t)), toxicity.ORDER):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def rows(words):
    return np.frombuffer(b"".join(w.ljust(toxicity.LENGTH, b"\0") for w in words), np.uint8).reshape(-1, toxicity.LENGTH)


def test_kernel_matches_brute_force():
    r = random.Random(3)
    s = ["".join(r.choices("abcd", k=r.randrange(0, 10))).encode() for _ in range(60)]
    t = ["".join(r.choices("abcd", k=r.randrange(0, 10))).encode() for _ in range(60)]
    assert toxicity.kernel(rows(s), rows(t)) == pytest.approx([brute_kernel(a, b) for a, b in zip(s, t)], rel=1e-4, abs=1e-6)


def test_gaps_and_inserted_characters_keep_a_likeness():
    marks = toxicity.Landmarks([b"worthless", b"idiot"])
    data = "a w.o.r.t.h.l.e.s.s thing|i d i o t s|theraneat ouonst".encode()
    off = np.array([0, data.index(b"|") + 1, data.rindex(b"|") + 1, len(data)])
    x = marks.of_texts(np.frombuffer(data.replace(b"|", b" "), np.uint8), off)
    assert x[0, 0] > 0.1 and x[1, 1] > 0.6 and x[2].max() < 0.1


def test_kernel_values_are_exact_for_dropped_and_replaced_letters():
    words = [b"pathetic", b"stupid", b"loser", b"idiot", b"worthless"]
    strings = [b"pathtic", b"stupd", b"stpid", b"st*pid", b"loer", b"l0ser", b"idxiot", b"wrthles", b"", b"ab", b"abcdefghijklmnopqrstuvwx", *words]
    r = random.Random(5)
    strings += ["".join(r.choices("abdehiloprstuw", k=r.randrange(0, 14))).encode() for _ in range(80)]
    want = [[brute_kernel(t, s) / (brute_kernel(t, t) * own) ** 0.5 if (own := brute_kernel(s, s)) else 0.0 for s in strings] for t in words]
    marks = toxicity.Landmarks(words)
    assert marks.table(rows(strings)).T == pytest.approx(np.array(want), rel=1e-4, abs=1e-6)
    data = b"a pathtic thing|st*pid stupd|nothing"
    off = np.array([0, 16, 29, len(data)])
    x = marks.of_texts(np.frombuffer(data.replace(b"|", b" "), np.uint8), off)
    assert x[0, 0] == pytest.approx(0.71, abs=0.01) and x[1, 1] == pytest.approx(0.68, abs=0.01) and x[2].max() < 0.1


def test_strings_of_long_words_and_letters():
    data = ("x" * 100 + " a b c dd é f g").encode()
    found, docs, ids = toxicity.strings(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    held = {found[i].tobytes().rstrip(b"\0") for i in ids.tolist()}
    assert {b"x" * 24, b"abc", "éfg".encode(), b"dd"} <= held and (docs == 0).all()


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    scored = queries.op10_toxicity(spark, SF2)
    got = scored.join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in got}
    assert share[1] > 0.8 and share[0] < 0.02
    assert scored.count() == 10_000 and scored.where("score is null or score < 0 or score > 1").count() == 0


def test_toxicity_edges(spark, make_docs):
    texts = [*EDGES, *["you idiot fool"] * 6, *["a fine day"] * 6]
    docs = make_docs(texts).withColumn("score", F.lit("s")).withColumn("label", F.lit(3))
    labels = label_rows(spark, [(i, 1, int(9 <= i < 15)) for i in range(9, 21)])
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values()) and got[9] > 0.5 > got[20] and got[0] == got[1] < 0.5
    for other in (labels.where("toxic = 1"), labels.where("toxic = 0"), labels.limit(0)):
        model = toxicity.fit_toxicity(docs, other)
        assert toxicity.score_toxicity(docs, model).select("score").distinct().count() == 1
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_repeated_ids_bring_no_more_rows(make_docs, spark):
    """An id that many rows share is one training row of the classifiers."""
    docs = make_docs([*((i, f"you are kind w{i % 9}" if i % 2 else f"you are a stupid idiot w{i % 9}") for i in range(60)), *((7, f"copy number {i}") for i in range(300))])
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")
    assert toxicity.training_rows(docs, labels, 50).count() == 50
    assert toxicity.training_rows(docs, labels, 500).count() == 60
    scored, _, _ = resampling.resample(docs, labels, sample=50)
    assert scored.count() == docs.count()
