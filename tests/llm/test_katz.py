"""Katz scores against a plain Python model, and sums of probabilities."""

from collections import Counter
from math import log10
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyops.llm import katz

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def brute(docs, top=10**9):
    """doc_id -> (held_out, tokens, known, base, score), N."""
    train = [words(t) for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for d in train for w in d)
    c["END"] = len(train)
    n, v = sum(c.values()), sum(x > 0 for x in c.values())
    symbols = {w for w, x in c.items() if x >= 2 and w != "END"}
    symbol = lambda w: w if w in symbols or w == "END" else "OTHER"
    uni = Counter({"END": len(train), "OTHER": 0, **{w: c[w] for w in symbols}})
    uni["OTHER"] = sum(x for w, x in c.items() if w != "END" and w not in symbols)
    other_n, other_v = uni["OTHER"], sum(w != "END" and w not in symbols for w in c)
    p = {w: (x + 0.5) / (n + 0.5 * len(uni)) for w, x in uni.items()}
    pairs = Counter()
    for d in train:
        s = ["START", *map(symbol, d), "END"]
        pairs.update(zip(s, s[1:]))
    of = Counter(pairs.values())
    left = 6 * of[6] / of[1] if of[1] else 1
    d = {}
    for r in range(1, 6):
        x = ((r + 1) * of[r + 1] / (r * of[r]) - left) / (1 - left) if of[r] and left < 1 else 1
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    follow = {}
    for (h, w), x in pairs.items():
        follow.setdefault(h, {})[w] = x
    prob = {}
    for h, f in follow.items():
        cut = sum((1 - d.get(x, 1)) * x for x in f.values())
        unseen = 1 - sum(p[w] for w in f)
        whole = len(f) == len(p)
        big = sum(f.values()) + (0 if cut or whole else 1)
        seen = {w: (x if whole else d.get(x, 1) * x) / big for w, x in f.items()}
        alpha = 0 if whole else (1 - sum(seen.values())) / unseen
        prob[h] = (seen, alpha)

    def pr(h, w):
        if h not in prob:
            return p[w]
        return prob[h][0].get(w, prob[h][1] * p[w])

    for h in list(prob)[:50]:
        assert sum(pr(h, w) for w in p) == pytest.approx(1)
    out = {}
    for i, t in docs:
        ws = words(t)
        s = ["START", *map(symbol, ws), "END"]
        score = sum(log10(pr(h, w)) for h, w in zip(s, s[1:]))
        score += sum(log10((c[w] + 0.5) / (other_n + 0.5 * (other_v + 1))) for w in ws if symbol(w) == "OTHER")
        base = sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, "END"])
        out[i] = (zlib.crc32(str(i).encode()) % 5 == 1, len(ws) + 1, sum(c[w] > 0 for w in [*ws, "END"]), base, score)
    return out, n


def check(docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, n = brute(rows)
    df = docs.withColumn("train", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)
    model = katz.fit(df, F.col("train"), **options)
    got = katz.score(df, model).collect()
    assert model.n == n and len(got) == len(rows)
    for r in got:
        held, tokens, known, base, score = want[r.doc_id]
        assert (not r.train, r.n_tokens, r.n_known) == (held, tokens, known)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_matches_plain_model(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 5000)
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_frequent_pairs_change_nothing(spark):
    """Pairs looked up by the broadcast or in their buckets, many buckets or few: the same scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for options in ({"max_frequent": 0, "least_buckets": 3}, {"max_frequent": 40, "least_buckets": 200}, {"max_frequent": 10**6}):
        check(docs, **options)


def test_sums_are_bounded_by_tokens(make_docs):
    """What the last shuffle holds does not grow with the buckets beyond an entry for each token."""
    docs = make_docs([f"w{i % 50} v{i % 7} u{i}" for i in range(2000)]).withColumn("train", F.lit(True))
    sizes = []
    for buckets in (16, 512, 4096):
        model = katz.fit(docs, F.col("train"), least_buckets=buckets, max_frequent=0)
        rows = katz.bucket_sums(docs, model).where("kind >= 0").agg(F.sum(F.length("sums")).alias("bytes"), F.max("kind").alias("kind")).first()
        sizes.append(rows.bytes)
    assert max(sizes) <= 8 * 2000 * 5  # four pairs and one class word a text
    assert sizes[2] < 1.2 * sizes[1]


def test_clashing_columns(make_docs):
    docs = make_docs(["a b a b", "a b", "c"])
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    want = {r.doc_id: r.score for r in katz.score(docs.withColumn("train", train), katz.fit(docs.withColumn("train", train), F.col("train"))).collect()}
    more = docs.withColumn("train", train).withColumns({c: F.lit("x") for c in ("bucket", "block", "keys", "n", "hash", "kind", "sums")})
    assert {r.doc_id: r.score for r in katz.score(more, katz.fit(more, F.col("train"))).collect()} == want


def test_edge_texts(make_docs):
    check(make_docs([None, "", " \t\n", "a", "a a a a", "A b a B", "a b c d e f g", "é É x", "a b", "a b", "w" * 5000, "a b c"]))


def test_no_training_rows_and_empty_table(spark, make_docs):
    docs = make_docs(["a b", "c"]).withColumn("train", F.lit(False))
    model = katz.fit(docs, F.col("train"))
    assert model.n == 0 and all(np.isfinite(r.score) for r in katz.score(docs, model).collect())
    none = docs.limit(0)
    assert katz.score(none, katz.fit(none, F.col("train"))).count() == 0


def test_vocabulary_bound_keeps_a_distribution(make_docs):
    """With a small vocabulary the class takes the other words; all words of all texts still count."""
    docs = make_docs(["a a a a b b b c c d", "a b c d e f", "b a", "d d d d"] * 3).withColumn("train", F.lit(True))
    model = katz.fit(docs, F.col("train"), max_vocabulary=2)
    a = model.shared.value
    assert len(a.vocabulary.counts) == 2 and a.n_other + a.vocabulary.counts.sum() + 12 == model.n
    pairs = {}
    for r in model.pairs.collect():
        pairs |= dict(zip(katz.unpack_sorted(bytes(r.keys)).tolist(), katz.unpack(bytes(r.counts)).tolist()))
    for h in range(len(a.log_alpha)):
        keys = np.array([(h << katz.ID_BITS) | w for w in range(len(a.log_p))])
        total = (10 ** a.pair_log(keys, np.array([pairs.get(k, 0) for k in keys.tolist()]))).sum()
        assert total == pytest.approx(1)


def test_no_word_is_cut(make_docs):
    """More words than were ever kept together, all seen twice: each has its own pairs, as history and as follower."""
    words = [f"w{i}" for i in range(134_000)]
    texts = [" ".join(words[i: i + 1000]) for i in range(0, len(words), 1000)]
    check(make_docs([*((5 * i, t) for i, t in enumerate(texts + texts)), (7, "w1 w2 w9 w133999 new")]))


def test_shared_words_change_nothing(spark, make_docs, monkeypatch):
    """Words looked up by the broadcast or in their buckets, many buckets or few: the same scores."""
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for options in ({"max_shared": 0}, {"max_shared": 5, "bucket_words": 40, "max_frequent": 0}, {"max_shared": 100, "least_buckets": 3}):
        check(docs, **options)
    check(make_docs([None, "", "a", "a a a a", "A b a B", "b a", "a b a b", "c"]), max_shared=0)


def test_scores_of_encoded_texts(make_docs):
    """The encoded texts of the fit give what reading the texts again gives."""
    docs = make_docs([None, "a b a b c", "a b", "c d c", "e a"]).withColumn("train", F.col("doc_id") < 4)
    model = katz.fit(docs, F.col("train"), max_shared=1)
    assert sorted(katz.score(docs, model).collect()) == sorted(katz.score(docs, model, model.encoded).collect())


def test_packing():
    for v in (np.array([], np.int64), np.array([0]), np.array([5, 300, 2**40]), np.arange(1000)):
        assert (katz.unpack(katz.pack(v)) == v).all() and (katz.unpack_sorted(katz.pack_sorted(v)) == v).all()


def brute_triples(docs):
    """doc_id -> score by triples, and the sum of probabilities of some histories."""
    train = [words(t) for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for d in train for w in d)
    symbols = {w for w, x in c.items() if x >= 2}
    uni = Counter({"END": len(train), "OTHER": sum(x for w, x in c.items() if w not in symbols), **{w: c[w] for w in symbols}})
    other_n, other_v = uni["OTHER"], sum(w not in symbols for w in c)
    n = sum(uni.values())
    p = {w: (x + 0.5) / (n + 0.5 * len(uni)) for w, x in uni.items()}

    def chain(ws):
        return ["START", *(w if w in symbols else "OTHER" for w in ws), "END"]

    pairs, triples = Counter(), Counter()
    for s in map(chain, train):
        pairs.update(zip(s[:-1], s[1:]))
        triples.update(zip(zip(s[:-2], s[1:-1]), s[2:]))

    def level(counts, lower):
        of = Counter(counts.values())
        left = 6 * of[6] / of[1] if of[1] else 1
        d = {}
        for r in range(1, 6):
            x = ((r + 1) * of[r + 1] / (r * of[r]) - left) / (1 - left) if of[r] and left < 1 else 1
            d[r] = x if 0 < x < 1 else (r - 0.5) / r
        follow = {}
        for (h, w), x in counts.items():
            follow.setdefault(h, {})[w] = x
        model = {}
        for h, f in follow.items():
            unseen = 1 - sum(lower(h, w) for w in f)
            whole = unseen < 1e-12
            cut = 0 if whole else sum((1 - d.get(x, 1)) * x for x in f.values())
            big = sum(f.values()) + (0 if cut or whole else 1)
            seen = {w: (x if whole else d.get(x, 1) * x) / big for w, x in f.items()}
            model[h] = seen, 0 if whole else (1 - sum(seen.values())) / unseen
        return lambda h, w: model[h][0].get(w, model[h][1] * lower(h, w)) if h in model else lower(h, w)

    two = level(pairs, lambda h, w: p[w])
    three = level(triples, lambda h, w: two(h[1], w))
    for h in [h for h, _ in list(triples)[:40]] + [("END", "OTHER")]:
        assert sum(three(h, w) for w in p) == pytest.approx(1)
    out = {}
    for i, t in docs:
        s = chain(words(t))
        score = log10(two(s[0], s[1])) + sum(log10(three((g, h), w)) for g, h, w in zip(s, s[1:], s[2:]))
        out[i] = score + sum(log10((c[w] + 0.5) / (other_n + 0.5 * (other_v + 1))) for w in words(t) if w not in symbols)
    return out


def check_triples(docs, **options):
    want = brute_triples([(r.doc_id, r.text) for r in docs.collect()])
    df = docs.withColumn("train", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)
    model = katz.fit(df, F.col("train"), order=3, **options)
    got = katz.score(df, model, model.encoded).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, rel=1e-9) and len(got) == len(want)
    return df, model, got


def test_triples_match_plain_model(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 5000)
    check_triples(spark.read.parquet(f"{SF}/documents.parquet"))


def test_frequent_triples_change_nothing(spark, monkeypatch):
    """Triples, histories, pairs and words looked up by the broadcasts or in their buckets, many buckets or few: the same scores."""
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for options in ({"max_histories": 0, "least_buckets": 3}, {"max_histories": 60, "max_triples": 20, "max_shared": 40, "max_frequent": 300, "bucket_words": 40},
                    {"max_histories": 10**6, "max_triples": 10**6, "least_buckets": 40}, {"max_triples": 0, "max_shared": 0, "max_frequent": 0}):
        check_triples(docs, **options)


def test_triples_of_edge_texts(make_docs):
    docs = make_docs([None, "", " \t\n", "a", "a a a a", "A b a B", "a b c d e f g", "é É x", "a b", "a b", "w" * 5000, "a b c", "a b c", "c b a b"])
    for options in ({}, {"max_shared": 0}, {"max_histories": 0}):
        check_triples(docs, **options)
    none = docs.limit(0).withColumn("train", F.lit(True))
    assert katz.score(none, katz.fit(none, F.col("train"), order=3)).count() == 0


def test_triples_of_other_texts(make_docs):
    """Texts read again score as the encoded ones; a text that the pairs can't tell from another is told by its triples."""
    texts = ["x a b", "y a c"] * 20 + ["x a c", "x a b"]
    docs = make_docs(texts).withColumn("train", F.col("doc_id") < 40)
    model = katz.fit(docs, F.col("train"), order=3)
    got = {r.doc_id: r for r in katz.score(docs, model).collect()}
    assert sorted(got.values()) == sorted(katz.score(docs, model, model.encoded).collect())
    assert got[41].score > got[40].score + 1  # "x a" is always followed by b; a alone by b and c alike


def test_op1_scores_by_triples(spark):
    from skyops.llm import queries
    want = brute_triples([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    assert {r.doc_id: r.score for r in queries.op1_katz_scores(spark, SF).collect()} == pytest.approx(want, rel=1e-9)


def test_packed_histories():
    for first in (0, 3):
        keys = np.unique((np.random.default_rng(first).integers(first, 9, 400) << katz.ID_BITS) | np.random.default_rng(1).integers(0, 2**30, 400))
        assert (katz.unpack_histories(katz.pack_histories(keys)) == keys).all()
    assert not len(katz.unpack_histories(katz.pack_histories(np.zeros(0, np.int64))))
