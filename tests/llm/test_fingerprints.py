"""Fingerprints: locality of the parse, edited texts against plain Python, edge rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyops.llm import fingerprints as fp
from skyops.llm.words import mix

SF = "/root/testdata/sf0.001"


def flat(items):
    return np.frombuffer(b"".join(items), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)


def random_text(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(n)).encode()


def plain_edit(text, after):
    n = len(text) // 4
    return text[:len(text) - n] + after[:n] if n else text


def check(docs, parts=None):
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64(F.col("text").cast("binary"))).collect()
    rows = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id, r.h, r.text.encode()))]
    got = sorted(fp.fingerprint_edits(docs).collect(), key=lambda r: (r.doc_id, r.n_chars))
    assert len(got) == len(rows)
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        new = plain_edit(t, after)
        a, b, c = fp.signatures(*flat([t.encode(), new.encode(), after.encode()]))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fp.to_hex(a), fp.to_hex(b), fp.likeness(a, b), fp.likeness(a, c)))
    assert sorted(tuple(r) for r in got) == sorted(want)
    return got


def test_given_table(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sum(r.near_edited for r in got) / len(got) > 0.3 > 10 * 0.01 > sum(r.near_next for r in got) / len(got)


def test_edge_texts(make_docs):
    got = check(make_docs([None, "", "a", "aaaa", "é" * 9, "x" * 5000, "ab" * 4000, "abc", "same", "same", "𝒳𝒴𝒵𝒳 é" * 50, (20, "tie"), (20, "tie"), (20, "other"), (-5, "first")]))
    by_id = {r.doc_id: r for r in got}
    assert by_id[8].fingerprint == by_id[9].fingerprint and by_id[0].fingerprint == "" and by_id[0].near_next == 1.0


def test_single_and_no_rows(make_docs):
    check(make_docs(["only one text of a few words"]))
    assert fp.fingerprint_edits(make_docs(["a"]).limit(0)).count() == 0


def test_many_parts(spark, make_docs):
    r = random.Random(0)
    docs = make_docs([(r.randrange(10**6), random_text(r, r.randrange(0, 60)).decode()) for _ in range(300)]).withColumn("part", F.lit("x")).withColumn("halo", F.lit(9))
    check(docs)


def test_hot_ids_spread_over_ranges(spark):
    """With a third of the ids null and a third equal, no part holds more than twice its share, and rows follow each other in one order."""
    docs = spark.range(9000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 77).otherwise(F.col("id")).alias("doc_id"),
                                    F.concat(F.lit("text "), "id").alias("text"))
    rows = fp.with_successors(docs, parts=12).collect()
    sizes = {}
    for r in rows:
        sizes[r.part] = sizes.get(r.part, 0) + (r.halo == 0)
    assert sum(sizes.values()) == 9000 and max(sizes.values()) <= 2 * 9000 / 12
    assert sum(r.halo for r in rows) == len(sizes)
    order = [(r.key, r.spread, r.text) for r in sorted(rows, key=lambda r: (r.part, r.key, r.spread)) if not r.halo]
    assert order == sorted(order)
    ends = {p: min((r.key, r.spread) for r in rows if r.part == p and not r.halo) for p in sizes}
    parts = sorted(sizes)
    assert {r.part: (r.key, r.spread) for r in rows if r.halo} == {p: ends[parts[(i + 1) % len(parts)]] for i, p in enumerate(parts)}


def test_ranges_keep_the_order():
    r = np.random.default_rng(3)
    key, spread = r.integers(-5, 6, 5000), r.integers(-2**63, 2**63 - 1, 5000)
    part = fp.range_of(key, spread, np.array([-3, 0, 0, 0, 0, 2, 4, 4]))
    assert (np.diff(part[np.lexsort((spread, key))]) >= 0).all() and set(part.tolist()) == set(range(9))


def test_equal_substrings_share_interior_names():
    """A long passage has the same phrases in any surroundings and at any offset, but near its ends."""
    r = random.Random(7)
    for _ in range(20):
        passage = random_text(r, 200)
        texts = [random_text(r, r.randrange(1, 50)) + passage + random_text(r, r.randrange(1, 50)) for _ in range(2)]
        names, off = mix(np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)), np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])
        alone, own = mix(np.frombuffer(passage, np.uint8).astype(np.uint64) + np.uint64(1)), np.array([0, len(passage)])
        for _ in range(4):
            names, off = fp.parse(names, off)
            alone, own = fp.parse(alone, own)
            a, b = set(names[:off[1]].tolist()), set(names[off[1]:].tolist())
            assert len(a & b & set(alone.tolist())) >= len(set(alone.tolist())) - 8


def test_phrases_are_bounded_and_cover():
    r = np.random.default_rng(0)
    for alphabet in (2, 3, 30, 2**40):
        x = mix(r.integers(0, alphabet, 20_000).astype(np.uint64))
        keep = np.append(True, x[1:] != x[:-1])
        x = x[keep]
        names, off = fp.parse(x, np.array([0, len(x)]))
        assert len(x) / 16 < len(names) <= len(x) / 2 + 1 and off.tolist() == [0, len(names)]


def test_likeness_estimates_the_jaccard_index():
    r = np.random.default_rng(2)
    for share in (0.0, 0.3, 0.9):
        errors = []
        for _ in range(60):
            common, own = r.integers(0, 2**32, int(1000 * share)), [r.integers(0, 2**32, 1000 - int(1000 * share)) for _ in range(2)]
            a, b = (np.unique(np.concatenate([common, o]).astype(np.uint32)) for o in own)
            errors.append(fp.likeness(a[:32], b[:32]) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.05


def test_batches_do_not_matter():
    r = random.Random(1)
    texts = [random_text(r, r.randrange(0, 80)) for _ in range(30)]
    together = fp.signatures(*flat(texts))
    for t, s in zip(texts, together):
        assert (fp.signatures(*flat([t]))[0] == s).all()
    assert fp.edited("é".encode() * 8, b"") == "é".encode() * 6 and pytest.approx(1.0) == fp.likeness(together[1], together[1])
