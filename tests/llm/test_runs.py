"""Periodic runs against a search of all periods, on words and on whole texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyops.llm import queries, runs
from skyops.llm.words import mix


def plain_runs(words, min_length=12):
    """(start, length, period) of every run: all periods, all maximal stretches, smallest periods alone."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            stretch = words[start: start + length]
            if i > start and length >= max(min_length, 2 * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sliced(texts, min_length=12):
    """``text_runs`` over the texts (lists of small numbers) as one slice."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = [[] for _ in texts]
    for t, *run in zip(*(x.tolist() for x in runs.text_runs(mix(np.array(sum(texts, []), np.uint64)), off, min_length)), strict=True):
        got[t].append(tuple(run))
    return got


def some_text(rng):
    n = rng.choice([0, 1, 11, 12, 13, 25, 60, 150])
    t = [rng.randint(1, rng.choice([1, 2, 2, 3, 5])) for _ in range(n)]
    for _ in range(rng.randint(0, 2) if n else 0):
        a = rng.randrange(n)
        p = rng.randint(1, 1 + (n - a) // 2)
        t = [w if i < a else t[a + (i - a) % p] for i, w in enumerate(t)]
        t[rng.randrange(n)] = 9
    return t


@pytest.mark.parametrize("seed", range(40))
def test_random_slices(seed):
    rng = random.Random(seed)
    texts = [some_text(rng) for _ in range(rng.randint(1, 8))]
    for least in (2, 5, 12):
        assert sliced(texts, least) == [plain_runs(t, least) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 2), max_size=40), max_size=4), st.sampled_from([2, 3, 4, 12]))
def test_all_small_texts(texts, least):
    assert sliced(texts, least) == [plain_runs(t, least) for t in texts]


def test_long_periodic_texts():
    n = 50_000
    assert sliced([[1] * n, [i % 7 for i in range(n)], list(range(n)) * 2, list(range(n))]) == [[(0, n, 1)], [(0, n, 7)], [(0, 2 * n, n)], []]


def test_fibonacci_words_and_nested_periods():
    a, b = [1], [1, 2]
    while len(b) < 400:
        a, b = b, b + a
    block = [3, 3, 3, 3, 4] * 3 + [5]
    assert sliced([b, block * 4, block * 2 + [3] * 20]) == [plain_runs(t) for t in (b, block * 4, block * 2 + [3] * 20)]


def dropped(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]


def test_texts(spark, make_docs):
    line = "the same line of ten words stands here three times "
    texts = {1: None, 2: "", 3: " \t\n", 4: line * 3, 5: "A a " * 6, 6: "a " * 11, 7: "a " * 12, 8: "é ü " * 20 + "x", 9: "x y z\x00 " * 9, 10: "word " * 20_000 + "end"}
    rows = [*texts.items(), (4, line * 3), (None, "a " * 12)]
    got = runs.find_runs(make_docs(rows).withColumnRenamed("lang", "runs").withColumnRenamed("source", "n_words")).collect()
    assert len(got) == len(rows)
    for r in got:
        words = (("a " * 12 if r.doc_id is None else texts[r.doc_id]) or "").replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        want = plain_runs(words) if len(words) < 1000 else [(0, 20_000, 1)]
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(words), want, " ".join(dropped(words, want)))
    assert runs.find_runs(make_docs(["a"]).limit(0)).count() == 0


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L doc_id, cast(unhex(repeat('FF20C320', 6)) AS string) text")
    row = runs.find_runs(docs).selectExpr("n_words", "runs", "hex(collapsed) c").first()
    assert (row.n_words, [tuple(x) for x in row.runs], row.c) == (12, [(0, 12, 2)], "FF20C3")


def test_query(spark, tmp_path, make_docs):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{x}" for x in some_text(rng))) for i in range(200)] + [(None, "a " * 30), (7, None)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = plain_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(dropped(words, found))))))
    got = queries.op11_word_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and sum(w[1] for w in want) > 50
