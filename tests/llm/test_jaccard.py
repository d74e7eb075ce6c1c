"""Near-duplicate groups against brute force over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skyops.llm import jaccard
from skyops.llm.components import components

SF = "/root/testdata/sf0.001"


def brute(rows, n=5, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return sorted((k, len(s), min(least[find(i)])) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def check(docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, **options).collect())
    assert got == brute(rows)
    return got


def families(seed, groups=12, copies=14):
    """Chains of edits (each near its neighbour, not near all), copies, and strangers that share a long passage."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(4000)
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(groups):
        text = [word() for _ in range(r.randrange(5, 150))]
        for _ in range(r.randrange(1, copies)):
            out.append(" ".join(text))
            for _ in range(r.randrange(0, 3)):
                at = r.randrange(len(text))
                text = text[:at] + [word()] * r.randrange(0, 3) + text[at + 1:]
        out.append(" ".join(passage + [word() for _ in range(r.randrange(3, 80))]))
        out.append(out[-1])
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_families_match_brute_force(make_docs, seed):
    check(make_docs(families(seed)), tile=4, slots=1 << 10)


def test_given_table(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert any(i != c for i, _, c in got)


@pytest.mark.parametrize("tile", [3, 2048])
def test_every_link_between_different_classes(make_docs, tile):
    """All pairs of a group of near copies, not only those that join it."""
    base = ["v%d" % i for i in range(100)]
    texts = [" ".join(base[:-k or None] + ["t%d" % j for j in range(k)]) for k in range(0, 16, 2)] + families(4, groups=3, copies=6) + ["", "a b"]
    members, links = jaccard.similar_classes(make_docs(texts), tile=tile)
    key = {r.doc_id: r.class_key for r in members.collect()}
    want = set()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if key[i] is not None and key[j] is not None and key[i] < key[j] and len({c for _, _, c in brute([(0, a), (1, b)])}) == 1:
                want.add((key[i], key[j]))
    got = [(r.a, r.b) for r in links.collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want


def test_edge_texts(make_docs):
    check(make_docs([None, "", "  ", "a b", "a b", "A  B", "a b c d e", "a b c d e f", "x " * 3000, "x " * 9, "a", "b", "a b c d", "Eé é"]))


def test_links_missed_by_the_first_centres(make_docs):
    """Near copies that link with each other but not with the smallest class of their run."""
    base = ["v%d" % i for i in range(100)]
    tail = [f"t{i}" for i in range(12)]
    check(make_docs([" ".join(x) for x in (base, base + tail[:9], base + tail[:18], base[5:] + tail, base[10:] + tail, base[20:] + tail * 2)]), tile=2)


def test_empty_table_and_one_row_per_group(make_docs):
    docs = make_docs([(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, None), (8, ""), (2, "q w e r t y")])
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0
    wide = docs.withColumn("component_id", F.lit(1)).withColumn("key", F.lit("x"))
    kept = jaccard.keep_one(wide)
    assert kept.columns == wide.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 8, 9]


def test_null_and_repeated_ids_name_no_common_group(make_docs):
    """Unrelated texts stay, whether their doc_id is null or one and the same; copies under them go."""
    texts = ["a b c d e f", "q w e r t y", "z x c v b n", "one two three four five six"]
    docs = make_docs([(None, t) for t in texts[:3]] + [(None, texts[0])] + [(7, t) for t in texts[3:]] + [(7, "h j k l m n"), (7, "h j k l m n"), (9, "H j k l m n"),
                                                                                          (None, texts[3]), (None, None), (7, None)])
    kept = sorted((r.doc_id or 0, r.text or "") for r in jaccard.keep_one(docs).collect())
    assert kept == sorted([(0, t) for t in texts[:3]] + [(7, texts[3]), (7, "h j k l m n"), (0, ""), (7, "")])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (600, 600)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 500: 500, 501: 500}


def test_bitmaps_bound_the_overlap():
    import numpy as np
    r = np.random.default_rng(0)
    for _ in range(50):
        x = np.unique(r.integers(0, 2**63, r.integers(1, 900)).astype(np.uint64))
        y = np.unique(np.concatenate([x[: r.integers(0, len(x) + 1)], r.integers(0, 2**63, r.integers(1, 900)).astype(np.uint64)]))
        p, q = (np.frombuffer(jaccard.bitmap(v), np.uint64) for v in (x, y))
        m = min(len(p), len(q))
        differing = int(np.bitwise_count(jaccard.fold(p, m) ^ jaccard.fold(q, m)).sum())
        assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - differing) // 2
