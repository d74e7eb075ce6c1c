"""Fill-in-middle against cutting the list of units."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skyops.llm import infilling, queries


def plain(doc_id, text, seed=1, percent=90, spm_percent=20):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text or "")
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    if not units or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text or ""
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h[3] % 100 < spm_percent else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return doc_id, len(units), form, len(prefix), len(middle), out


TEXTS = st.text(alphabet=st.one_of(st.sampled_from("aZ é\n<PSM>1😀"), st.characters(blacklist_categories=["Cs"])), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXTS, st.integers(1, 40), st.floats(0, 1)), min_size=1, max_size=5))
def test_descent_reaches_every_rank(rows):
    texts = [t * k for t, k, _ in rows]
    bodies = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    lists = infilling.SkipLists(np.frombuffer(b"".join(bodies), np.uint8), off)
    units = [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert lists.units.tolist() == [len(u) for u in units]
    for rank in (np.array([int(share * len(u)) for u, (_, _, share) in zip(units, rows, strict=True)]), np.zeros(len(units), int), lists.units):
        heads = ["".join(u[:r]) for u, r in zip(units, rank, strict=True)]
        assert lists.descend(rank).tolist() == [[r, len(h), len(h.encode())] for r, h in zip(rank.tolist(), heads, strict=True)]


def test_lanes_of_a_long_text():
    text = "ab, é" * 30_000
    lists = infilling.SkipLists(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    assert len(lists.lanes) == 5 and all(w.sum(axis=0).tolist() == [120_000, 150_000, 180_000] for _, w in lists.lanes)
    assert [lists.descend(np.array([r]))[0].tolist() for r in (0, 1, 4, 119_999, 120_000)] == [[0, 0, 0], [1, 2, 2], [4, 5, 6], [119_999, 149_999, 179_998], [120_000, 150_000, 180_000]]


ROWS = [(1, None), (2, ""), (3, "one <M> mark"), (4, "x"), (5, "word " * 30_000), (6, "😀 é < S> <P <S"), (7, "\x00\n\t"), (None, "no id here"), (8, "twice"), (8, "twice"),
        *((i, f"Text number {i}, with {'é' * (i % 9)} and more words; <P") for i in range(10, 300))]


def test_texts(spark, make_docs):
    docs = make_docs(ROWS).withColumnRenamed("lang", "form").withColumnRenamed("source", "h1")
    got = infilling.fill_in_middle(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain(*r) for r in ROWS), key=str)
    back = got.select("doc_id", infilling.restored().alias("t")).collect()
    assert sorted((r.doc_id or 0, r.t) for r in back) == sorted((i or 0, t or "") for i, t in ROWS)
    forms = {r.form for r in got.collect()}
    assert forms == {"plain", "psm", "spm"} and infilling.fill_in_middle(docs.limit(0)).count() == 0
    assert sorted(map(tuple, infilling.fill_in_middle(docs, 7, 50, 50).collect()), key=str) == sorted((plain(*r, 7, 50, 50) for r in ROWS), key=str)


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT id doc_id, cast(unhex(concat('FF41C380', hex(id), '20FF')) AS string) text FROM range(10, 60)")
    both = infilling.fill_in_middle(docs).withColumn("back", infilling.restored()).join(docs, "doc_id").selectExpr("hex(back) = hex(text) same", "form").collect()
    assert len(both) == 50 and all(r.same for r in both) and {r.form for r in both} >= {"psm", "spm"}


def test_query(spark, make_docs, tmp_path):
    make_docs(ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = queries.op13_infilled(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [(*(p := plain(*r))[:5], sha(p[5]), sha(r[1] or "")) for r in ROWS]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
