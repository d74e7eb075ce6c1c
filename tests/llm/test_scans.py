"""License scan, decontamination and rotation: SQL parity on a given table, brute force and edge rows on small ones."""

import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from skyops.llm import decontamination, licenses, oracles, queries, rotation

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def sql(query, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    out = con.execute(query)
    names = [d[0] for d in out.description]
    return sorted((dict(zip(names, r)) for r in out.fetchall()), key=str)


def rows_of(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    df = queries.QUERIES[name](spark, SF)
    out = con.execute(oracles.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    assert got == sorted(out.fetchall(), key=str) and got


def write_tables(docs, path, **others):
    for name, df in {"documents": docs, **others}.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


LICENSES = [None, "", "...", "Released under the MIT License.", "MIT\nLicense, mit license", "Licensed under CC BY-NC 4.0.", "apache " * 70 + "license",
            "x " * 100 + "This work is licensed under the GNU General Public License, version 3." + " y" * 5000, "released the mit under license",
            "permission hereby granted free of charge to person obtaining a copy of this software and documentation files", "CC BY CC BY", "licence"]


def test_license_edges_match_sql(spark, make_docs, tmp_path):
    docs = make_docs([*LICENSES, LICENSES[3]]).withColumn("label", F.lit(1)).withColumn("matches", F.lit("x"))
    got = rows_of(queries.op2_license_scan(spark, write_tables(docs, tmp_path)))
    assert got == sql(oracles.OP2, documents=docs.toPandas())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["labels"] == "" and by_id[3]["base_labels"] == "mit" and by_id[5]["labels"] == "cc-by,cc-by-nc"
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert licenses.scan_licenses(docs, templates=[], phrases={}).where(F.size("matches") + F.size("places") > 0).count() == 0


def test_license_join_is_exact(make_docs):
    """Random templates and texts over few words: the filtered join covers what all windows at all starts cover."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = [(f"t{k}", " ".join(r.choices(vocabulary, k=r.randrange(1, 12)))) for k in range(25)]
    texts = [" ".join(r.choices(vocabulary, weights=[1 / (i + 1) for i in range(30)], k=r.randrange(0, 60))) for _ in range(60)]
    for threshold in (0.5, 0.8, 1.0):
        got = {row.doc_id: row.matches for row in licenses.scan_licenses(make_docs(texts), templates, {}, threshold, slack=1.6).collect()}
        for i, t in enumerate(texts):
            w = t.split()
            for k, (label, template) in enumerate(templates):
                own, width = set(template.split()), -(-16 * len(template.split()) // 10)
                windows = {s: len(own & set(w[s: s + width])) for s in range(len(w))}
                hit = {p for s, n in windows.items() if n >= threshold * len(own) - 1e-9 for p in range(s, min(s + width, len(w))) if w[p] in own}
                mine = [m for m in got[i] if m.template == k]
                assert {p for m in mine for p in range(m.first, m.end) if w[p] in own} == hit
                assert {m.label for m in mine} <= {label}
                if mine:
                    assert max(m.containment for m in mine) == max(windows.values()) / len(own)
                    assert all(x.end <= y.first for x, y in zip(mine[:-1], mine[1:], strict=True))


def test_verbatim_templates_are_found_at_every_start(make_docs):
    templates = [(f"t{n}", " ".join(f"a{n}x{i % (n - 1)}" for i in range(n))) for n in (5, 17, 50, 64, 80, 129, 200)]
    texts, want = [], []
    for label, t in templates:
        for start in range(0, 70, 1):
            texts.append(" ".join([*(f"z{i}" for i in range(start)), t, *(f"y{i}" for i in range(start % 7))]))
            want.append((label, start, start + len(t.split()), 1.0))
    rows = licenses.scan_licenses(make_docs(texts), templates, {}).collect()
    assert {r.doc_id: [(m.label, m.first, m.end, m.containment) for m in r.matches] for r in rows} == {i: [w] for i, w in enumerate(want)}


def test_template_bound(make_docs):
    with pytest.raises(ValueError):
        licenses.scan_licenses(make_docs(["a"]), [("x", "a b c")], {}, max_template_words=2)


def brute_hits(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(window, len(v))
        grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found), hit


def random_bench(seed):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(6)]
    items = [(k, " ".join(r.choices(v, k=r.randrange(0, 25)))) for k in range(12)]
    docs = [" ".join(r.choices(v + ["zz"], k=r.randrange(0, 80))) for _ in range(40)]
    docs += [f"Qq, {r.choice(items)[1].upper()}; {r.choice(items)[1]} zz" for _ in range(30)]
    return items, docs


@pytest.mark.parametrize("seed,window", [(1, 10), (2, 5), (3, 3), (4, 1)])
def test_contamination_matches_brute_force(spark, make_docs, seed, window):
    items, docs = random_bench(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontamination.find_contamination(make_docs(docs), bench, window).collect():
        n, hits, found, at = brute_hits(docs[r.doc_id], items, window)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hits, found)
        assert {i for s in r.spans for i in range(s.first, s.end)} == at
        for s in r.spans:
            assert words(docs[r.doc_id][s.char_first:s.char_end]) == words(docs[r.doc_id])[s.first:s.end]


def test_contamination_edges(spark, make_docs, tmp_path):
    long = "é " * 9 + "x, y. z " * 4
    docs = make_docs([None, "", "!!", long, "A b", "a-b c", "q " * 3000 + long, (3, long), (3, long)]).withColumn("items", F.lit(0)).withColumn("spans", F.lit(0))
    bench = spark.createDataFrame([(1, long), (1, long), (2, "a B"), (3, ""), (4, None), (None, "a-b c"), (10, long + " tail")], "item_id long, text string")
    got = rows_of(queries.op4_benchmark_hits(spark, write_tables(docs, tmp_path, benchmark=bench)))
    want = sql(oracles.OP4, documents=docs.where("doc_id <> 3").toPandas(), benchmark=bench.toPandas().astype({"item_id": "Int64"}))
    assert [r for r in got if r["doc_id"] != 3] == want
    assert decontamination.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        decontamination.automaton_of(bench, max_chars=5)


def test_spans_are_cut_out(spark, make_docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    clean = "nothing é here to cut at all, one two three"
    dirty = clean + "! One two THREE four five six seven eight, nine ten. " + clean * 2
    docs = make_docs([clean, dirty, "one two three four five six seven eight nine ten", None]).withColumn("extra", F.lit("x"))
    got = {r.doc_id: r for r in decontamination.remove_contamination(docs, bench).collect()}
    assert sorted(got) == [0, 1, 3] and got[0].text == clean and got[3].text is None and got[3].n_chars is None
    assert got[1].text == clean + "! . " + clean * 2 and got[1].n_chars == len(got[1].text) and got[1].extra == "x"


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_rotation_edges_match_sql(spark, tmp_path):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "eve", "é"), (1, 3, None, "who"), (1, 1, "ann", "hi"), (2, 0, "system", "alone"),
            (None, 0, "ann", "x"), (None, None, "bob", ""), (4, 5, "user", "y" * 5000)] + [(3, i, "ab"[i % 2], f"t{i}") for i in range(200)] + [(5, 1, "a", f"m{i}") for i in range(900)]
    df = turns(spark, rows).withColumn("speaker", F.lit(1)).withColumn("part", F.lit("p"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(queries.op5_perspectives(spark, str(tmp_path)))
    want = sql(oracles.OP5, conversations=df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert [{k: str(v) for k, v in sorted(r.items())} for r in got] == [{k: str(v) for k, v in sorted(r.items())} for r in sorted(want, key=lambda x: str({k: x[k] for k in got[0]}))] or \
        sorted(tuple(sorted((k, str(v)) for k, v in r.items())) for r in got) == sorted(tuple(sorted((k, str(v)) for k, v in r.items())) for r in want)
    assert {r["conv_id"] for r in got} == {1, None, 3, 4, 5}
    assert max(r["n_messages"] for r in got) <= 256


def test_masks_cover_the_speaker_alone(spark):
    said = [(1, 0, "ann", "hello"), (1, 1, "bob", "yo"), (1, 2, "ann", "bye")]
    for r in rotation.rotate(turns(spark, said)).collect():
        parts = [r.text[m.first:m.end] for m in r["mask"]]
        assert parts == [t + rotation.END for _, _, who, t in said if who == r.speaker]
        assert r.text.count("assistant\n") == r.n_trained


def test_rotation_stays_in_the_jvm(spark):
    plan = rotation.rotate(turns(spark, [(1, 0, "a", "b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert rotation.rotate(turns(spark, [(1, 0, "a", "b")]).limit(0)).count() == 0
