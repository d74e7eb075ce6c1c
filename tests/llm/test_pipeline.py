"""The pipeline against a plain composition, and its stages on edge rows."""

import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skyops.llm import decontamination
from skyops.llm.common import scratch

SF = "/root/testdata/sf0.01"


def run_stages(spark, docs, sf_dir):
    out = []
    for name, f in corpus_pipeline.STAGES:
        path = scratch(spark, f"test-{name}")
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_of_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality, near, clean, mixed, digest = run_stages(spark, docs, SF)
    assert all(x.columns == docs.columns for x in (quality, near, clean, mixed))
    counts = [x.count() for x in (docs, quality, near, clean, mixed, digest)]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0.6 * counts[0]
    # one row of each set of shingles stays
    sets = [frozenset(zip(*(w[i:] for i in range(5)))) or tuple(w) for w in (re.findall(rb"[^\x20\x09-\x0D]+", r.text.encode().lower()) for r in near.collect())]
    assert len(set(sets)) == len(sets)
    # the files hold the ids of the mixed texts, in order
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in digest.collect()}
    for r in mixed.orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        d = got[r.doc_id]
        assert (d.start, d.n_tokens, d.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_is_the_stages(spark):
    a = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    b = run_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)[-1]
    assert a == sorted(map(tuple, b.collect()))


def test_edge_rows_and_extra_columns(spark, make_docs):
    docs = make_docs([None, "", "a b", "q " * 30000, "A perfectly plain text of some words.", (4, "A perfectly plain text of some words.")])
    docs = docs.withColumn("key", F.lit(1)).withColumn("rate", F.lit("x")).withColumn("quality", F.lit(None).cast("int"))
    out = run_stages(spark, docs, "/root/testdata/sf0.001")
    assert out[3].columns == docs.columns


def test_stages_keep_values_of_clashing_columns_and_bytes(spark):
    """Columns with names that the stages might use inside keep their values; bytes that are not UTF-8 end no stage and stay where nothing is cut."""
    text = "concat('Some plain words that make one text of their own, number ', cast(id AS string), ', and more of them follow ', repeat(concat('word', cast(id AS string), ' '), 20), char(10))"
    bad = f"CASE WHEN id % 2 = 0 THEN cast(unhex(concat(hex({text}), 'FFC3')) AS string) ELSE {text} END"
    docs = spark.sql(f"SELECT id doc_id, {bad} text, 'en' lang, 's' source, 9L n_chars, concat('mine', id) _text_hash, id _noise, -id __noise, 'h' hash, 1 _hash, 2 _id FROM range(40)")
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: r for r in docs.selectExpr("*", "hex(text) h").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        rows = got.selectExpr("*", "hex(text) h").collect()
        assert rows and all(r == want[r.doc_id] for r in rows), name
    assert corpus_pipeline.token_files(spark, docs, sf).count() == 40


def test_cut_texts_with_bytes_that_are_not_utf8(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.sql(f"SELECT 1L doc_id, cast(unhex(concat(hex('clean start of a text with {item} and a long enough rest of words to stay in '), 'FF', hex(' it'))) AS string) text, 5L n_chars")
    items = spark.createDataFrame([("i", item)], "item_id string, text string")
    row = decontamination.remove_contamination(docs, items).first()
    assert row.text.split() == "clean start of a text with and a long enough rest of words to stay in \ufffd it".split() and row.n_chars == len(row.text)


def test_empty_tables_and_more(spark, make_docs):
    docs = make_docs(["a b c"]).withColumn("key", F.lit(1))
    assert all(x.count() == 0 for x in run_stages(spark, docs.limit(0), "/root/testdata/sf0.001"))
