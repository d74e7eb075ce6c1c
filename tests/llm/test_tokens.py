"""Token files against direct encoding of whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyops.llm import tokens
from skyops.llm.common import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def written(spark, docs, **options):
    path = scratch(spark, "test-tokens")
    tokens.write_token_orc(docs, path, PATH, **options)
    return tokens.read_token_orc(spark, path), path


def encoded(pieces, texts):
    """Ids of each text of a slice as bytes, without the end id."""
    bodies = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    ids, n = pieces.encode(np.frombuffer(b"".join(bodies), np.uint8), off, 1)
    parts = np.split(ids, np.cumsum(n)[:-1])
    assert all(p[-1] == 1 for p in parts)
    return [p[:-1].astype("<u4").tobytes() for p in parts]


def check(spark, docs, tokenizer):
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = [(r.doc_id, bytes(r.t).decode(errors="replace")) for r in docs.select("doc_id", text.alias("t")).orderBy(F.asc_nulls_first("doc_id"), F.xxhash64(text), text).collect()]
    got, _ = written(spark, docs)
    ids = sorted(((r.part, r.local_start, r.doc_id, r.ids) for r in got.collect()), key=lambda r: r[:2])
    want, start = [], 0
    for i, t in rows:
        own = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for _, _, i, x in ids] == [(i, n, c) for i, _, n, c in want]
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_digest(got).collect()), key=lambda r: r[1]) == want


def test_given_table(spark, tokenizer):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"), tokenizer)


def test_edge_texts(spark, make_docs, tokenizer):
    check(spark, make_docs([(4, None), (2, ""), (9, " \t\n "), (1, "<|endoftext|> X<|ENDOFTEXT|>a"), (7, "it's DON'T we'll 'S o'"), (3, "x" * 200), (3, "again"), (3, "again"),
                            (8, "é É, café!  nb sp İI ΣΣ ﬁ 12345 a1b2 ,,;; a×b ÷"), (5, "word " * 20000)]), tokenizer)


def test_hot_and_null_ids_spread_over_tasks(spark, make_docs, tokenizer):
    docs = make_docs([(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i}") for i in range(1500)], 8)
    check(spark, docs, tokenizer)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    got, _ = written(spark, docs)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in got.groupBy("part").count().collect()]
    assert max(sizes) <= 2 * 1500 / 8


def test_bytes_that_are_not_utf8(spark, tokenizer):
    check(spark, spark.sql("SELECT id doc_id, cast(unhex(concat('41FF42', '20C3', '20', hex(id), 'C3A9')) AS string) text, 1 part, 'x' ids FROM range(40, 50)"), tokenizer)


@pytest.mark.parametrize("bits", [1, 4, 20])
def test_small_tables(monkeypatch, tokenizer, bits):
    monkeypatch.setattr(tokens, "SLOT_BITS", bits)
    pieces = tokens.PieceIds(PATH)
    pieces.store = pieces.store[:40]  # outgrown and cleared again and again
    texts = [f"Word{i % 7} Émile's thing{i}, (thing{i % 3}) {'y' * 60} été! a1 été ß ÿ É" for i in range(40)]
    for k in range(0, 40, 5):
        assert encoded(pieces, texts[k: k + 5]) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[k: k + 5]]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces, whole = tokens.PieceIds(path), Tokenizer.from_file(path)
    texts = ["Some  text\n with SPACES, it's kept.", "", "é  É"]
    assert not pieces.by_pieces and tokens.PieceIds(PATH).by_pieces
    assert encoded(pieces, texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_empty_table(spark, make_docs):
    got, _ = written(spark, make_docs(["a"]).limit(0))
    assert tokens.token_digest(got).count() == 0


def test_rows_are_pruned_by_doc_id(spark, make_docs):
    got, path = written(spark, make_docs([(i * 3, f"text {i}") for i in range(3000)]), stride=1000)
    assert [r.doc_id for r in got.where("doc_id = 600").collect()] == [600] and got.where("doc_id = 601").count() == 0
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,600)]" in got.where("doc_id = 600")._jdf.queryExecution().toString()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB'’sS.,!<|>#1é É́ñ÷× \n"), st.characters(blacklist_categories=["Cs"])), max_size=30))
def test_pieces_are_the_whole_text(text):
    want = np.array(_whole().tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""
    assert encoded(_whole(), [text]) == [want]


def _whole():
    return tokens.piece_ids(PATH)
