"""The registered queries op1_ ... op13_ and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyops.llm import (decontamination, fingerprints, infilling, jaccard, katz, licenses, mixing, oracles, resampling, rotation, runs, sharding, tokens,
                        toxicity)
from skyops.llm.common import scratch, table

#: target weights of the label domains for op3 (quality and toxic labels), of the mixture's tokens
MIX_SHARES = {"quality0_toxic0": 0.05, "quality0_toxic1": 0.0, "quality1_toxic0": 0.93, "quality1_toxic1": 0.02}

#: shards of op12
SHARDS = 24


def _remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", _remainder() != 1)
    model = katz.fit(docs, F.col("train"), order=3)
    scored = katz.score(docs, model, model.encoded)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("places.label"))
    best = F.coalesce(F.array_max("matches.containment"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.array_distinct("matches.label"))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"))


def op3_mixture_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _, rates = mixing.fit_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), shares=MIX_SHARES)
    return mixing.with_rates(members, rates)


def op4_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rotation.rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["first"], m["end"])), ",")
    return rows.withColumn("mask", mask)


def op6_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokens.write_token_orc(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.token_digest(tokens.read_token_orc(spark, path))


def op8_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(_remainder() != 0))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", (_remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _altered(docs: DataFrame) -> DataFrame:
    """Texts of every tenth id (by crc32) become periodic from a word on: its words from word a repeat the first p words after a."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(w):
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(F.lit(0).cast("bigint"), n - a - 1), lambda i: F.get(w, (a + i % p).cast("int")))
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, F.lit(1), a.cast("int")), tail)).otherwise(F.lit(""))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    changed = F.get(F.transform(F.array(words), periodic), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_altered(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digests = found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return digests.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
                          F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.length(body) + 8).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    return sharding.assign_shards(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_infilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infilling.fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(infilling.restored().cast("binary"), 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz_scores": op1_katz_scores,
    "op2_license_scan": op2_license_scan,
    "op3_mixture_rates": op3_mixture_rates,
    "op4_benchmark_hits": op4_benchmark_hits,
    "op5_perspectives": op5_perspectives,
    "op6_resampled": op6_resampled,
    "op7_token_files": op7_token_files,
    "op8_jaccard_groups": op8_jaccard_groups,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_word_runs": op11_word_runs,
    "op12_ring_shards": op12_ring_shards,
    "op13_infilled": op13_infilled,
}
QUERIES["pipeline"] = pipeline
SQL: dict[str, str] = oracles.SQL
