"""The corpus pipeline: documents in, token files out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. ``run`` applies them to the documents of ``sf_dir``; its result is the token files' digest of what is left.

1. quality: rows that the importance resampling leaves out go (clean rows are kept by the cut of held-out good rows; all
   good labelled rows are in the target model, and each is held out once for the cut).
2. near_duplicates: one document of each group of near duplicates stays, the one of the smallest doc_id.
3. decontamination: benchmark spans are cut out of the texts; documents that are mostly benchmark text go.
4. mixture: the domains are the quality and toxicity labels; documents are drawn at rates from 0 to 1 whose expected tokens come nearest to a quarter of
   those of the low-quality and the toxic domains and to all of those of the clean one, and so never twice.
5. tokens: texts become ORC token files, read back.

Every stage reads all rows its predecessor kept; null and empty texts and extra columns pass through as the operators define. Equal rows are near duplicates, so one
stays; ties are broken by doc_id, then by a hash of the text; an empty table gives an empty one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyops.llm import decontamination, jaccard, mixing, resampling, tokens
from skyops.llm.common import scratch, table

#: what the expected tokens of a domain are multiplied by; other domains keep theirs as far as rates of 1 at most allow
FACTORS = {"quality0_toxic0": 0.25, "quality0_toxic1": 0.25, "quality1_toxic1": 0.25}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resampling.keep_selected(docs, table(spark, sf_dir, "labels"), cross=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, model, rates = mixing.fit_mixture(docs, table(spark, sf_dir, "labels"), factors=FACTORS, top=1.0, tolerance=1e-3, evidence=1024.0)
    return mixing.mix_documents(docs, model, rates, at_most_once=True)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch(spark, "corpus-tokens")
    tokens.write_token_orc(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.token_digest(tokens.read_token_orc(spark, path))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixture", mixture),
    ("tokens", token_files),
]

#: SQL can't express the stages (trained models, component search, tokenizer); tests/llm hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
