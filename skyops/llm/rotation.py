"""Multi-party perspective rotation of conversations, in DataFrame functions alone.

For every participant of a conversation (each role but ``system``) the whole dialogue is rendered with that speaker as the
assistant and the others as named users; ``mask`` holds the character spans a model is trained on (the assistant's contents with
their end marks). A long dialogue becomes consecutive parts of ``turns_per_part`` turn numbers; where one such range holds over
``max_messages`` messages it is split on by turn and by the messages' digests, so no group grows with a hot conversation, and the
parts in the order (part, subturn, subpart) are the dialogue.

Messages are ordered by turn, then by digest (md5 of role and text). Defined results: repeated rows (same conversation, turn, role
and text) are one message; a null role is the speaker ``unknown``, a null text is empty, a null turn comes first, null conversation
ids form one conversation; a conversation of system messages alone has no participant and no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the chat format.
START, END, SYSTEM = "<|im_start|>", "<|im_end|>", "system"


def _header(role: Column, speaker: Column) -> Column:
    who = (F.when(role == speaker, F.lit("assistant")).when(role == SYSTEM, F.lit(SYSTEM))
           .otherwise(F.concat(F.lit("user name="), role)))
    return F.concat(F.lit(START), who, F.lit("\n"))


def rotate(turns: DataFrame, turns_per_part: int = 64, max_messages: int = 256) -> DataFrame:
    """Rows: conv_id, speaker, part, subturn, subpart, n_messages, n_trained, text, mask (array of first and end character)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = (turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")).distinct()
            .withColumn("part", F.coalesce(F.floor(F.col("turn") / turns_per_part), F.lit(-1)))
            .withColumn("digest", F.md5(F.concat_ws("\n", "role", "text"))))
    sizes = (said.groupBy("conv_id", "part").agg(F.ceil(F.count("*") / max_messages).alias("pieces"))
             .where("pieces > 1").withColumnsRenamed({"conv_id": "_conv", "part": "_part"}))
    pieces = F.coalesce("pieces", F.lit(1))
    share = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)  # grows with the digest
    said = (said.join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
            .select("conv_id", "turn", "role", "text", "part", "digest",
                    F.when(pieces > 1, F.coalesce("turn", F.lit(-1))).otherwise(F.lit(0)).cast("bigint").alias("subturn"),
                    F.floor(share * pieces).alias("subpart")))
    speakers = (said.where(F.col("role") != SYSTEM).groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).agg(F.lit(1).alias("_one")))
    seen = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))
    rows = (seen.groupBy("conv_id", "speaker", "part", "subturn", "subpart")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "digest", "role", "text"))).alias("said")))
    rows = rows.withColumn("piece", F.transform("said", lambda m: F.struct(
        _header(m["role"], F.col("speaker")).alias("head"), F.concat(m["text"], F.lit(END + "\n")).alias("body"), (m["role"] == F.col("speaker")).alias("own"))))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<first:int,end:int>>)").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        first = acc["at"] + F.length(p["head"])
        end = first + F.length(p["body"])
        span = F.struct(first.alias("first"), (end - 1).alias("end"))  # without the line end
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return rows.select(
        "conv_id", "speaker", "part", "subturn", "subpart", F.size("said").alias("n_messages"),
        F.size(F.filter("piece", lambda p: p["own"])).alias("n_trained"),
        F.array_join(F.transform("piece", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.aggregate("piece", start, step, lambda acc: acc["spans"]).alias("mask"))
