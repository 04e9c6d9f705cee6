"""One query per operator on the given tables. Each returns its whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import (
    chat, conversations, decontaminate, exact_dedup, licenses, neighbours, packing, periodic, secrets, simhash, suffix_dedup, toxicity, warc,
)
from stowage.llm.common import table
from stowage.session import work_folder


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"), work_folder(spark, "warc"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, size=1, radius=3)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


TOOLS = {
    "lookup": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query", "limit"], "additionalProperties": False},
    "measure": {"type": "object", "properties": {"text": {"type": "string"}, "unit": {"enum": ["char", "word"]}}, "required": ["text"]},
}


def with_tools(conversations: DataFrame) -> DataFrame:
    """The conversations with tool traffic derived from them, as the given ones have none.

    Each assistant turn calls a tool with its whole text: every seventh with a limit of the wrong type, every eleventh
    of a tool that does not exist. Of eight turns, turn 1 waits for the call of turn 3, that for the one of turn 5, and turn 7 too; in each
    nineteenth conversation turns 1 and 3 wait for each other. The tool answers with the length of the
    text, but not in each thirteenth conversation; each seventeenth has an answer to no call.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    name = F.when(F.col("turn") % 11 == 10, "search").when(F.col("turn") % 2 == 1, "lookup").otherwise("measure")
    word = F.coalesce("text", F.lit(""))
    key = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    arguments = F.when(name == "measure", F.to_json(F.struct(word.alias("text"), F.lit("char").alias("unit")))).when(
        F.col("turn") % 7 == 5, F.to_json(F.struct(word.alias("query"), F.lit("3").alias("limit")))
    ).otherwise(F.to_json(F.struct(word.alias("query"), (F.col("turn") % 5).cast("int").alias("limit"))))
    turn, ring = F.col("turn") % 8, F.coalesce("conv_id", F.lit(1)) % 19 == 0
    waits = F.when((turn == 1) | (turn == 3) & ~ring, F.col("turn") + 2).when((turn == 7) | (turn == 3), F.col("turn") - 2)
    after = F.when(waits.isNotNull(), F.array(key(waits))).otherwise(F.array().cast("array<string>"))
    calls = F.to_json(F.array(F.struct(key(F.col("turn")).alias("id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))))
    asks = F.col("role") == "assistant"
    said = rows.select("conv_id", "turn", "role", "text", F.when(asks, calls).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))
    answers = rows.filter(asks & (F.coalesce("conv_id", F.lit(0)) % 13 != 0)).select(
        "conv_id", "turn", F.lit("tool").alias("role"), F.length(F.coalesce("text", F.lit(""))).cast("string").alias("text"),
        F.lit(None).cast("string").alias("tool_calls"),
        F.when((F.col("conv_id") % 17 == 0) & (F.col("turn") < 2), F.lit("call_none")).otherwise(key(F.col("turn"))).alias("tool_call_id"),
    )
    return said.union(answers)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(with_tools(table(spark, sf_dir, "conversations")), TOOLS)


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=True)


QUERIES = {f.__name__: f for f in (
    op1_secrets, op2_toxicity, op3_exact_dedup, op4_suffix_dedup, op5_warc, op6_decontaminate, op7_simhash, op8_licenses,
    op9_packing, op10_chat, op11_neighbours, op12_repair, op13_periodic_runs,
)}
