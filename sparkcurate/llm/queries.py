"""Queries of the llm subpackage: QUERIES[name](spark, sf_dir), each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm import answers, cut_texts, near_duplicates, packing, proportional_sample, split_overlap, sql, template_leaks
from sparkcurate.functions.textfn import norm_label
from sparkcurate.llm.shared import conversations, spread, table

CHAT = ("chat_text", "text_id", "text")
TOOLS = ("tool_calling", "example_id", "messages")
ROWS = ("training_rows", "row_id", "messages")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(conversations(spark, d, [TOOLS, CHAT]))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(conversations(spark, d, [TOOLS, CHAT]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_pairs(conversations(spark, d, [ROWS, CHAT]))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(conversations(spark, d, [ROWS, CHAT]))


def pools(spark: SparkSession, d: str) -> DataFrame:
    traces, prompts = table(spark, d, "training_examples_poc"), table(spark, d, "eval_prompts")
    return proportional_sample.records("training_examples_poc", traces, "example_id", F.col("metadata")["category"]).unionByName(
        proportional_sample.records("eval_prompts", prompts, "prompt_id", F.col("category"))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return proportional_sample.shortfalls(pools(spark, d), table(spark, d, "sample_targets"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return proportional_sample.sample_report(pools(spark, d), table(spark, d, "sample_targets"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return proportional_sample.drawn(pools(spark, d), table(spark, d, "sample_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized(documents(spark, d))


def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(documents(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(documents(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return template_leaks.leaks(documents(spark, d), table(spark, d, "heldout_items")).filter("same > 0").select("doc_id", "item_id")


def p6_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return template_leaks.leaks(documents(spark, d), table(spark, d, "heldout_items")).filter("changed > 0")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return template_leaks.leaked_items(documents(spark, d), table(spark, d, "heldout_items")).drop("reparameterised")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return template_leaks.leaked_items(documents(spark, d), table(spark, d, "heldout_items"))


def defects(spark: SparkSession, d: str) -> DataFrame:
    tools, chat = spread(table(spark, d, "tool_calling")), table(spark, d, "chat_messages")
    turns = answers.turns_of_arrays(tools, "tool_calling", "example_id").unionByName(answers.turns_of_rows(chat, "chat_messages"))
    every = tools.select(F.explode("messages").alias("m")).select("m.role", "m.content").unionByName(chat.select("role", "content"))
    said = every.filter(norm_label(F.col("role")) == "assistant").select(F.col("content").alias("text"))
    return answers.defects(turns, said, documents(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return defects(spark, d)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return defects(spark, d).groupBy("src", "defect").agg(F.count("*").alias("answers"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts.cut_documents(documents(spark, d)).select("doc_id").distinct()


def p7_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts.prefix_documents(documents(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts.cut_report(documents(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p4_sample": p4_sample,
    "p5_found": p5_found,
    "p5_containers": p5_containers,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_reparameterised": p6_reparameterised,
    "p6_items": p6_items,
    "p6_report": p6_report,
    "p7_found": p7_found,
    "p7_prefixes": p7_prefixes,
    "p7_report": p7_report,
}

SQL: dict[str, str] = sql.SQL
