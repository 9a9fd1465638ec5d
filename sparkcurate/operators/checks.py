"""Checks and audits of conversation datasets.

A check is one row (check_name, passed, message); all checks of a dataset come from one scan with conditional aggregates.  Empty datasets: averages
and shares are 0, a distribution check fails, a content check without tool records passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.textfn import count_of, strip, text0
from sparkcurate.operators.filters import TOOL_DETECTORS, any_message, by_assistant

ROLES = ("system", "user", "assistant", "tool")
#: The order of severity in a summary.
SEVERITY = ("failed", "warning", "passed")


def validation_errors(messages: Column) -> Column:
    """Codes of what is wrong with one record: too_few, last_role, role:<i>, empty:<i>.  A null array has too few messages."""
    m = F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>"))
    last = F.when(F.size(m) > 0, F.element_at(m, -1)["role"])
    single = F.array(
        F.when(F.size(m) < 2, F.lit("too_few")),
        F.when((F.size(m) > 0) & (F.coalesce(last, F.lit("")) != "assistant"), F.lit("last_role")),
    )
    roles = F.transform(m, lambda x, i: F.when(~F.coalesce(x["role"].isin(*ROLES), F.lit(False)), F.concat(F.lit("role:"), i.cast("string"))))
    empty = F.transform(m, lambda x, i: F.when(F.length(strip(text0(x["content"]))) == 0, F.concat(F.lit("empty:"), i.cast("string"))))
    return F.filter(F.concat(single, roles, empty), lambda e: e.isNotNull())


def share(n: Column, total: Column) -> Column:
    return n.cast("double") / F.greatest(total, F.lit(1))


def dataset_checks(df: DataFrame, min_tool: float = 0.10, max_tool: float = 0.80, max_empty: float = 0.10, min_system: float = 0.90) -> DataFrame:
    """(check_name, passed, message): distribution, content, system_prompts, last_role and tags of df (a column messages), in one aggregate."""
    m = F.col("messages")
    tool = any_message(m, TOOL_DETECTORS["tags"])
    empty_result = any_message(m, lambda c: c.rlike(r"(?s)<tool_response>\s*</tool_response>"))
    system = F.coalesce(F.get(m, F.lit(0))["role"] == "system", F.lit(False))
    unbalanced = any_message(m, lambda c: count_of(c, "<tool_call>") != count_of(c, "</tool_call>"))
    one = df.agg(
        F.count("*").alias("n"),
        F.count_if(tool).alias("tool"),
        F.count_if(tool & empty_result).alias("empty"),
        F.count_if(system).alias("system"),
        F.count_if(F.array_contains(validation_errors(m), "last_role")).alias("last"),
        F.count_if(unbalanced).alias("tags"),
    )
    n, t = F.col("n"), F.col("tool")
    rows = F.array(
        F.struct(F.lit("distribution").alias("check_name"), ((n > 0) & share(t, n).between(min_tool, max_tool)).alias("passed"), F.concat(t.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" with tools")).alias("message")),
        F.struct(F.lit("content").alias("check_name"), (share(F.col("empty"), t) <= max_empty).alias("passed"), F.concat(F.col("empty").cast("string"), F.lit(" empty results")).alias("message")),
        F.struct(F.lit("system_prompts").alias("check_name"), (share(F.col("system"), n) >= min_system).alias("passed"), F.concat(F.col("system").cast("string"), F.lit(" with system message")).alias("message")),
        F.struct(F.lit("last_role").alias("check_name"), (F.col("last") == 0).alias("passed"), F.concat(F.col("last").cast("string"), F.lit(" do not end with the assistant")).alias("message")),
        F.struct(F.lit("tags").alias("check_name"), (F.col("tags") == 0).alias("passed"), F.concat(F.col("tags").cast("string"), F.lit(" with unbalanced tags")).alias("message")),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def summary(checks: DataFrame) -> DataFrame:
    """One row (text): a line per check, failed ones first, then by name."""
    line = F.concat(F.when(F.col("passed"), "PASS ").otherwise("FAIL "), F.col("check_name"), F.lit(": "), F.col("message"))
    key = F.struct(F.col("passed").alias("passed"), F.col("check_name").alias("name"), line.alias("line"))
    return checks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["line"]), "\n").alias("text"))


def pattern_coverage(df: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """(pattern, messages, verdict): how many messages hold each literal; none fails, under three warns.  One pass, one counter a pattern."""
    m = F.coalesce(F.col("messages"), F.array().cast("array<struct<role:string,content:string>>"))

    def holding(pattern: str) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(m, lambda x: text0(x["content"]).contains(pattern)))), F.lit(0))

    one = df.agg(*(holding(p).alias(f"c{k}") for k, p in enumerate(patterns)))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(p).alias("pattern"), F.col(f"c{k}").cast("bigint").alias("messages")) for k, p in enumerate(patterns)))).alias("r")).select("r.*")
    return rows.withColumn("verdict", F.when(F.col("messages") == 0, "fail").when(F.col("messages") < 3, "warn").otherwise("pass"))


def system_prompts(df: DataFrame) -> DataFrame:
    """One row (prompts, most_common): different system prompts in first place and the count of the modal one; 0 for none."""
    first = F.get("messages", F.lit(0))
    rows = df.filter(first["role"] == "system").groupBy(F.md5(text0(first["content"])).alias("k")).agg(F.count("*").alias("n"))
    return rows.agg(F.count("*").alias("prompts"), F.coalesce(F.max("n"), F.lit(0)).alias("most_common"))


#: The names of tools; the first one found in a message with a call names its class.
TOOLS = (
    "goto_definition",
    "find_references",
    "hover",
    "document_symbols",
    "workspace_symbols",
    "typecheck",
    "ruff_check",
    "pytest_run",
    "git_status",
    "git_diff",
    "git_log",
    "read_file",
    "write_file",
    "run_command",
)


def tool_class(content: Column, tools: tuple[str, ...] = TOOLS) -> Column:
    """direct_answer without a tool call, else the first of the tools in the message, other for none of them."""
    c = text0(content)
    named = F.coalesce(*(F.when(c.contains(t), t) for t in tools), F.lit("other"))
    return F.when(c.contains("<tool_call>"), named).otherwise("direct_answer")


def first_answer(messages: Column) -> Column:
    """The first assistant message's content; '' for none, which the checks of classes leave out."""
    return text0(F.get(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(0))["content"])


def balance(df: DataFrame, least: float = 0.05) -> DataFrame:
    """(tool, n, share, rare) of the classes of first answers; records without one do not count."""
    rows = df.filter(first_answer(F.col("messages")) != "").groupBy(tool_class(first_answer(F.col("messages"))).alias("tool")).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("tool", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("n") / F.col("total") < least).alias("rare"))


def shuffle_quality(numbered: DataFrame) -> DataFrame:
    """(tool, n, first_half_pct, clustered): the share of each class in the first half of the rows; numbered: nth, total, messages, of
    records with a first answer only."""
    half = F.col("nth") <= F.floor(F.col("total") / 2)
    rows = numbered.groupBy(tool_class(first_answer(F.col("messages"))).alias("tool")).agg(F.count("*").alias("n"), F.count_if(half).alias("first"))
    pct = F.col("first") * 100.0 / F.col("n")
    return rows.select("tool", "n", pct.alias("first_half_pct"), ((pct < 10) | (pct > 90)).alias("clustered"))


def format_counts(df: DataFrame) -> DataFrame:
    """(fmt, n): formats of first answers: a (wrapped code), b (bare call), mixed, direct."""
    c = first_answer(F.col("messages"))
    a, b = c.contains("<function="), c.rlike(r"(?s)<tool_call>\s*\{")
    return df.groupBy(F.when(a & b, "mixed").when(a, "a").when(b, "b").otherwise("direct").alias("fmt")).agg(F.count("*").alias("n"))


def key_consistency(lines: DataFrame, expected: str = "messages") -> DataFrame:
    """One row (lines, malformed, without_key): JSON lines (a column value) that do not parse or lack the expected top-level key."""
    keys = F.json_object_keys("value")
    return lines.filter("length(trim(value)) > 0").agg(F.count("*").alias("lines"), F.count_if(keys.isNull()).alias("malformed"), F.count_if(keys.isNotNull() & ~F.array_contains(keys, expected)).alias("without_key"))


#: The functions that the corpus audit counts calls of.
AUDITED = (
    "ruff_check",
    "typecheck",
    "pytest_run",
    "goto_definition",
    "find_references",
    "hover",
    "document_symbols",
    "workspace_symbols",
    "git_status",
    "git_diff",
    "git_log",
    "read_file",
)


def corpus_audit(df: DataFrame, functions: tuple[str, ...] = AUDITED) -> DataFrame:
    """One row of counts over conversations: of three messages (single turn) and of more (multi turn), with a message that calls two different
    functions or more, with the system first; and the number of messages with something before their call."""
    m = F.col("messages")
    n = F.coalesce(F.size(m), F.lit(0))

    def different(c: Column) -> Column:
        total = F.lit(0)
        for f in functions:
            total = total + c.contains(f"{f}(").cast("int")
        return total

    several = by_assistant(m, lambda c: c.contains("<tool_call>") & (different(c) >= 2))
    late = F.filter(m, lambda x: (x["role"] == "assistant") & text0(x["content"]).contains("<tool_call>") & ~text0(x["content"]).startswith("<tool_call>"))
    return df.agg(
        F.count("*").alias("records"),
        F.count_if(n == 3).alias("single_turn"),
        F.count_if(n > 3).alias("multi_turn"),
        F.count_if(several).alias("several_calls"),
        F.count_if(F.coalesce(F.get(m, F.lit(0))["role"] == "system", F.lit(False))).alias("system_first"),
        F.coalesce(F.sum(F.size(late)), F.lit(0)).alias("preambles"),
    )


def loss_check(logs: DataFrame, max_final: float = 2.0, min_decrease: float = 0.1) -> DataFrame:
    """One row (points, bad, first_loss, last_loss, verdict) of train losses in the order of the log (columns line_no, train_loss)."""
    bad = F.isnan("train_loss") | (F.abs("train_loss") == float("inf")) | (F.col("train_loss") < 0)
    one = logs.agg(F.count("train_loss").alias("points"), F.count_if(bad).alias("bad"), F.min_by("train_loss", "line_no").alias("first_loss"), F.max_by("train_loss", "line_no").alias("last_loss"))
    drop = (F.col("first_loss") - F.col("last_loss")) / F.col("first_loss")
    return one.withColumn("verdict", F.when(F.col("points") == 0, "no data").when(F.col("bad") > 0, "invalid").when(drop < min_decrease, "no decrease").when(F.col("last_loss") > max_final, "high").otherwise("pass"))
