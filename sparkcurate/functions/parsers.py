"""Developer-tool output as typed columns: one text in, a struct or an array of structs out, all in the JVM.

Lines and columns count from 1.  Empty or null output gives empty arrays; output that cannot be read gives parse_error where the struct has one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.functions.textfn import text0


def lines(c: Column) -> Column:
    return F.split(text0(c), "\n")


def blank(c: Column) -> Column:
    return F.length(F.trim(text0(c))) == 0


def json_list(c: Column, item: str) -> Column:
    """A JSON list, or one object as a list of one; null where it does not parse or is neither."""
    t = F.trim(text0(c))
    return F.from_json(F.when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]"))).when(t.startswith("["), t), f"array<{item}>", {"mode": "PERMISSIVE"})


def type_check(output: Column) -> Column:
    """struct<success, errors, warnings, items, parse_error> of a type checker's JSON list.  Success means no errors, warnings are allowed."""
    items = json_list(output, "struct<file:string,line:int,column:int,severity:string,code:string,message:string>")
    full = F.transform(items, lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), F.coalesce(x["column"], F.lit(0)).alias("col"), F.coalesce(x["severity"], F.lit("error")).alias("severity"), F.coalesce(x["code"], F.lit("unknown")).alias("code"), x["message"].alias("message")))
    of = lambda s: F.coalesce(F.size(F.filter(full, lambda x: x["severity"] == s)), F.lit(0))
    wrong = ~blank(output) & items.isNull()
    return F.struct((~wrong & (of("error") == 0)).alias("success"), of("error").alias("errors"), of("warning").alias("warnings"), F.coalesce(full, F.array()).alias("items"), F.when(wrong, "not a JSON list").alias("parse_error"))


LINT = r"^(.+?):(\d+):(\d+): (\w+) (\[\*\] )?(.*)$"


def lint(output: Column) -> Column:
    """struct<items, fixable, parse_error> of a linter's lines file:line:col: CODE [*] message; summary lines are skipped."""
    kept = F.filter(lines(output), lambda x: x.rlike(LINT) & ~x.startswith("Found ") & ~x.startswith("No "))
    g = lambda x, k: F.regexp_extract(x, LINT, k)
    items = F.transform(kept, lambda x: F.struct(g(x, 1).alias("file"), g(x, 2).cast("int").alias("line"), g(x, 3).cast("int").alias("col"), g(x, 4).alias("code"), (F.length(g(x, 5)) > 0).alias("fixable"), g(x, 6).alias("message")))
    wrong = (F.size(items) == 0) & text0(output).contains(":") & text0(output).rlike(r"\d") & ~text0(output).rlike(r"(?m)^(Found|No) ")
    return F.struct(items.alias("items"), F.size(F.filter(items, lambda x: x["fixable"])).alias("fixable"), F.when(wrong, "no line could be read").alias("parse_error"))


TEST = r"^(\S+::\S+) (PASSED|FAILED|ERROR|SKIPPED)\b"


def test_run(output: Column) -> Column:
    """struct<passed, failed, errors, skipped, seconds, success, items> of a test log; counts come from the lines, the duration from the summary."""
    kept = F.filter(lines(output), lambda x: x.rlike(TEST))
    items = F.transform(kept, lambda x: F.struct(F.regexp_extract(x, TEST, 1).alias("name"), F.lower(F.regexp_extract(x, TEST, 2)).alias("outcome")))
    of = lambda s: F.size(F.filter(items, lambda x: x["outcome"] == s))
    found = F.nullif(F.regexp_extract(text0(output), r"(?m)^=+ .* in ([0-9.]+)s =+$", 1), F.lit(""))
    return F.struct(of("passed").alias("passed"), of("failed").alias("failed"), of("error").alias("errors"), of("skipped").alias("skipped"), found.try_cast("double").alias("seconds"), ((of("failed") + of("error")) == 0).alias("success"), items.alias("items"))


LOCATION = "struct<uri:string,range:struct<start:struct<line:int,character:int>>>"


def place(x: Column) -> Column:
    return F.struct(F.regexp_replace(x["uri"], "^file://", "").alias("file"), (x["range"]["start"]["line"] + 1).alias("line"), (x["range"]["start"]["character"] + 1).alias("col"))


def definitions(response: Column) -> Column:
    """struct<success, places, parse_error>: null is no success, one object or a list of them is."""
    found = json_list(response, LOCATION)
    null = blank(response) | (F.trim(text0(response)) == "null")
    return F.struct((F.coalesce(F.size(found), F.lit(0)) > 0).alias("success"), F.coalesce(F.transform(found, place), F.array()).alias("places"), F.when(~null & found.isNull(), "neither object nor list").alias("parse_error"))


def references(response: Column) -> Column:
    """struct<success, places, parse_error>: a list only."""
    found = F.when(F.trim(text0(response)).startswith("["), json_list(response, LOCATION))
    null = blank(response) | (F.trim(text0(response)) == "null")
    return F.struct((F.coalesce(F.size(found), F.lit(0)) > 0).alias("success"), F.coalesce(F.transform(found, place), F.array()).alias("places"), F.when(~null & found.isNull(), "not a list").alias("parse_error"))


def hover(response: Column) -> Column:
    """struct<success, language, content>: contents as an object (value, with kind or language), a text, or a list joined by blank lines."""
    raw = F.get_json_object(response, "$.contents")
    parts = F.from_json(raw, "array<string>")
    pieces = F.transform(parts, lambda p: F.coalesce(F.get_json_object(p, "$.value"), p))
    content = F.when(raw.startswith("["), F.array_join(pieces, "\n\n")).when(raw.startswith("{"), F.get_json_object(raw, "$.value")).otherwise(raw)
    language = F.when(raw.startswith("{"), F.coalesce(F.get_json_object(raw, "$.language"), F.get_json_object(raw, "$.kind")))
    return F.struct((F.length(text0(content)) > 0).alias("success"), language.alias("language"), content.alias("content"))


def workspace_symbols(response: Column) -> Column:
    """array<struct<name, kind, container, file, line>>; the container may be null."""
    found = json_list(response, "struct<name:string,kind:int,containerName:string,location:struct<uri:string,range:struct<start:struct<line:int,character:int>>>>")
    return F.coalesce(F.transform(found, lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["containerName"].alias("container"), F.regexp_replace(x["location"]["uri"], "^file://", "").alias("file"), (x["location"]["range"]["start"]["line"] + 1).alias("line"))), F.array())


#: States by letter, the index column before the work tree.
INDEX_STATES = (("A", "added"), ("M", "modified"), ("D", "deleted"), ("R", "renamed"), ("C", "copied"))
TREE_STATES = (("M", "modified"), ("D", "deleted"))


def vcs_status(output: Column, compat: bool = False) -> Column:
    """array<struct<file, state, staged>> of short status lines `XY name`; a rename gives the new name.

    compat strips the whole output first, which costs a first line with a leading blank its columns; off by default."""
    text = F.trim(text0(output)) if compat else text0(output)

    def item(x: Column) -> Column:
        index, tree = F.substring(x, 1, 1), F.substring(x, 2, 1)
        state = F.when(F.substring(x, 1, 2) == "??", "untracked")
        for letter, name in INDEX_STATES:
            state = state.when(index == letter, name)
        for letter, name in TREE_STATES:
            state = state.when(tree == letter, name)
        name = F.substr(x, F.lit(4))
        return F.struct(F.when(name.contains(" -> "), F.substring_index(name, " -> ", -1)).otherwise(name).alias("file"), state.otherwise("unknown").alias("state"), index.isin(*(a for a, _ in INDEX_STATES)).alias("staged"))

    return F.transform(F.filter(F.split(text, "\n"), lambda x: F.length(x) >= 4), item)


def vcs_diff(output: Column) -> Column:
    """array<struct<file, hunks, added, deleted>>: each +++ line opens a file; lines before the first are lost."""
    parts = F.split(F.concat(F.lit("\n"), text0(output)), r"\n\+\+\+ ")

    def item(p: Column) -> Column:
        body = F.slice(F.split(p, "\n"), 2, 1_000_000_000)
        count = lambda test: F.size(F.filter(body, test))
        return F.struct(
            F.regexp_replace(F.substring_index(p, "\n", 1), "^b/", "").alias("file"),
            count(lambda x: x.startswith("@@")).alias("hunks"),
            count(lambda x: x.startswith("+")).alias("added"),
            count(lambda x: x.startswith("-") & ~x.startswith("---")).alias("deleted"),
        )

    return F.transform(F.slice(parts, 2, 1_000_000_000), item)


def vcs_log(output: Column) -> Column:
    """array<struct<hash, author, date, message>> of lines with four fields between bars; the message may hold bars; short lines are skipped."""
    fields = F.filter(F.transform(lines(output), lambda x: F.split(x, "[|]", 4)), lambda f: F.size(f) == 4)
    return F.transform(fields, lambda f: F.struct(f[0].alias("hash"), f[1].alias("author"), f[2].alias("date"), f[3].alias("message")))


def train_log(output: Column) -> Column:
    """array<struct<iteration, train_loss, val_loss>> of lines `Iter n: Train loss x[, Val loss y]`; what follows a second colon is ignored; lines without a
    train loss or with one that is no number are skipped."""

    def item(x: Column) -> Column:
        body = F.get(F.split(x, ":"), F.lit(1))
        number = lambda label: F.nullif(F.regexp_extract(text0(body), label + r" loss ([^\s,]+)", 1), F.lit("")).try_cast("double")
        return F.struct(F.nullif(F.regexp_extract(x, r"Iter (\d+)", 1), F.lit("")).try_cast("int").alias("iteration"), number("Train").alias("train_loss"), number("Val").alias("val_loss"))

    return F.filter(F.transform(lines(output), item), lambda r: r["iteration"].isNotNull() & r["train_loss"].isNotNull())


def val_losses(output: Column) -> Column:
    """array<struct<iteration, val_loss>> of lines with `Iter n: Val loss x`."""
    pattern = r"Iter (\d+): Val loss ([0-9.]+)"
    kept = F.filter(lines(output), lambda x: x.rlike(pattern))
    return F.transform(kept, lambda x: F.struct(F.regexp_extract(x, pattern, 1).cast("int").alias("iteration"), F.regexp_extract(x, pattern, 2).try_cast("double").alias("val_loss")))


def line_range(text: Column, first: Column, count: Column) -> Column:
    """count lines from the 1-based line first, line ends kept but for the last of the text."""
    every = F.split(text0(text), "\n")
    part = F.slice(every, F.greatest(first, F.lit(1)), F.greatest(count, F.lit(0)))
    return F.concat(F.array_join(part, "\n"), F.when((F.size(part) > 0) & (first + count - 1 < F.size(every)), "\n").otherwise(""))


def frame_kind(value: Column) -> Column:
    """request, notification, response or malformed, of one RPC frame."""
    keys = F.json_object_keys(value)
    method, ident = F.array_contains(keys, "method"), F.array_contains(keys, "id")
    return F.when(keys.isNull(), "malformed").when(method & ident, "request").when(method, "notification").when(ident, "response").otherwise("malformed")


def call_blocks(text: Column) -> Column:
    """array<string>: bodies of call tags, then Python fences that execute code."""
    tags = F.regexp_extract_all(text0(text), F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    fences = F.filter(F.regexp_extract_all(text0(text), F.lit(r"(?s)```python\n(.*?)```"), F.lit(1)), lambda b: b.contains("execute_code"))
    return F.concat(tags, fences)


def code_of_call(block: Column) -> Column:
    """The code parameter of a call, or the block itself unless it is markup."""
    inner = F.regexp_extract(text0(block), r"(?s)<parameter=code>\s*(.*?)\s*</parameter>", 1)
    raw = F.trim(text0(block))
    return F.when(F.length(inner) > 0, inner).when(~raw.startswith("<"), raw)


def source_names(code: Column, kind: str) -> Column:
    """array<string>: names of classes, functions or imports by line patterns."""
    pattern = {"class": r"(?m)^class\s+(\w+)", "def": r"(?m)^\s*(?:async\s+)?def\s+(\w+)", "import": r"(?m)^(?:from|import)\s+([\w.]+)"}[kind]
    return F.regexp_extract_all(text0(code), F.lit(pattern), F.lit(1))
