"""Conversions between the forms of a conversation, as Column expressions.

Null arrays and texts stay null unless stated; empty arrays stay empty.  Regular expressions take line ends as Unix does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.functions.textfn import chat_to_messages, message, text0

#: The tags of the call formats.
CALL_OPEN, CALL_CLOSE = "<tool_call>", "</tool_call>"
RESULT_OPEN, RESULT_CLOSE = "<tool_response>", "</tool_response>"
RESULT_PREFIX = "Tool result: "
FENCE = r"(?s)```json\s*(\{.*?\})\s*```"
XML_CALL = r"(?s)<function=([^>\s]+)>(.*?)</function>"


def to_record(messages: Column) -> Column:
    """One JSON line {"messages": [...]} with role and content of each message."""
    return F.to_json(F.struct(F.transform(messages, lambda m: message(m["role"], m["content"])).alias("messages")), {"ignoreNullFields": "false"})


def either_form(text: Column, messages: Column) -> Column:
    """Messages from the chat text where there is one, else the messages; an error where there is neither."""
    found = F.when(text.isNotNull(), chat_to_messages(text)).otherwise(messages)
    return F.when(text.isNull() & messages.isNull(), F.raise_error(F.lit("record has neither text nor messages")).cast("array<struct<role:string,content:string>>")).otherwise(found)


def with_system(messages: Column, prompt: str, always: bool = False) -> Column:
    """A constant system message in front, where the first message is none, or always."""
    joined = F.concat(F.array(message("system", F.lit(prompt))), F.transform(messages, lambda m: message(m["role"], m["content"])))
    first = F.get(messages, F.lit(0))["role"]
    return joined if always else F.when(F.coalesce(first == "system", F.lit(False)), F.transform(messages, lambda m: message(m["role"], m["content"]))).otherwise(joined)


def by_role(messages: Column, role: str, change) -> Column:
    """The contents of one role changed, all others kept."""
    return F.transform(messages, lambda m: message(m["role"], F.when(m["role"] == role, change(m["content"])).otherwise(m["content"])))


def without_preamble(messages: Column) -> Column:
    """Assistant messages begin at their first tool call; those without one are stripped of nothing."""
    return by_role(messages, "assistant", lambda c: F.when(c.contains(CALL_OPEN), F.trim(F.regexp_replace(c, r"(?s)\A.*?(?=<tool_call>)", ""))).otherwise(c))


def fence_to_tags(content: Column) -> Column:
    """A call in a JSON fence as tagged parameters; text before the fence stays, text after it is dropped.  Contents without a call with
    name and arguments stay as they are; nested argument values keep their JSON form."""
    call = F.regexp_extract(content, FENCE, 1)
    name = F.get_json_object(call, "$.name")
    arguments = F.from_json(F.get_json_object(call, "$.arguments"), "map<string,string>")
    parameters = F.array_join(F.transform(F.map_entries(arguments), lambda e: F.concat(F.lit("<parameter="), e["key"], F.lit(">\n"), e["value"], F.lit("\n</parameter>"))), "\n")
    tagged = F.concat(F.regexp_extract(content, r"(?s)\A(.*?)```json", 1), F.lit("<tool_call><function="), name, F.lit(">\n"), parameters, F.lit("\n</function></tool_call>"))
    return F.when(F.coalesce((F.length(name) > 0) & (F.size(arguments) > 0), F.lit(False)), tagged).otherwise(content)


def result_to_tags(content: Column) -> Column:
    """A prefixed tool result as a tagged one."""
    return F.when(content.startswith(RESULT_PREFIX), F.concat(F.lit(RESULT_OPEN + "\n"), F.substr(content, F.lit(len(RESULT_PREFIX) + 1)), F.lit("\n" + RESULT_CLOSE))).otherwise(content)


def tags_to_json(content: Column) -> Column:
    """A tagged call as JSON with string arguments; contents without one stay."""
    body = F.regexp_extract(content, XML_CALL, 2)
    names = F.regexp_extract_all(body, F.lit(r"(?s)<parameter=([^>]+)>\s*(.*?)\s*</parameter>"), F.lit(1))
    values = F.regexp_extract_all(body, F.lit(r"(?s)<parameter=([^>]+)>\s*(.*?)\s*</parameter>"), F.lit(2))
    call = F.to_json(F.struct(F.regexp_extract(content, XML_CALL, 1).alias("name"), F.map_from_arrays(names, values).alias("arguments")))
    return F.when(content.rlike(XML_CALL), F.concat(F.lit(CALL_OPEN + "\n"), call, F.lit("\n" + CALL_CLOSE))).otherwise(content)


def wrap_bare_call(content: Column) -> Column:
    """A call without a code wrapper gets one: the body between the tags as a code argument."""
    body = F.trim(F.regexp_extract(content, r"(?s)<tool_call>(.*?)</tool_call>", 1))
    wrapped = F.concat(F.lit("<tool_call><function=execute_code>\n<parameter=code>\n"), body, F.lit("\n</parameter>\n</function></tool_call>"))
    return F.when((F.length(body) > 0) & ~body.startswith("<function=") & ~body.startswith("{"), wrapped).otherwise(content)


def call_format(content: Column) -> Column:
    """The format of an assistant message: json, xml, fence or direct."""
    return F.when(content.rlike(r"(?s)<tool_call>\s*\{"), "json").when(content.contains("<function="), "xml").when(content.contains("```json"), "fence").otherwise("direct")


def trace_to_messages(query: Column, calls: Column, answer: Column, system: str | None = None) -> Column:
    """A question and answer trace as messages: system, question, each call with its result, answer.  A null result of any call makes null:
    such traces are left out.  The old key `tool` stands in for a missing `name`."""
    steps = F.flatten(
        F.transform(
            F.coalesce(calls, F.array()),
            lambda c: F.array(
                message("assistant", F.concat(F.lit(CALL_OPEN + "\n"), F.to_json(F.struct(F.coalesce(c["name"], c["tool"]).alias("name"), c["args"].alias("arguments"))), F.lit("\n" + CALL_CLOSE))),
                message("user", F.concat(F.lit(RESULT_OPEN + "\n"), c["result"], F.lit("\n" + RESULT_CLOSE))),
            ),
        )
    )
    front = F.array(*([message("system", F.lit(system))] if system else []), message("user", query))
    missing = F.coalesce(F.exists(calls, lambda c: c["result"].isNull()), F.lit(False))
    return F.when(~missing, F.concat(front, steps, F.array(message("assistant", answer))))


#: The role prefixes of transcripts.
PREFIXES = (("SYSTEM:", "system"), ("USER:", "user"), ("ASSISTANT:", "assistant"), ("FUNCTION RESPONSE:", "tool"))


def transcript_to_messages(text: Column) -> Column:
    """A transcript with role prefixes: blocks between blank lines, those without a known prefix dropped."""
    blocks = F.transform(F.split(text0(text), "\n\n"), lambda b: F.trim(b))

    def parsed(b: Column) -> Column:
        out = F.lit(None).cast("struct<role:string,content:string>")
        for prefix, role in reversed(PREFIXES):
            out = F.when(b.startswith(prefix), message(role, F.trim(F.substr(b, F.lit(len(prefix) + 1))))).otherwise(out)
        return out

    return F.filter(F.transform(blocks, parsed), lambda m: m.isNotNull())


def single_quotes(content: Column) -> Column:
    """k="v" as k='v', unless v holds a single quote."""
    return F.regexp_replace(content, r"(\w+)=\"([^\"']*)\"", "$1='$2'")


#: The word that a request for history is about, first hit wins.
HISTORY_WORDS = (("bug", "bug"), ("error", "error"), ("feature", "feat"), ("refactor", "refactor"), ("test", "test"), ("doc", "docs"), ("perf", "perf"))


def history_word(query: Column) -> Column:
    out = F.lit("fix")
    for word, key in reversed(HISTORY_WORDS):
        out = F.when(F.lower(text0(query)).contains(word), key).otherwise(out)
    return out


def md5_mod5(x: Column) -> Column:
    """The md5 of x, as a number, modulo 5: as 16 is 1 modulo 5, the sum of its hexadecimal digits modulo 5."""
    digits = F.split(F.md5(x), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("bigint"), lambda s, d: s + F.conv(d, 16, 10).cast("bigint")) % 5


def call_record(system: str, query: Column, name: Column, arguments: Column, result: Column, answer: Column) -> Column:
    """The five messages of one tool call."""
    return F.array(
        message("system", F.lit(system)),
        message("user", query),
        message("assistant", F.concat(F.lit(CALL_OPEN + "\n"), F.to_json(F.struct(name.alias("name"), arguments.alias("arguments"))), F.lit("\n" + CALL_CLOSE))),
        message("user", F.concat(F.lit(RESULT_OPEN + "\n"), result, F.lit("\n" + RESULT_CLOSE))),
        message("assistant", answer),
    )


def preview(text: Column, n: int) -> Column:
    """The first n characters, with three dots where some are left out."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def file_path(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file://", "")


def with_preambles(messages: Column, seed: int, row: Column, share: int = 33, text: str = "Let me check that.") -> Column:
    """The inverse of without_preamble in a seeded share of the records of three messages."""
    chosen = (F.size(messages) == 3) & (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), row.cast("string"))), 1, 7), 16, 10).cast("bigint") % 100 < share)
    return F.when(chosen, by_role(messages, "assistant", lambda c: F.when(c.startswith(CALL_OPEN), F.concat(F.lit(text + "\n"), c)).otherwise(c))).otherwise(messages)


def fill_authors(content: Column, names: tuple[str, ...], start: Column) -> Column:
    """author=None in each commit of a text filled by position from a cycle of names that begins at ``start``."""
    parts = F.split(content, "author=None", -1)
    cycle = F.array(*map(F.lit, names))
    filled = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit("author='"), F.get(cycle, ((start + i) % len(names)).cast("int")), F.lit("'"))).otherwise(p))
    return F.array_join(filled, "")


def expand_template(template: Column, values: dict[str, tuple[str, ...]]) -> Column:
    """Texts of a template: the first placeholder takes all its values, the others their first."""
    (first, every), *others = values.items()
    base = template
    for name, v in others:
        base = F.replace(base, F.lit("{" + name + "}"), F.lit(v[0]))
    return F.transform(F.array(*map(F.lit, every)), lambda v: F.replace(base, F.lit("{" + first + "}"), v))
