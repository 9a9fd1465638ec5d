"""Tool calls in model answers, in mixed formats, as an Arrow UDF.

Passes, in this order: call tags (JSON or XML within; a tag is removed even if unreadable), function blocks without an opening tag (with one
parameter or more), JSON fences with a name.  Calls are listed by pass, not by place; what a pass took is not looked at again.  Arguments are
canonical JSON text; XML arguments are always strings, the last of equal names wins.  Null text gives '' and no calls.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.functions.udf import arrow_udf

CALL = "struct<name:string,arguments:string>"
RESULT = f"struct<clean:string,calls:array<{CALL}>>"
TAGGED = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
BLOCK = re.compile(r"<function=([^>\s]+)>(.*?)(?:</function>\s*(?:</tool_call>)?|</tool_call>)", re.S)
PARAMETER = re.compile(r"<parameter=([^>\s]+)>(.*?)</parameter>", re.S)
FENCED = re.compile(r"```json\s*\n(.*?)```", re.S)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def call_of_json(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    if isinstance(value, dict) and value.get("name"):
        return {"name": str(value["name"]), "arguments": canonical_json(value.get("arguments", {}))}
    return None


def call_of_xml(text: str, least: int = 0) -> dict | None:
    block = BLOCK.search(text + "</tool_call>")
    if not block:
        return None
    found = {k: v.strip() for k, v in PARAMETER.findall(block.group(2))}
    return {"name": block.group(1), "arguments": canonical_json(found)} if len(found) >= least else None


def parse(text: str | None) -> tuple[str, list[dict]]:
    """(text without calls, calls)."""
    rest, calls = text or "", []

    def taken(pattern: re.Pattern, read, drop_unread: bool) -> None:
        nonlocal rest
        out, end = [], 0
        for m in pattern.finditer(rest):
            call = read(m)
            if call:
                calls.append(call)
            if call or drop_unread:
                out.append(rest[end : m.start()])
                end = m.end()
        rest = "".join([*out, rest[end:]])

    taken(TAGGED, lambda m: (call_of_json(m.group(1)) if m.group(1).strip().startswith("{") else None) or call_of_xml(m.group(1)), True)
    taken(BLOCK, lambda m: call_of_xml(m.group(0), 1), False)
    taken(FENCED, lambda m: call_of_json(m.group(1)), False)
    return rest.strip(), calls


@arrow_udf(RESULT)
def _parsed(texts: pd.Series) -> pd.DataFrame:
    out = [parse(t) for t in texts]
    return pd.DataFrame({"clean": [a for a, _ in out], "calls": [b for _, b in out]})


def tool_calls(text: Column) -> Column:
    """struct<clean, calls> of an answer."""
    return _parsed(text)


def call_names(text: Column) -> Column:
    """Names of tagged calls only, in the JVM: enough for filters and counts; JSON calls first, then XML ones."""
    t = F.coalesce(text, F.lit(""))
    a = F.regexp_extract_all(t, F.lit(r"(?s)<tool_call>\s*\{\s*\"name\":\s*\"([^\"]+)\""), F.lit(1))
    b = F.regexp_extract_all(t, F.lit(r"<function=([^>\s]+)>"), F.lit(1))
    return F.concat(a, b)
