"""Scalar text functions as Column expressions; all run in the JVM.

Null handling is stated per function: predicates never return null, so that a filter and its negation together
hold every row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IM_START, IM_END = "<|im_start|>", "<|im_end|>"
#: ASCII blanks as a strip set, for btrim.
BLANKS = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Removes Unicode white space at both ends (trim() removes spaces only); null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text0(c: Column) -> Column:
    """The text, '' for null."""
    return F.coalesce(c, F.lit(""))


def norm_label(c: Column) -> Column:
    """Roles and splits: lower case, without outer blanks; null stays null."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def count_of(c: Column, needle: str) -> Column:
    """Occurrences of a literal that do not overlap; 0 for null."""
    return F.coalesce((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / F.lit(len(needle)), F.lit(0)).cast("bigint")


def message(role: Column | str, content: Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.alias("content"))


def chat_to_messages(text: Column) -> Column:
    """Chat text to array<struct<role,content>>.

    Parts begin at the start marker; blank parts and parts without a line break (a role without content) are left
    out, the end marker and outer white space are removed.  Null or blank text gives an empty array.
    """
    parts = F.filter(F.split(text0(text), r"<\|im_start\|>"), lambda p: p.contains("\n") & (F.length(F.btrim(p, F.lit(BLANKS))) > 0))
    return F.transform(
        parts,
        lambda p: message(
            F.btrim(F.substring_index(p, "\n", 1), F.lit(BLANKS)),
            F.btrim(F.replace(F.substr(p, F.instr(p, "\n") + 1), F.lit(IM_END), F.lit("")), F.lit(BLANKS)),
        ),
    )


def messages_to_chat(messages: Column, roles: tuple[str, ...] | None = None) -> Column:
    """Messages to chat text, joined by line breaks; only the given roles, all if none are given."""
    kept = messages if roles is None else F.filter(messages, lambda m: m["role"].isin(*roles))
    return F.array_join(F.transform(kept, lambda m: F.concat(F.lit(IM_START), text0(m["role"]), F.lit("\n"), text0(m["content"]), F.lit(IM_END))), "\n")


def canonical(messages: Column) -> Column:
    """One text per array of messages, equal if and only if the roles and contents are equal, in order."""
    return F.to_json(F.transform(messages, lambda m: message(m["role"], m["content"])))


def hash_order(seed: int, key: Column) -> Column:
    """Sort key of a seeded permutation; the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), key.cast("string")))


def hash_bucket(seed: int, key: Column, n: int) -> Column:
    """A bucket 0..n-1 from the first 7 hexadecimal digits of the seeded md5."""
    return F.conv(F.substring(hash_order(seed, key), 1, 7), 16, 10).cast("bigint") % F.lit(n)
