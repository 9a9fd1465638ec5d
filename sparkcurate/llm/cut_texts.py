"""Texts that lost their end (problem 7).

Method named: a self-join by prefix, by hashes of prefixes of fixed lengths.  Every text has a key for each power of two up to its length, the hash
of as many characters; a text whose length lies between 2**k and 2**(k+1) can only be a prefix of texts that share its key of 2**k.  So each key gets
the set of lengths of the texts that end there (at most 2**k numbers, whatever the number of texts), longer texts with that key hash their
beginnings of just these lengths, and these hashes are joined with those of whole texts.  Texts themselves are not shuffled for the keys, copies
count once, and no group of texts that begin alike is expanded.  A prefix counts as cut if the longer copy goes on inside a word; an earlier,
complete version of a text is a prefix too, and no case.

Most cut texts have no longer copy, so the join alone cannot give the result; the end of every text is read as well: marks of a cut, JSON that does
not parse, logs without a summary, code that breaks off, open fences and tables, and prose that ends neither with a sentence nor with a closing
line.  Whether functions of the corpus end with a return is counted over the corpus (``returning``).  Null and blank texts are no cases.  Copies
of a cut text are cases themselves.  Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.bags import arrow_columns
from sparkcurate.llm.shared import written

# -- the end of one text ---------------------------------------------------------------------------------------------------------------

MARKS = ("…", "...", "[...]", "�", "[truncated]", "(truncated)")
TERMINAL = re.compile(r"[.!?。！？؟](?:[\"'”’»)\]*_`]{0,3})\Z")
TEST_LOG = re.compile(r"\A\S+::\w+")
RULE = re.compile(r"=+ .* =+\Z")
CODE = re.compile(r'\A(?:#!|"""|\'\'\'|(?:async )?def \w|class \w|import \w|from \w+(?:\.\w+)* import|@\w)')
#: Endings of file names.
SUFFIXES = "py|pyi|md|rst|txt|log|json|jsonl|toml|yaml|yml|cfg|ini|sh|js|ts|html|css|csv|parquet|sql|lock|xml"
PATH = rf"(?:[\w.-]+/)*[\w.-]+\.(?:{SUFFIXES})(?::\d+)*"
#: A closing line is not longer; of a longer line its end is looked at, which may be a closing list of paths.
CLOSING_CHARS = 300
#: Lines that close a text without a full stop.
CLOSING = re.compile(
    rf"""\A(?:
    (?:.*[.!?:;,)]\s+)?(?:[-*]\ )?`?{PATH}`?
    |(?:see(?:\ also)?|refs?|ref|cc|closes|fixes|related|source|author|by|signed[- ]off(?:[- ]by)?|reviewed[- ]by|from|via|ps)\s*:\ .{{1,80}}
    |--+\s?.{{1,60}}
    |\([^()]{{3,80}}\)
    |\[[^\[\]]{{3,80}}\]
    |\+\d+
    |(?:many\ )?thanks(?:\ .{{1,30}})?|thank\ you(?:\ .{{1,30}})?|thx|cheers|regards|best|best\ regards|same\ here|me\ too|lgtm|done|solved|fixed|closed|ok|okay|agreed|bye
    |(?:solved|fixed|done|resolved|closed)\W{{1,3}}(?:closing|closed|thanks|done|solved)
    |end\ of\ \w+(?:\ \w+)?|the\ end|eof|no\ (?:further|more|other)\ \w+(?:\ \w+)?|nothing\ (?:else|more|further)(?:\ .{{1,20}})?
    |[^\w\s].*[^\w\s`(,;:/-]
    |[:;]-?[)D(]
    )\Z""",
    re.X | re.I,
)


STRING = re.compile(r'"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|#[^\n]*')
BLOCK = re.compile(r"^(?=(?:async )?def |class )", re.M)
STATEMENT = re.compile(r"(?: {2,}|\t+)(?:return|yield|raise|if|for|while|with|try|else|elif|assert|pass|def|class|import|from|\w+(?:\.\w+)*(?:\[[^\]]*\])?\s*(?:=|\())")


def function_ends(text: str) -> list[bool]:
    """Whether each function of a source ends with a return, raise, yield or pass, in order."""
    parts = [b.rstrip() for b in BLOCK.split(STRING.sub("0", text)) if b.startswith(("def ", "async def "))]
    return [b.rsplit("\n", 1)[-1].strip().startswith(("return", "raise", "yield", "pass")) for b in parts]


def code_cut(text: str, returns: bool = False) -> bool:
    """Code that breaks off: a bracket or string is open, the last line is an unfinished statement, or the last function stops short of the
    return that every other function of the text ends with, or all of the corpus (``returns``).  Read by characters, as sources of
    other dialects need not parse."""
    plain = STRING.sub("0", text)
    if '"' in plain or plain.count("'") % 2 or any(plain.count(a) > plain.count(b) for a, b in ("()", "[]", "{}")):
        return True
    parts = [b.rstrip() for b in BLOCK.split(plain) if b.strip()]
    last = parts[-1].rsplit("\n", 1)[-1].strip()
    if last.endswith((":", ",", "=", "+", "-", "*", "/", ".", "\\")):
        return True
    if re.fullmatch(r"return(?: \w+)?", last):
        name = last[7:]
        return bool(name) and name not in WORDS.findall(parts[-1])[:-1]
    if re.fullmatch(r"[A-Za-z_][\w.]*", last) and last not in ("pass", "break", "continue"):
        return True
    if not parts[-1].startswith(("def ", "async def ")) or last.startswith(("return", "raise", "yield", "pass")):
        return False
    others = function_ends(text)[:-1]
    return all(others) if others else returns


WORDS = re.compile(r"\w+")


def json_cut(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        lines = text.split("\n")
        try:
            for line in lines:
                json.loads(line)
        except (ValueError, RecursionError):
            return True
        return len(lines) < 2
    except RecursionError:
        return False
    return False


STOP = re.compile(r"[.!?。！？؟](?:\s|\Z)")
ITEM = re.compile(r"\s*(?:[-*+\u2022]|\d+[.)])\s+\S")
GREETING = re.compile(r"(?:[\w' ]{0,20}\s)?(?:regards|wishes|thanks|cheers|sincerely|greetings|yours(?: truly| sincerely)?|best),?\Z", re.I)
NAME_LINE = re.compile(r"[^\W\d_][\w.'-]*(?: [\w.'-]+){0,3}\Z")
VALUE_LINE = re.compile(r"[^\W\d_][\w -]{0,30}:\s*[-+]?[\d.,:/%]*\d[%]?\Z")
CLOCK = re.compile(r"\b\d{1,2}:\d{2}(?::\d{2})?\Z")


def closes_by_form(lines: list[str]) -> bool:
    """A text whose last line closes it by its form: a value with its name, a time of day, a heading, a name below a greeting, or an item of
    a list whose other items end without a mark as well, in a letter, digit or mark of the same kind, and are not longer by far."""
    last, above = lines[-1], lines[-2] if len(lines) > 1 else ""
    if VALUE_LINE.match(last) or CLOCK.search(last) or (last.startswith("#") and " " in last) or (GREETING.match(above) and NAME_LINE.match(last)):
        return True
    if not ITEM.match(last):
        return False
    items = [x for x in lines[-9:-1] if ITEM.match(x)]
    kind = lambda x: "w" if x[-1].isalnum() else x[-1]
    return bool(items) and all(not TERMINAL.search(x) and kind(x) == kind(last) for x in items) and len(last.split()) >= min(len(x.split()) for x in items)


def cut_reason(text: str | None, returns: bool = False) -> str | None:
    """Why a text is held to be cut: mark, record, log, code, structure or sentence; null if it is complete, null or blank.

    returns: whether the functions of the corpus end with a return."""
    t = (text or "").rstrip()
    if not t.strip():
        return None
    if t.endswith(MARKS):
        return "mark"
    begin = t.lstrip()
    if begin[0] == "{" or begin.startswith("[{"):
        return "record" if json_cut(begin) else None
    last = t.rsplit("\n", 1)[-1]
    if TEST_LOG.match(begin):
        return None if RULE.match(last.strip()) else "log"
    fenced = t.count("```")
    if CODE.match(begin) or (STATEMENT.match(last) and not fenced):
        return "code" if code_cut(begin, returns) else None
    line = last.strip()
    if fenced % 2 and not TERMINAL.search(line):
        return "structure"
    if not fenced % 2 and not line.startswith("```") and line.count("`") % 2:
        return "structure"
    if line.startswith("|"):
        above = t.rsplit("\n", 2)[-2].strip() if t.count("\n") else line
        return None if len(line) > 1 and line.endswith("|") and (not above.startswith("|") or line.count("|") == above.count("|")) else "structure"
    if line.startswith("```") or TERMINAL.search(line) or CLOSING.match(line[-CLOSING_CHARS:]) or closes_by_form([x.strip() for x in t[-4000:].split("\n") if x.strip()]):
        return None
    if "\n" in begin and not STOP.search(t):
        return None  # written without full stops
    return "sentence"


# -- the tables ------------------------------------------------------------------------------------------------------------------------


def prefixes(documents: DataFrame) -> DataFrame:
    """(fp, longer, longer_chars, goes_on): the fingerprint of every text that is a strict prefix of another, that of the shortest such text (of equal
    ones the least fingerprint), its length, and whether some longer text goes on inside a word."""
    texts = documents.filter("text is not null and length(trim(text)) > 0").select("text", F.xxhash64("text").alias("fp"), F.length("text").alias("n"))
    top = F.floor(F.log2("n")).cast("int")
    keys = F.transform(F.sequence(F.lit(0), top), lambda k: F.struct(k.alias("k"), F.xxhash64(F.substring("text", F.lit(1), F.pow(F.lit(2), k).cast("int"))).alias("key")))
    rows = texts.select("fp", "n", F.explode(keys).alias("x")).select("fp", "n", "x.k", "x.key").distinct()
    rows = written(rows, "prefix_keys")
    lengths = rows.filter(F.col("k") == F.floor(F.log2("n"))).groupBy("k", "key").agg(F.collect_set("n").alias("lengths"), F.min("n").alias("least"))
    asked = rows.join(lengths, ["k", "key"]).filter("least < n").groupBy("fp").agg(F.array_distinct(F.flatten(F.collect_list(F.filter("lengths", lambda x: x < F.col("n"))))).alias("lengths"))
    asked = written(asked, "lengths")
    one = texts.join(asked, "fp").dropDuplicates(["fp"])
    begin = lambda x: F.struct(F.xxhash64(F.substring("text", F.lit(1), x)).alias("fp"), x.alias("n"), F.substring("text", x, F.lit(2)).alias("seam"), (F.length(F.trim(F.substring("text", x + 1, F.col("n")))) > 0).alias("more"))
    begun = one.select(F.col("fp").alias("longer"), F.col("n").alias("longer_n"), F.explode(F.transform("lengths", begin)).alias("x")).select("longer", "longer_n", "x.*")
    whole = rows.filter("k = 0").select("fp", "n").distinct()
    on = F.col("more") & F.col("seam").rlike(r"^[\p{L}\p{N}]{2}$")
    found = begun.join(whole, ["fp", "n"]).groupBy("fp").agg(F.min(F.struct("longer_n", "longer")).alias("x"), F.bool_or(on).alias("goes_on"))
    return found.select("fp", "x.longer", F.col("x.longer_n").cast("bigint").alias("longer_chars"), "goes_on")


#: Where so many of the corpus' functions end with a return, one that does not has lost its end.
RETURNING = 0.98


def returning(documents: DataFrame) -> bool:
    """Whether the functions of the corpus end with a return (or raise, yield, pass): the share among all that another function or class follows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [e for batch in batches for t in batch.column(0).to_pylist() if t and "def " in t and CODE.match(t.lstrip()) for e in function_ends(t)[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array([len(ends)], pa.int64()), pa.array([sum(ends)], pa.int64())], ["n", "sound"])

    row = documents.select("text").mapInArrow(count, "n bigint, sound bigint").agg(F.sum("n"), F.sum("sound")).head()
    return bool(row[0]) and row[1] >= RETURNING * row[0]


def ends(documents: DataFrame) -> DataFrame:
    """(doc_id, source, fp, reason) of every document; reason is null where the end is sound."""
    returns = returning(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = [cut_reason(t, returns) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(reasons, pa.string())], ["doc_id", "source", "fp", "reason"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("fp"), "text")
    return rows.mapInArrow(run, "doc_id bigint, source string, fp bigint, reason string")


def cut_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, reason) of every cut document; reason is prefix where only the longer copy tells."""
    longer = prefixes(documents).filter("goes_on").select("fp").distinct().withColumn("prefix", F.lit("prefix"))
    return ends(documents).join(longer, "fp", "left").select("doc_id", "source", F.coalesce("reason", "prefix").alias("reason")).filter("reason is not null").distinct()


def prefix_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, longer_chars, goes_on) of every document whose text is a strict prefix of another."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("fp"))
    return rows.join(prefixes(documents), "fp").select("doc_id", "longer_chars", "goes_on").distinct()


def cut_report(documents: DataFrame) -> DataFrame:
    """(source, documents, cut, cut_share) of every source; a null source is a source."""
    every = documents.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"))
    cut = cut_documents(documents).groupBy(F.col("source").alias("s")).agg(F.count_distinct("doc_id").alias("cut"))
    return every.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "documents", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("documents")).alias("cut_share"))
