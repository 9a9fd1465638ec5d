"""Defective answers (problem 2): empty, truncated, refusal, copy of the question, foreign language.

An answer is an assistant message directly after a user message.  Languages are told apart by naive Bayes over character trigrams, fitted on
about TRAIN_DOCUMENTS labelled documents at most; the answer's posterior is compared with that of its own question, and where that is too short to tell, with
that of all user questions of its conversation.  Truncation is told by the end-of-text n-gram likelihood (module endings), fitted on all
assistant messages, and by structures open at the end.  Refusals are read by their grammar (module refusals).
Each answer gets the first defect that applies, in the order empty, refusal, copy, language, truncated.

Messages of a session are put in order within blocks of BLOCK sequence numbers, and the last message of a block is joined to the next
block, so a session of any length is worked on by many tasks.  The repeated delivery of a message counts once.  Null contents are empty; null
roles are no role; messages without session or sequence number are left out; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.functions.textfn import norm_label
from sparkcurate.llm.bags import MIX1, U64, WORD, arrow_columns, blocks, mixed
from sparkcurate.llm.endings import codes_of, end_model, end_scores, open_structure
from sparkcurate.llm.refusals import is_refusal
from sparkcurate.llm.shared import written

BLOCK = 1024
GRAM_BITS = 15
TRAIN_DOCUMENTS = 20_000
#: A language needs this many labelled documents; a posterior this many trigrams and this logarithm of odds.
LEAST_DOCUMENTS, LEAST_GRAMS, LEAST_ODDS = 3, 12, 6.0
OWN_SHARE, COPY_COVER = 0.08, 0.6

# -- text of a natural language -------------------------------------------------------------------------------------------------------

NOT_NATURAL = re.compile(r"```.*?(?:```|\Z)|<tool_call>.*?(?:</tool_call>|\Z)|<tool_response>.*?(?:</tool_response>|\Z)|`[^`\n]*`|\"[^\"\n]*\"|«[^»\n]*»|„[^“”\n]*[“”]|“[^”\n]*”", re.S)
TECHNICAL = re.compile(r"[_/=(\[{<>\\@\d]")
TOOL_RESULT = re.compile(r"\s*(?:tool[ _]result\s*:|<tool_(?:response|result)>)", re.I)


def natural(text: str | None) -> str:
    """The text without code, calls, quotations, identifiers, paths and numbers; in lower case."""
    return " ".join(t for t in NOT_NATURAL.sub(" ", text).lower().split() if not TECHNICAL.search(t)) if text else ""


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of three characters that do not cross from one text to the next, and the text of each."""
    codes, ends = codes_of([f" {t} " for t in texts])
    n = len(codes) - 2
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = codes.astype(U64)
    h = mixed((x[:n] * MIX1 + x[1 : n + 1]) * MIX1 + x[2:])
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    keep = owner[:n] == owner[2:]
    return (h >> U64(64 - GRAM_BITS)).astype(np.int64)[keep], owner[:n][keep]


def language_model(documents: DataFrame, most: int = TRAIN_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [buckets, languages]) from about ``most`` documents with a language label, those with the least hashes of
    their ids; all if there are no more.  Labels are compared by their first two letters; rare and unknown ones are left out."""
    label = F.substring(F.lower(F.btrim(F.col("lang"))), 1, 2)
    rows = documents.select("doc_id", "text", label.alias("label")).filter("label is not null and text is not null and lower(trim(lang)) rlike '^[a-z]{2}([-_].*)?$'")
    n = rows.count()
    if n > most:
        rows = rows.filter(F.xxhash64("doc_id") < F.lit(int(-(1 << 63) + (1 << 64) * most / n)))
    rows = rows.select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), [natural(t) for t in batch.column(1).to_pylist()]
            for i, j in blocks(texts):
                bucket, owner = trigrams(texts[i:j])
                name = np.array(labels[i:j])
                for x in set(labels[i:j]):
                    total[x] = total.get(x, 0) + np.bincount(bucket[(name == x)[owner]], minlength=1 << GRAM_BITS)
                    docs[x] = docs.get(x, 0) + labels[i:j].count(x)
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * (len(at) + 1)), pa.array([-1, *at], pa.int64()), pa.array([docs[x], *n[at]], pa.int64())], ["label", "bucket", "n"])

    got = rows.mapInArrow(count, "label string, bucket bigint, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = got[got.bucket < 0]
    names = sorted(seen[seen.n >= LEAST_DOCUMENTS].label)
    table = np.full((1 << GRAM_BITS, len(names)), 0.5)
    for k, x in enumerate(names):
        own = got[(got.label == x) & (got.bucket >= 0)]
        table[own.bucket.to_numpy(), k] += own.n.to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def log_likelihoods(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood of each text in each language, trigrams of each text)."""
    bucket, owner = trigrams(texts)
    n = np.bincount(owner, minlength=len(texts))
    out = np.zeros((len(texts), table.shape[1]))
    some = np.flatnonzero(n)
    if len(some) and table.shape[1]:
        out[some] = np.add.reduceat(table[bucket], np.searchsorted(owner, some), axis=0)
    return out, n


def likelihoods(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Log likelihoods in each language; 0 in all for texts with too few trigrams to tell."""
    like, grams = (np.concatenate(x) for x in zip(*(log_likelihoods(texts[i:j], table) for i, j in blocks(texts, 512))))
    like[grams < LEAST_GRAMS] = 0
    return like


# -- the defects that show in an answer and its question ------------------------------------------------------------------------------

#: What stands for nothing.
STAND_INS = "n a|na|n/a|none|null|nil|nan|undefined|empty|nothing|no answer|no response|no content|no output|tbd|todo|blank|void|missing".split("|")
EMPTY_FENCE = re.compile(r"```[\w+-]*\s*```")
INVISIBLE = re.compile(r"[​-‏ -‮⁠-⁤﻿­]")


PLACEHOLDER = re.compile(r"[\[(<{][^\[\](){}<>]{1,60}[\])>}]\Z")
#: What a remark in brackets says when there is nothing.
NOTHING = re.compile(r"\b(?:no|none|empty|silence|silent|blank|nothing|null|missing|deleted|removed|redacted|omitted|pending|placeholder|tbd|todo)\b")


def is_empty(text: str | None) -> bool:
    """Nothing but blanks, marks, empty code blocks or a stand-in, alone or as a remark in brackets."""
    if text is None:
        return True
    t = INVISIBLE.sub("", EMPTY_FENCE.sub(" ", text)).strip().lower()
    words = WORD.findall(t)
    if not words:
        return True
    if len(words) > 6:
        return False
    if PLACEHOLDER.match(t):
        return bool(NOTHING.search(t))
    bare = t.strip("<>[](){}*_-—.…\"'` ")
    return bare in STAND_INS or bare.replace(".", "") == "na" or (" ".join(words) in STAND_INS and bare in {*STAND_INS, "n a"})


FRAME = {"you", "asked", "question", "your", "was", "the", "user", "asks", "so", "is"}


def is_copy(question: str | None, answer: str) -> bool:
    """All words of the answer but one in twelve (one at least) are the question's and most of the question is there, in any case,
    punctuation and order; an answer that quotes the question and goes on has more words of its own."""
    if not question or len(answer) > 3 * len(question) + 80:
        return False
    q, a = set(WORD.findall(question.lower())), WORD.findall(answer.lower())
    if len(a) < 3:
        return " ".join(a) == " ".join(WORD.findall(question.lower())) and len(a) > 0
    words = set(a)
    common = words & q
    own = words - q - FRAME
    return len(own) <= max(1, OWN_SHARE * len(words)) and len(common) >= COPY_COVER * len(q)


ATOM = re.compile(r"(?:`[^`\n]+`|[\w.-]*[/\\][\w./\\-]*\.\w{1,5}(?::\d+)*|\d[\d.,:%]*|[A-Za-z_]\w*(?:\.\w+)*\(\)?|[A-Za-z]+[.!]?|\w+_\w+)\Z")
CLOSER = re.compile(r"(?:[:;]-?[)D(]|done|thanks|cheers|shall i go on|[^\w\s]+)\W*\Z", re.I)


def is_truncated(text: str, score: float) -> bool:
    t = text.strip()
    if open_structure(t):
        return True
    last = t.rsplit("\n", 1)[-1].strip()
    if t[-1] in "…" or t.endswith(("...", "[...]")):
        return True
    if ATOM.match(t) or (last != t and CLOSER.match(last)):
        return False
    return score < 0


def judged(question: str | None, answer: str | None, score: float) -> tuple[str | None, str | None]:
    """(the defect before language is looked at, the one after)."""
    if is_empty(answer):
        return "empty", None
    if is_refusal(answer):
        return "refusal", None
    if is_copy(question, answer):
        return "copy", None
    return None, "truncated" if is_truncated(answer, score) else None


# -- the tables ------------------------------------------------------------------------------------------------------------------------


def turns_of_arrays(df: DataFrame, src: str, key: str) -> DataFrame:
    """(src, rec_id, pos, role, content, asked) of all user messages and answers in an array of messages; asked is the message before an answer."""
    rows = df.select(F.col(key).cast("string").alias("rec_id"), F.posexplode(F.transform("messages", lambda m: F.struct(norm_label(m["role"]).alias("role"), m["content"].alias("content")))).alias("pos", "m"), "messages")
    before = F.when(F.col("pos") > 0, F.get("messages", F.col("pos") - 1))
    rows = rows.select(F.lit(src).alias("src"), "rec_id", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content", norm_label(before["role"]).alias("role_before"), before["content"].alias("asked"))
    return kept(rows)


def kept(rows: DataFrame) -> DataFrame:
    return rows.filter("role = 'user' or (role = 'assistant' and role_before = 'user')").select("src", "rec_id", "pos", "role", "content", F.when(F.col("role") == "assistant", F.col("asked")).alias("asked"))


def turns_of_rows(df: DataFrame, src: str, session: str = "session_id", seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """The same of single messages in the order of seq within a session."""
    rows = df.select(F.col(session).alias("rec_id"), F.col(seq).alias("pos"), norm_label(F.col("role")).alias("role"), "content", F.floor(F.col(seq) / block).alias("block"))
    rows = rows.filter("rec_id is not null and pos is not null")
    # the last message of a block is needed in the next one, too; there is one row a block here
    last = rows.groupBy("rec_id", "block").agg(F.max("pos").alias("pos"))
    edges = written(last.withColumn("next", F.lead("block").over(Window.partitionBy("rec_id").orderBy("block"))).filter("next is not null"), "edges")
    if edges.isEmpty():
        rows = rows.withColumn("at", F.col("block"))
    else:
        both = F.when(F.col("next").isNull(), F.array("block")).otherwise(F.array("block", "next"))
        rows = rows.join(edges, ["rec_id", "block", "pos"], "left").withColumn("at", F.explode(both))
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    rows = rows.repartition(partitions, "rec_id", "at").groupBy("rec_id", "at", "pos").agg(F.first("block").alias("block"), F.first("role").alias("role"), F.first("content").alias("content"))
    before = F.lag(F.struct("role", "content")).over(Window.partitionBy("rec_id", "at").orderBy("pos"))
    rows = rows.withColumn("before", before).filter("at = block")
    return kept(rows.select(F.lit(src).alias("src"), "rec_id", "pos", "role", "content", F.col("before.role").alias("role_before"), F.col("before.content").alias("asked")))


def defects(turns: DataFrame, answers: DataFrame, documents: DataFrame) -> DataFrame:
    """(src, rec_id, pos, defect) of every defective answer.

    turns: as turns_of_arrays and turns_of_rows make them; answers: a column text of all assistant messages; documents: doc_id, text, lang."""
    names, table = language_model(documents)
    scores = end_model(answers)
    shared = turns.sparkSession.sparkContext.broadcast((table, scores))
    columns = [f"l{k}" for k in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, scores = shared.value
        for batch in batches:
            roles, contents, asked = arrow_columns(batch, "role", "content", "asked")
            if not roles:
                continue
            end = end_scores(contents, scores)
            first: list = [None] * len(roles)
            last: list = [None] * len(roles)
            texts, prompts = [""] * len(roles), [""] * len(roles)
            for k, role in enumerate(roles):
                if role == "assistant":
                    first[k], last[k] = judged(asked[k], contents[k], end[k])
                    if first[k] is None:
                        texts[k] = natural(contents[k])
                        prompts[k] = natural(asked[k]) if not TOOL_RESULT.match(asked[k] or "") else ""
                elif not TOOL_RESULT.match(contents[k] or ""):
                    texts[k] = natural(contents[k])
            like, of_prompt = likelihoods(texts, table), likelihoods(prompts, table)
            given = [None if r != "assistant" else k for r, k in zip(roles, decided(like))]
            arrays = [*batch.columns[:4], pa.array(first, pa.string()), pa.array(last, pa.string()), pa.array(given, pa.int32()), pa.array(decided(of_prompt), pa.int32()), *(pa.array(like[:, k].astype(np.float32)) for k in range(len(names)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["src", "rec_id", "pos", "role", "first", "last", "given", "prompt", *columns])

    schema = "src string, rec_id string, pos bigint, role string, first string, last string, given int, prompt int" + "".join(f", {c} float" for c in columns)
    rows = written(turns.select("src", "rec_id", "pos", "role", "content", "asked").mapInArrow(run, schema), "turns")
    asked = rows.filter("role = 'user'").groupBy("src", "rec_id").agg(*(F.sum(c).alias(c) for c in columns), F.count("*").alias("n"))
    second = F.element_at(F.sort_array(F.array(*columns), asc=False), 2) if len(names) > 1 else F.lit(0)
    best = F.greatest(*columns) if len(names) > 1 else F.lit(0)
    language = F.coalesce(*(F.when(F.col(c) == best, F.lit(k)) for k, c in enumerate(columns))) if len(names) > 1 else F.lit(None).cast("int")
    asked = asked.filter(best - second >= LEAST_ODDS).select("src", "rec_id", language.alias("asked_in"))
    answer = rows.filter("role = 'assistant'").select("src", "rec_id", "pos", "first", "last", "given", "prompt")
    foreign = F.when(F.col("given") != F.coalesce("prompt", "asked_in"), F.lit("language"))
    return answer.join(asked, ["src", "rec_id"], "left").select("src", "rec_id", "pos", F.coalesce("first", foreign, "last").alias("defect")).filter("defect is not null").distinct()


def decided(like: np.ndarray) -> list[int | None]:
    """The language of each text, by its place in the list; none where the odds against the second are too low."""
    if like.shape[1] < 2:
        return [None] * len(like)
    order = np.sort(like, axis=1)
    return [int(k) if sure else None for k, sure in zip(like.argmax(axis=1), order[:, -1] - order[:, -2] >= LEAST_ODDS)]
