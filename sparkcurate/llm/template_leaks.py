"""Held-out passages in a corpus, by template windows (problem 6).

Every word of a text is canonicalised by a function of the word alone: numbers, units and names become typed
placeholders, the other words stay.  A name is any word that is no literal word of the held-out material, where a word
is literal if it stands there in lower case, outside identifiers and paths, in at least two items.  A template window is WINDOW
canonical words with the pattern of which slots hold equal words.  Template windows are hash-joined between corpus and items, and the slots are
checked: with the same words in all slots the passage itself leaked (two texts with WINDOW consecutive words in common share such a window, so none is
missed), with other words in the slots of a window of at least LITERALS literal words, a re-parameterised item.  The join looks for template and words
together first; windows of equal templates and other words are expanded only where a template has enough literal words to say something, so windows
of placeholders alone meet nothing but themselves.

Item windows are broadcast only if the items' texts are under BROADCAST_CHARS characters; beyond that both sides are
joined by shuffle.  The table of literal words has a fixed number of bits.

Null and blank texts have no windows.  Documents and items with the same id more than once count once; copies of a
document are all reported; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.bags import MIX1, U64, arrow_columns, blocks, mixed, words_of

WINDOW, LITERALS = 12, 6
LEXICON_BITS = 18
LEAST_ITEMS = 2
BROADCAST_CHARS = 32_000_000
NUMBER, UNIT, NAME = U64(1), U64(2), U64(3)
UNITS = "ms s sec seconds second minute minutes min hour hours h day days kb mb gb tb bytes byte percent px ns us hz khz mhz ghz".split()
#: What stands apart from literal words: code in back quotes, identifiers, paths, calls.
QUOTED = re.compile(r"`[^`\n]*`")
TECHNICAL = re.compile(r"[_/=\[{<>\\]|\w[.(]\w")


def plain_words(text: str | None) -> set[str]:
    words = (t.strip(".,;:!?\"'()") for t in QUOTED.sub(" ", text or "").split() if not TECHNICAL.search(t))
    return {w for w in words if w.isalpha() and w == w.lower()}


def lexicon(items: DataFrame) -> np.ndarray:
    """Buckets of literal words as a table of 2**LEXICON_BITS booleans; items: a column text."""
    size = 1 << LEXICON_BITS

    def literal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out.append(np.unique(words_of([" ".join(plain_words(text))])[0] & U64(size - 1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.empty(0, np.int64))], ["bucket"])

    table = np.zeros(size, bool)
    table[items.select("text").mapInArrow(literal, "bucket bigint").groupBy("bucket").count().filter(F.col("count") >= LEAST_ITEMS).toArrow().column("bucket").to_numpy()] = True
    return table


def canonical(texts: list[str | None], literal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, canonical words, and where each text's begin."""
    ids, at, raw, begin, end = words_of(texts, spans=True)
    digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    number = digits[end] - digits[begin] == end - begin
    unit = np.isin(ids, words_of([" ".join(UNITS)])[0])
    return ids, np.where(number, NUMBER, np.where(unit, UNIT, np.where(literal[(ids & U64(len(literal) - 1)).astype(np.intp)], ids, NAME))), at


def rolled(values: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(values[0]), U64)
    for v in values:
        h = (h * MIX1) ^ (h >> U64(31)) ^ v
    return mixed(h)


def windows(texts: list[str | None], literal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, hash of the words, whether there are LITERALS literal words, text) of all windows; the template holds which slots are equal."""
    ids, words, at = canonical(texts, literal)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    m = len(ids) - WINDOW + 1
    if m <= 0:
        return np.empty(0, U64), np.empty(0, U64), np.empty(0, bool), np.empty(0, np.int64)
    keep = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
    cut = [keep + k for k in range(WINDOW)]
    # how far back the same word last stood, as far as it is in the window
    order = np.argsort(ids, kind="stable")
    back = np.zeros(len(ids), np.int64)
    same = ids[order][1:] == ids[order][:-1]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    slot = (words == NUMBER) | (words == NAME)
    n_literal = np.concatenate([[0], np.cumsum(~slot)])
    values = [words[c] + np.where(slot[c] & (back[c] <= k), back[c], 0).astype(U64) * U64(8) for k, c in enumerate(cut)]
    return rolled(values), rolled([ids[c] for c in cut]), n_literal[keep + WINDOW] - n_literal[keep] >= LITERALS, owner[keep]


WINDOWS = "id bigint, template bigint, words bigint, telling boolean"


def window_rows(df: DataFrame, literal: np.ndarray) -> DataFrame:
    """(id, template, words, telling) of all windows of df (id, text), once per text."""
    shared = df.sparkSession.sparkContext.broadcast(literal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = arrow_columns(batch, "id", "text")
            keys = np.array(ids, np.int64)
            for i, j in blocks(texts):
                template, words, telling, owner = windows(texts[i:j], shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i + owner]), pa.array(template.view(np.int64)), pa.array(words.view(np.int64)), pa.array(telling)], ["id", "template", "words", "telling"])

    return df.select("id", "text").filter("id is not null").mapInArrow(run, WINDOWS).distinct()


def leaks(documents: DataFrame, items: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id, same, changed): pairs with common template windows, how many different ones have the same words and how many have
    other words in the slots."""
    docs = documents.select(F.col("doc_id").alias("id"), "text")
    held = items.select(F.col("item_id").alias("id"), F.col("item_text").alias("text"))
    literal = lexicon(held)
    of_items = window_rows(held, literal)
    chars = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    if chars <= broadcast_chars:
        found = probed(docs, literal, of_items)
    else:
        own = window_rows(docs, literal).withColumnRenamed("id", "doc_id")
        named = of_items.withColumnsRenamed({"id": "item_id", "words": "item_words"})
        equal = own.join(named.withColumnRenamed("item_words", "words").drop("telling"), ["template", "words"]).select("doc_id", "item_id", "template", F.lit(True).alias("equal"))
        other = own.filter("telling").join(named.filter("telling").drop("telling"), "template").filter("words <> item_words").select("doc_id", "item_id", "template", F.lit(False).alias("equal"))
        found = equal.unionByName(other)
    count = lambda test: F.count_distinct(F.when(test, F.col("template")))
    return found.groupBy("doc_id", "item_id").agg(count(F.col("equal")).alias("same"), count(~F.col("equal")).alias("changed"))


def spread_out(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, place) of all places of the ranges low to high."""
    count = high - low
    return np.repeat(np.arange(len(low)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def probed(docs: DataFrame, literal: np.ndarray, of_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, template, equal) through a broadcast table of the items' windows, in order of template and words together and of
    the templates that tell something."""
    got = of_items.toArrow()
    item, template, words, telling = (got.column(k).to_numpy(zero_copy_only=False) for k in ("id", "template", "words", "telling"))
    both = mixed(template.view(U64) * MIX1 ^ words.view(U64))
    at, some = np.argsort(both), np.flatnonzero(telling)
    some = some[np.argsort(template[some])]
    shared = docs.sparkSession.sparkContext.broadcast((literal, both[at], item[at], template[some], words[some], item[some]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        literal, both, item, template, words, of = shared.value
        for batch in batches:
            ids, texts = arrow_columns(batch, "id", "text")
            keys = np.array(ids, np.int64)
            for i, j in blocks(texts):
                own, own_words, own_telling, owner = windows(texts[i:j], literal)
                key = mixed(own * MIX1 ^ own_words)
                which, place = spread_out(np.searchsorted(both, key), np.searchsorted(both, key, "right"))
                rows = [np.stack([keys[i + owner[which]], item[place], own[which].view(np.int64), np.ones(len(which), np.int64)])]
                ask = np.flatnonzero(own_telling)
                t, w = own[ask].view(np.int64), own_words[ask].view(np.int64)
                which, place = spread_out(np.searchsorted(template, t), np.searchsorted(template, t, "right"))
                ok = words[place] != w[which]
                which, place = which[ok], place[ok]
                rows.append(np.stack([keys[i + owner[ask[which]]], of[place], t[which], np.zeros(len(which), np.int64)]))
                found = np.concatenate(rows, axis=1)
                if found.size:
                    found = np.unique(found, axis=1)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in found[:3]), pa.array(found[3] > 0)], ["doc_id", "item_id", "template", "equal"])

    return docs.filter("id is not null").mapInArrow(run, "doc_id bigint, item_id bigint, template bigint, equal boolean")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, split, documents, reparameterised): every item with the number of documents that hold passages of it, and of those that
    hold only passages with other words in the slots."""
    found = leaks(documents, items)
    count = found.groupBy("item_id").agg(F.count_if(F.col("same") > 0).alias("documents"), F.count_if(F.col("same") == 0).alias("reparameterised"))
    one = items.groupBy("item_id").agg(F.min("suite").alias("suite"), F.min("split").alias("split"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return one.join(count, "item_id", "left").select("item_id", "suite", "split", none("documents"), none("reparameterised"))
