"""How texts end: a model of end-of-text n-grams, and structures that are still open at the end.

A place in a text has two n-grams: the SHAPE characters before it by class (letters, digits, blanks and line breaks are one class each, any other
character is its own), and the LONG characters before it as they are, in lower case.  The model counts shapes at the ends of texts and at all places,
and likewise the long n-grams that at least one of MOST ends has, which are MOST at most.  The likelihood of an end after a shape is its share of ends;
that after such a long n-gram is its own share of ends, smoothed by PRIOR places that end as often as the shape does, so that it tells where it is
well attested ("thanks").  A text that was counted is left out of its own counts.  The score of an end is the logarithm of the odds of an end there
against those anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.bags import MIX1, U64, blocks, mixed

SHAPE, SHAPE_BITS = 3, 14
LONG, MOST, PRIOR = 6, 10_000, 500
LETTER, DIGIT, BLANK, LINE = 1, 2, 3, 4
#: What makes a score: the counts are smoothed by this many shapes.
SMOOTH = 0.5


def classes() -> np.ndarray:
    """The class of each character of the basic plane; others count as themselves."""
    out = np.arange(1 << 16, dtype=np.uint32) + 16
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            out[i] = LETTER
        elif c.isdigit():
            out[i] = DIGIT
        elif c == "\n":
            out[i] = LINE
        elif c.isspace():
            out[i] = BLANK
    return out


_CLASSES: list[np.ndarray] = []


def class_of(codes: np.ndarray) -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(classes())
    return np.where(codes < 1 << 16, _CLASSES[0][np.minimum(codes, (1 << 16) - 1)], codes + np.uint32(16))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts as numbers, and where each text ends."""
    joined = "".join(texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([len(t) for t in texts])


def buckets_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of the shape and the hash of the long n-gram before the end of each character, and the index of each text's last character; line breaks
    stand before each text."""
    codes, ends = codes_of(["\n" * LONG + t for t in texts])
    inside = np.ones(len(codes), bool)
    inside[(np.concatenate([[0], ends[:-1]])[:, None] + np.arange(LONG)).ravel()] = False
    kind = class_of(codes).astype(U64)
    lower = np.where((codes >= 65) & (codes <= 90), codes | 32, codes).astype(U64)

    def hashed(x: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(x), U64)
        for k in range(n):
            h = h * MIX1 + np.concatenate([np.zeros(min(k, len(x)), U64), x[: max(0, len(x) - k)]]) + U64(k)
        return mixed(h[inside])

    return (hashed(kind, SHAPE) >> U64(64 - SHAPE_BITS)).astype(np.int64), hashed(lower, LONG), np.cumsum([len(t) for t in texts]) - 1


def bare_end(text: str | None) -> str:
    """The text without white space at its end; '' for texts too short for a shape."""
    t = (text or "").rstrip()
    return t if len(t) >= SHAPE else ""


class Grams:
    """The places of known hashes in their order; most others are ruled out by a bit table first."""

    BITS = 20

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.known = np.zeros(1 << self.BITS, bool)
        self.known[(self.hashes >> U64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in x, place) of the known ones."""
        maybe = np.flatnonzero(self.known[(x >> U64(64 - self.BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, x[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == x[maybe] if len(maybe) else np.zeros(0, bool)
        return maybe[hit], at[hit]


class EndModel:
    """Counts (ends, places) of shapes and of the known long n-grams."""

    def __init__(self, grams: Grams, shape: np.ndarray, long: np.ndarray) -> None:
        self.grams, self.shape, self.long = grams, shape, long
        # one end and place more, for corpora without any
        self.share = (float(shape[0].sum()) + SMOOTH) / (float(shape[1].sum()) + SMOOTH / LEAST_SHARE)

    def scores(self, shape: np.ndarray, long: np.ndarray) -> np.ndarray:
        ends, places = np.maximum(self.shape[:, shape] - 1, 0)
        p = (ends + SMOOTH * self.share) / (places + SMOOTH)
        at, gram = self.grams.find(long)
        ends, places = np.maximum(self.long[:, gram] - 1, 0)
        p[at] = (ends + PRIOR * p[at]) / (places + PRIOR)
        p = np.clip(p, 1e-12, 1 - 1e-6)
        return (np.log(p / (1 - p)) - np.log(self.share / (1 - self.share))).astype(np.float32)


#: The share of ends among the places of a corpus without texts.
LEAST_SHARE = 1e-3


def frequent_ends(df: DataFrame) -> Grams:
    """The long n-grams that end at least one in MOST texts."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [e[-LONG:] for t in batch.column(0).to_pylist() if (e := bare_end(t))]
            if texts:
                _, long, end = buckets_of(texts)
                yield pa.RecordBatch.from_arrays([pa.array(long[end].view(np.int64))], ["gram"])

    counts = df.select("text").mapInArrow(last, "gram bigint").groupBy("gram").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    often = counts.crossJoin(F.broadcast(total)).filter(F.col("n") * MOST >= F.col("total")).select("gram")
    return Grams(often.toArrow().column("gram").to_numpy().view(U64))


def end_model(df: DataFrame) -> EndModel:
    """The model of all texts of df (a column text); at most 2**SHAPE_BITS + MOST rows are collected."""
    grams = frequent_ends(df)
    sizes = (1 << SHAPE_BITS, len(grams.hashes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, longs = (np.zeros((2, n), np.int64) for n in sizes)
        for batch in batches:
            texts = [e for t in batch.column(0).to_pylist() if (e := bare_end(t))]
            for i, j in blocks(texts, 1024, 1 << 19):
                shape, long, end = buckets_of(texts[i:j])
                shapes[0] += np.bincount(shape[end], minlength=sizes[0])
                shapes[1] += np.bincount(shape, minlength=sizes[0])
                longs[0] += np.bincount(grams.find(long[end])[1], minlength=sizes[1])
                longs[1] += np.bincount(grams.find(long)[1], minlength=sizes[1])
        for kind, table in enumerate((shapes, longs)):
            at = np.flatnonzero(table[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(table[0][at]), pa.array(table[1][at])], ["kind", "bucket", "ends", "places"])

    rows = df.select("text").mapInArrow(count, "kind int, bucket bigint, ends bigint, places bigint").groupBy("kind", "bucket").agg(F.sum("ends").alias("ends"), F.sum("places").alias("places")).toArrow()
    kind, at, ends, places = (rows.column(c).to_numpy() for c in ("kind", "bucket", "ends", "places"))
    out = [np.zeros((2, n)) for n in sizes]
    for k, table in enumerate(out):
        table[0][at[kind == k]], table[1][at[kind == k]] = ends[kind == k], places[kind == k]
    return EndModel(grams, *out)


def end_scores(texts: list[str | None], model: EndModel) -> np.ndarray:
    """The score of each text's end; 0 for texts without one."""
    out = np.zeros(len(texts), np.float32)
    bare = [bare_end(t)[-64:] for t in texts]
    own = [k for k, t in enumerate(bare) if t]
    if own:
        shape, long, last = buckets_of([bare[k] for k in own])
        out[own] = model.scores(shape[last], long[last])
    return out


FENCE = re.compile(r"^[ \t>]*```", re.M)
PAIRS = (("<tool_call>", "</tool_call>"), ("<tool_response>", "</tool_response>"), ("<tool_result>", "</tool_result>"))


def open_structure(text: str) -> bool:
    """A code fence or tool call is open at the end, or the last line has an open code span."""
    if any(text.count(a) > text.count(b) for a, b in PAIRS):
        return True
    if len(FENCE.findall(text)) % 2:
        return True
    last = text.rstrip().rsplit("\n", 1)[-1]
    return "```" not in last and last.count("`") % 2 == 1
