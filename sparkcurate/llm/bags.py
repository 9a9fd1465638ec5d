"""Bags of words, their exact similarity, and the parts common to the operators on conversation pairs.

A word is a longest run of letters and digits in the lower-cased text.  A record's bag is its words with
multiplicity; the similarity of two bags is twice the shared words divided by the sum of their sizes, which is at
least 0.8 exactly if their weighted (multiset) Jaccard similarity is at least 2/3.

Records with the same bag share a 64-bit fingerprint ``fp`` (of the table name, words and counts); all work on pairs
is done once per fingerprint, so a group of copies of any size costs as much as one record until ids are joined back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.shared import written

WORD = re.compile(r"[^\W_]+")
U64 = np.uint64
#: Odd multipliers of the mixing steps.
MIX1, MIX2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


#: Bytes of ASCII text: letters in lower case, everything that separates words as 0; bytes of other letters stay.
FOLD = np.array([b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 or chr(b).isdigit() else 0 for b in range(256)], np.uint8)
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """base**i and base**-i modulo 2**64, made when first needed in a worker."""

    up: np.ndarray | None = None
    down: np.ndarray

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None or len(cls.up) < n:
            cls.up, cls.down = powers(BASE, max(n, BLOCK)), powers(pow(BASE, -1, 1 << 64), max(n, BLOCK))
        return cls.up[:n], cls.down


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of x mixed (finaliser of a multiply-xorshift hash)."""
    x = (x ^ (x >> U64(29))) * MIX1
    x = (x ^ (x >> U64(32))) * MIX2
    return x ^ (x >> U64(29))


def words_of(texts: list[str | None], spans: bool = False) -> tuple[np.ndarray, ...]:
    """The 64-bit hashes of the words of all texts, one after the other, and where each text's begin (one more at the end).

    With spans also the folded bytes of all texts, where words begin and end there.
    A word's hash is a polynomial of its UTF-8 bytes, taken from running sums over stretches of about BLOCK bytes.
    """
    raw = [(t if t.isascii() else " ".join(WORD.findall(t.lower()))).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    x = FOLD[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    if not len(x):
        none = np.empty(0, np.int64)
        return (np.empty(0, U64), np.zeros(len(texts) + 1, np.int64)) + ((x, none, none) if spans else ())
    inside = x != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]
    ids, i = np.empty(len(begin), U64), 0
    while i < len(begin):
        low = begin[i]
        j = max(i + 1, int(np.searchsorted(end, low + BLOCK, "right")))
        b, e = begin[i:j] - low, end[i:j] - low
        up, down = Powers.get(int(e[-1]))
        total = np.cumsum(x[low : low + e[-1]] * up)
        first = np.where(b > 0, total[b - 1], U64(0))
        ids[i:j] = mixed((total[e - 1] - first) * down[b] + (e - b).astype(U64))
        i = j
    found = ids, np.searchsorted(begin, at)
    return found + (x, begin, end) if spans else found


def word_ids(text: str | None) -> np.ndarray:
    return words_of([text])[0]


def blocks(texts: list[str | None], most: int = 64, size: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters, at most ``most`` texts; a longer text is a block of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and (i - begin >= most or total + n > size):
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def runs(ids: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of n words within each text, and the text of each; a text of fewer words gives none."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    h = ids[:m].copy()
    for k in range(1, n):
        h = (h * MIX1) ^ (h >> U64(31)) ^ ids[k : m + k]
    keep = owner[:m] == owner[n - 1 :]
    return mixed(h[keep]), owner[:m][keep]


def counted(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(57 high bits of the different hashes of each text in ascending order, their counts, their texts); under 128 texts."""
    key = np.sort((owner.astype(U64) << U64(57)) | (h >> U64(7)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    key, count = key[first], np.diff(np.append(first, len(key)))
    return key & U64((1 << 57) - 1), count, (key >> U64(57)).astype(np.int64)


def arrow_columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def shingle_counts(df: DataFrame, n: int, bits: int, least: int) -> tuple[np.ndarray, int]:
    """In how many different bags each shingle bucket occurs, over all records of df (columns src, text), and how many bags there are.

    Copies count once, so a group of copies does not make its own shingles look common.  The table has 2**bits counts (at most 16
    bits) whatever the data's size: that bounds what is collected and broadcast (512 KB at 16).  Shingles that share a bucket get
    the same, larger count, the same in every record.
    """
    size = 1 << bits

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            srcs, texts = arrow_columns(batch, "src", "text")
            for i, j in blocks(texts):
                ids, at = words_of(texts[i:j])
                keep = np.flatnonzero(np.diff(at) >= least)
                if not len(keep):
                    continue
                bags = bags_of(ids, at, srcs[i:j])
                h, _, owner = counted(*runs(ids, at, n))
                # several shingles of a text in one bucket count once
                key = np.sort((owner << bits) | (h & U64(size - 1)).astype(np.int64))
                key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
                cut = np.searchsorted(key >> bits, np.arange(j - i + 1))
                own = (key & (size - 1)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([bags[k][0] for k in keep], pa.int64()), pa.array([own[cut[k] : cut[k + 1]].tobytes() for k in keep], pa.binary())], ["fp", "buckets"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, records = np.zeros(size, np.int64), 0
        for batch in batches:
            records += batch.num_rows
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([records, *total[at]], pa.int64())], ["bucket", "n"])

    one = df.select("src", "text").mapInArrow(buckets, "fp bigint, buckets binary").groupBy("fp").agg(F.min("buckets").alias("buckets"))
    rows = one.select("buckets").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n_of = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    out = np.zeros(size, np.int64)
    out[bucket[bucket >= 0]] = n_of[bucket >= 0]
    return out, int(n_of[bucket < 0].sum())


def bags_of(ids: np.ndarray, at: np.ndarray, srcs: list[str]) -> list[tuple[int, bytes, bytes]]:
    """For each text: fingerprint, words (32 bits each, in ascending order) and counts."""
    h, count, owner = counted(ids, np.repeat(np.arange(len(at) - 1), np.diff(at)))
    cut = np.searchsorted(owner, np.arange(len(at)))
    short = (h >> U64(25)).astype(np.uint32)
    out = []
    for k, src in enumerate(srcs):
        own = slice(cut[k], cut[k + 1])
        n = count[own]
        x = xxhash.xxh3_64(src.encode())
        x.update(h[own].tobytes())
        x.update(n.astype(np.int32).tobytes())
        out.append((x.intdigest() - (1 << 63), short[own].tobytes(), n.astype(narrowest(n)).tobytes()))
    return out


def narrowest(n: np.ndarray) -> type:
    top = n.max(initial=0)
    return np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32


def counts_of(raw: bytes, n_words: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // max(n_words, 1) or 1]).astype(np.int64)


def dice(wa: bytes, ca: bytes, wb: bytes, cb: bytes) -> float:
    a, b = np.frombuffer(wa, np.uint32), np.frombuffer(wb, np.uint32)
    x, y = counts_of(ca, len(a)), counts_of(cb, len(b))
    total = x.sum() + y.sum()
    if not total:
        return 0.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    hit = b[at] == a if len(b) else np.zeros(len(a), bool)
    return float(2 * np.minimum(x[hit], y[at[hit]]).sum() / total)


def verified(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of fingerprints whose bags are at least so similar, with sim; bags: fp, words, counts.

    Only bags that some pair names go on; copies are merged on the map side first.  The names are written before, so that their size is
    known when the join with all bags is planned: while they are few they are broadcast, and no bag is shuffled for it.
    """
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "named")
    one = written(bags.select("fp", "words", "counts").join(named, "fp", "left_semi").groupBy("fp").agg(F.first("words").alias("words"), F.first("counts").alias("counts")), "bags")
    left = one.select(F.col("fp").alias("a"), F.col("words").alias("wa"), F.col("counts").alias("ca"))
    right = one.select(F.col("fp").alias("b"), F.col("words").alias("wb"), F.col("counts").alias("cb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *rest = arrow_columns(batch, "a", "b", "wa", "ca", "wb", "cb")
            sim = np.array([dice(*x) for x in zip(*rest)])
            keep = np.flatnonzero(sim >= least - 1e-12) if len(sim) else []
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array([float(sim[i]) for i in keep], pa.float64())], ["a", "b", "sim"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "ca", "wb", "cb").mapInArrow(check, "a bigint, b bigint, sim double")


#: A fingerprint with more members than this is cut into cells of about as many, each joined by a task of its own.
CELL = 2000


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame, cell: int = CELL) -> DataFrame:
    """pairs (a, b, ...) joined with the members of both: left (fp, ...) of a and right (fp, ...) of b, which share no other column name.

    Members of a fingerprint with very many are spread over cells by their hash, and its pairs are repeated for every cell, so no key of the
    joins has more than about ``cell`` rows on the members' side and no row is lost.
    """

    def crowded(members: DataFrame) -> DataFrame:
        return written(members.groupBy("fp").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells")).filter("cells > 1"), "cells")

    def keyed(members: DataFrame, crowd: DataFrame, key: str, part: str) -> DataFrame:
        rows = members.join(crowd, "fp", "left")
        own = F.pmod(F.xxhash64(*members.columns), F.coalesce("cells", F.lit(1))).cast("int")
        return rows.withColumn(part, own).drop("cells").withColumnRenamed("fp", key)

    of_a, of_b = crowded(left), crowded(right)
    if of_a.isEmpty() and of_b.isEmpty():
        return pairs.join(left.withColumnRenamed("fp", "a"), "a").join(right.withColumnRenamed("fp", "b"), "b")
    every = lambda: F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1))
    cells = pairs.join(of_a.withColumnRenamed("fp", "a"), "a", "left").withColumn("cell_a", every()).drop("cells")
    cells = cells.join(of_b.withColumnRenamed("fp", "b"), "b", "left").withColumn("cell_b", every()).drop("cells")
    return cells.join(keyed(left, of_a, "a", "cell_a"), ["a", "cell_a"]).join(keyed(right, of_b, "b", "cell_b"), ["b", "cell_b"]).drop("cell_a", "cell_b")
