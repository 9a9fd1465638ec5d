"""Documents into containers of fixed capacity by pattern packing (problem 5).

(1) One pass measures every text in tokens of a byte-level BPE vocabulary file.  A text larger than the capacity is cut into full
containers and a rest; no other text is split.  (2) The histogram of piece lengths (at most ``capacity`` rows, whatever the
data's size) goes to the driver: patterns of lengths that fill a container are enumerated, their repeat counts are fitted to
the histogram by non-negative least squares and rounded down, and what is left over is placed best-fit, longest first, again on
counts.  Patterns of two or three documents, as in the usual form of the method, would leave much space where texts are
short, so patterns go up to PATTERN_ITEMS documents.  Enumerated are, for every length, the two that fill best with it, and for
STEPS lengths spread evenly over the documents, all combinations of two of them, each up to so many times as fit, with the best third length.  (3) The plan says which ranks of a length go to which containers; pieces get
their rank within their length from counts of (length, salt) cells, so a very common length is ranked by many tasks.

Null and empty texts have no tokens and get no container.  A doc_id that occurs several times is several documents; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.llm.bags import arrow_columns
from sparkcurate.llm.shared import written

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN_ITEMS, STEPS, SWEEPS = 24, 24, 40
#: Pieces of one length are ranked in so many cells at least, and in more where a cell would hold over CELL_ROWS on average.
SALTS, CELL_ROWS = 64, 1_000_000

#: How this public vocabulary's tokenizer cuts text into pieces, in general and for ASCII text.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PIECES = re.compile(r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+""")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class PieceTokens(dict):
    """piece -> number of tokens, per worker; emptied when it grows beyond its bound."""

    BOUND = 500_000

    def __init__(self, path: str) -> None:
        super().__init__()
        self.encoding = encoding(path)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n

    def count(self, text: str) -> int:
        """Tokens of a text: pieces are tokenised one by one, so counts of pieces add up."""
        return sum(map(self.__getitem__, ASCII_PIECES.findall(text))) if text.isascii() else len(self.encoding.encode_ordinary(text))


@lru_cache(maxsize=2)
def piece_tokens(path: str) -> PieceTokens:
    return PieceTokens(path)


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every document; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_tokens(vocabulary)
        for batch in batches:
            ids, texts = arrow_columns(batch, "doc_id", "text")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([counter.count(t) if t else 0 for t in texts], pa.int64())], ["doc_id", "tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, tokens bigint")


def patterns(histogram: np.ndarray, capacity: int, steps: int = STEPS, items: int = PATTERN_ITEMS) -> list[dict[int, int]]:
    """Different patterns length -> times that fill a container, of at most ``items`` documents, the last places filled as well as can be."""
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        return []
    share = np.cumsum(histogram[lengths]) / histogram[lengths].sum()
    spread = [int(x) for x in np.unique(lengths[np.searchsorted(share, (np.arange(steps) + 0.5) / steps)])]
    found: dict[tuple, None] = {}

    def filled(own: list[int]) -> None:
        left = capacity - sum(own)
        while left > 0 and len(own) < items and (at := int(np.searchsorted(lengths, left, "right")) - 1) >= 0:
            own.append(int(lengths[at]))
            left -= int(lengths[at])
        found[tuple(sorted(own))] = None

    for x in lengths[::-1].tolist():
        filled([x])
        # what fits beside two of them, and beside one and half of the rest
        half = int(np.searchsorted(lengths, max(0, capacity - x) // 2, "right")) - 1
        if half >= 0:
            filled([x, int(lengths[half])])
    for x in spread:
        for y in spread:
            most = min((capacity - x) // y, items - 2)
            for k in {1, 2, 3, most // 2, most} if most > 0 else ():
                if 0 < k <= most:
                    filled([x] + [y] * k)
    return [{x: p.count(x) for x in set(p)} for p in found]


def fitted(histogram: np.ndarray, shapes: list[dict[int, int]], sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 with least squares |histogram - A x|, by coordinate descent (A's columns are the patterns), rounded
    down and cut to what the histogram holds."""
    left = histogram.astype(float)
    x = np.zeros(len(shapes))
    columns = [(np.array(list(p)), np.array(list(p.values()), float)) for p in shapes]
    for _ in range(sweeps):
        for k, (at, times) in enumerate(columns):
            step = max(-x[k], float(left[at] @ times) / float(times @ times))
            if step:
                x[k] += step
                left[at] -= step * times
    whole, rest = np.zeros(len(shapes), np.int64), histogram.astype(np.int64).copy()
    for k in np.argsort(-x, kind="stable"):
        at, times = columns[k]
        n = int(min(np.floor(x[k] + 1e-9), (rest[at] // times.astype(np.int64)).min()))
        if n > 0:
            whole[k] = n
            rest[at] -= n * times.astype(np.int64)
    return whole


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, ranks, first container, pieces of the length in each container) and the number of containers."""
    rows, used, containers = [], np.zeros(len(histogram), np.int64), 0
    shapes = patterns(histogram, capacity)
    free: dict[int, list[tuple[int, int]]] = {}  # space left -> (first container, containers)
    for shape, n in zip(shapes, fitted(histogram, shapes)):
        if n:
            for length, times in shape.items():
                rows.append((length, int(used[length]), int(n * times), containers, times))
                used[length] += n * times
            if (space := capacity - sum(a * b for a, b in shape.items())) > 0:
                free.setdefault(space, []).append((containers, int(n)))
            containers += int(n)
    spaces = sorted(free)
    for length in range(len(histogram) - 1, 0, -1):
        rest = int(histogram[length] - used[length])
        while rest:
            fits = next((s for s in spaces if s >= length and free.get(s)), None) if spaces else None
            if fits is None:
                each = capacity // length
                n = max(1, rest // each)
                take = min(rest, n * each)
                base, times, space, containers = containers, min(each, take), capacity - length * min(each, take), containers + n
            else:
                base, n = free[fits].pop()
                times, space = min(fits // length, max(1, rest // n)), 0
                if rest < n * times:
                    free[fits].append((base + rest, n - rest))
                    n = rest
                take, space = n * times, fits - length * times
                if not free[fits]:
                    del free[fits]
            rows.append((length, int(used[length]), take, base, times))
            used[length] += take
            rest -= take
            if space > 0:
                free.setdefault(space, []).append((base, n))
            spaces = sorted(free)
    return sorted(rows), containers


def packed(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, parts, tokens, container): every document, whole in one container or, if larger than that, in parts."""
    counts = written(token_counts(documents, vocabulary).filter("tokens > 0"), "tokens")
    parts = F.ceil(F.col("tokens") / capacity).cast("int")
    pieces = counts.withColumn("parts", parts).select("doc_id", "parts", "tokens", F.posexplode(F.sequence(F.lit(1), "parts")).alias("part", "_"))
    size = F.when(F.col("part") < F.col("parts") - 1, F.lit(capacity)).otherwise(F.col("tokens") - F.lit(capacity) * F.col("part")).cast("int")
    salts = max(SALTS, -(-counts.count() // CELL_ROWS))
    salt = F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int")
    pieces = pieces.select("doc_id", "part", "parts", size.alias("size"), salt.alias("salt"))
    cells = pieces.groupBy("size", "salt").agg(F.count("*").alias("n"))
    offsets = cells.select("size", "salt", (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("before"))
    own = cells.groupBy("size").agg(F.sum("n").alias("n")).toArrow()
    histogram = np.bincount(own.column("size").to_numpy(), own.column("n").to_numpy(), capacity + 1).astype(np.int64)
    rows, _ = plan(histogram, capacity)
    shared = documents.sparkSession.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 5))
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "part")) - 1 + F.col("before")
    # join and window have the same keys, so pieces (a few numbers each) are shuffled once
    ranked = pieces.join(offsets, ["size", "salt"]).select("doc_id", "part", "parts", "size", rank.alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("size", "rank"))
            key = table[:, 0] * (1 << 44) + table[:, 1]
            at = np.searchsorted(key, size * (1 << 44) + rank, "right") - 1
            container = table[at, 3] + (rank - table[at, 1]) // table[at, 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(size), pa.array(container)], ["doc_id", "part", "parts", "tokens", "container"])

    return ranked.mapInArrow(place, "doc_id bigint, part int, parts int, tokens bigint, container bigint")


def oversized(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id): documents that the packing had to split."""
    return packed(documents, capacity, vocabulary).filter("parts > 1 and part = 0").select("doc_id")


def packing_report(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(containers, pieces, tokens, fullest, used_share): how well the containers are filled."""
    each = packed(documents, capacity, vocabulary).groupBy("container").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return each.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max("tokens").alias("fullest"), (F.sum("tokens") / (F.count("*") * capacity)).alias("used_share")
    )
