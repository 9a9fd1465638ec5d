"""Records that stand, exactly or almost, on both sides of the train split (problem 3).

The texts of the evaluation splits are held in compressed full-text indexes, one a shard of at most about SHARD_WORDS words: the Burrows-Wheeler order
of whole words, compressed, from which the tables of the search are made again where it is loaded.  All training text streams through every
shard.  Backward search gives for each place of a training record the evaluation places where its GRAM words up to there stand; the places are
looked up in order of their number of matches, the rarest first, up to a share of SEARCHED of a record's places.  Evaluation records found so are
candidates; they are verified on the whole bags of words, which the index holds as well, and matches with a verified record are merged into spans:
longest stretches of the training record of which all runs of GRAM words stand in the other one.

What is found is exact: every pair at least 0.8 alike of which more than 1 - SEARCHED of the training record's places stand in the other
record too.  A replaced word takes GRAM places, so all pairs whose differences are replaced words are found, however these are spread
(at 0.8 a fifth of the words, which leaves two fifths of the places); so are pairs with a word inserted after every four words, or in the
evaluation record after every three.  Skipping the most frequent places keeps boilerplate from being expanded; nothing else is skipped.

The work is training words times shards.  Held-out material is small beside training text, so shards are few; training text is neither
shuffled nor sent, the index of one shard at a time goes to all workers, and its size is bounded by SHARD_WORDS, beside a single record that is
longer.

Nulls and blanks count as no words; records under 20 words are in no pair; rows delivered twice count once; a record
without a split is not in train; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.bags import U64, arrow_columns, bags_of, blocks, expanded, words_of
from sparkcurate.llm.shared import written

GRAM, SEARCHED, SKETCH = 3, 0.7, 128
SHARD_WORDS = 1 << 22
#: So many matches are looked at at once.
SLICE = 1 << 21
LEAST_WORDS, LEAST_SIMILARITY = 20, 0.8

SCHEMA = "src string, id bigint, train boolean, fp bigint, n int, words binary"


def features(texts: DataFrame) -> DataFrame:
    """Side, fingerprint of the bag and words in order (32 bits each, other ones in every table) of every record with enough words;
    texts: src, id, split, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            srcs, keys, train, texts = arrow_columns(batch, "src", "id", "train", "text")
            for i, j in blocks(texts):
                ids, at = words_of(texts[i:j])
                n = np.diff(at)
                keep = np.flatnonzero(n >= LEAST_WORDS)
                if not len(keep):
                    continue
                bags = bags_of(ids, at, srcs[i:j])
                words = [((ids[at[k] : at[k + 1]] ^ U64(xxhash.xxh3_64_intdigest(srcs[i + k].encode()))) >> U64(32)).astype(np.uint32).tobytes() for k in keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([srcs[i + k] for k in keep], pa.string()),
                        pa.array([keys[i + k] for k in keep], pa.int64()),
                        pa.array([train[i + k] for k in keep], pa.bool_()),
                        pa.array([bags[k][0] for k in keep], pa.int64()),
                        pa.array(n[keep].astype(np.int32)),
                        pa.array(words, pa.binary()),
                    ],
                    names=["src", "id", "train", "fp", "n", "words"],
                )

    side = F.coalesce(F.col("split") == "train", F.lit(False)).alias("train")
    return texts.select("src", "id", side, "text").mapInArrow(run, SCHEMA)


def sketches(word: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many words of each of n texts fall in each of SKETCH parts of all words; a part of 255 holds this many or more."""
    return np.minimum(np.bincount(owner * SKETCH + word % SKETCH, minlength=n * SKETCH), 255).astype(np.uint8).reshape(n, SKETCH)


def may_be_similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether bags with the sketches x and y (a row a pair) can be at least LEAST_SIMILARITY alike; never false if they are."""
    shared, total = np.minimum(x, y).sum(axis=1, dtype=np.int64), x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64)
    return (2 * shared >= (LEAST_SIMILARITY - 1e-9) * total) | (np.maximum(x, y) == 255).any(axis=1)


# -- the index ---------------------------------------------------------------------------------------------------------------------------


def different(x: np.ndarray) -> np.ndarray:
    """The different values in ascending order."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The beginnings of all suffixes in their order, by doubling; every text ends in a mark of its own, so all suffixes differ.

    The rank of a suffix is the first place of those it is not yet told apart from; only these are sorted again."""
    n = len(text)
    order = np.argsort(text)
    rank, tied, key, width = np.empty(n, np.int64), np.arange(n), text[order], 0
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.flatnonzero(new)
        own = order[tied]
        rank[own] = np.repeat(tied[begin], np.diff(np.append(begin, len(tied))))
        tied = tied[~(new & np.append(new[1:], True))]
        if not len(tied):
            return order
        width = max(1, 2 * width)
        own = order[tied]
        after = np.where(own + width < n, rank[np.minimum(own + width, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + after
        by = np.argsort(key)
        order[tied], key = own[by], key[by]


def packed_index(names: list[int], texts: list[np.ndarray]) -> bytes:
    """The compressed index of texts (words as numbers of 32 bits): their words, names and lengths, and the word before each suffix in order."""
    m, lengths = len(texts), np.array([len(t) for t in texts], np.int64)
    every = np.concatenate(texts)
    words = different(every)
    number = np.searchsorted(words, every)
    end = np.cumsum(lengths + 1) - 1
    text = np.empty(int(lengths.sum()) + m, np.int64)
    inside = np.ones(len(text), bool)
    inside[end] = False
    text[end], text[inside] = np.arange(m), number + m
    before = text[suffix_order(text) - 1].astype(np.int32)
    out = io.BytesIO()
    np.savez_compressed(out, words=words, names=np.array(names, np.int64), lengths=lengths, before=before)
    return out.getvalue()


class TextIndex:
    """What the search needs, made from the packed index: ``keys`` holds (word, row) of the word before each row's suffix, in order, so the place of (word,
    row) in it is the row to which the word in front leads (one lookup gives the word's first row and its rank); texts are read back by
    walking from the marks, all of them at once."""

    def __init__(self, raw: bytes) -> None:
        with np.load(io.BytesIO(raw)) as packed:
            self.words, self.names, lengths, before = (packed[c] for c in ("words", "names", "lengths", "before"))
        self.m, self.n = len(self.names), len(before)
        self.keys = np.sort(before * np.int64(self.n) + np.arange(self.n))
        order = self.keys % self.n
        self.first = np.searchsorted(self.keys, np.arange(self.m + len(self.words) + 1) * np.int64(self.n))
        leads = np.empty(self.n, np.int64)
        leads[order] = np.arange(self.n)
        end = np.cumsum(lengths + 1) - 1
        self.begin = end - lengths
        self.owner = np.empty(self.n, np.int32)  # the text of each row
        at, which, place = np.arange(self.m), np.arange(self.m), end.copy()
        self.text = np.full(self.n, -1, np.int32)
        while len(at):
            self.owner[at] = which
            word = before[at]
            on = word >= self.m
            at, which, place = at[on], which[on], place[on] - 1
            self.text[place] = word[on]
            at = leads[at]
        spoken = self.text >= 0
        of = np.repeat(np.arange(self.m), lengths)
        every = np.sort(of * np.int64(self.n + 1) + self.text[spoken])
        key = different(every)
        self.count = np.diff(np.append(np.searchsorted(every, key), len(every)))
        self.bag_word, self.bag = key % (self.n + 1), np.searchsorted(key, np.arange(self.m + 1) * np.int64(self.n + 1))
        self.sizes = lengths
        self.sketch = sketches(self.words[self.text[spoken] - self.m].astype(np.int64), of, self.m)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Word numbers as in the index, -1 for words that are not in it."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at + self.m, -1)

    def rows(self, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(low, high): the rows of the suffixes that begin with these words; backward search, the last word first; a word a column."""
        low, high = np.zeros(len(grams[0]), np.int64), np.zeros(len(grams[0]), np.int64)
        alive = np.flatnonzero(reduce(np.logical_and, (g >= 0 for g in grams)))
        lo, hi = self.first[grams[-1][alive]], self.first[grams[-1][alive] + 1]
        for g in grams[-2::-1]:
            # lookups in order stay near each other in the table; the same words and rows are looked up once
            key = np.stack([g[alive] * np.int64(self.n) + x for x in (lo, hi)])
            order = np.argsort(key[0])
            key = key[:, order]
            new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]) if len(order) else np.empty(0, bool)
            which = np.cumsum(new) - 1
            lo, hi = (np.searchsorted(self.keys, k)[which] for k in key[:, new])
            alive = alive[order]
            some = hi > lo
            alive, lo, hi = alive[some], lo[some], hi[some]
        low[alive], high[alive] = lo, hi
        return low, high

    def candidates(self, number: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, text), each pair once: the texts that hold one of the rarest places of a query; number and owner: the queries' words in order."""
        size = max(0, len(number) - GRAM + 1)
        whole = np.flatnonzero(owner[:size] == owner[GRAM - 1 :])
        low, high = self.rows([number[whole + k] for k in range(GRAM)])
        # places that match nowhere are the rarest; only the others are put in order, places of the same words side by side
        places, some = np.bincount(owner[whole], minlength=n), np.flatnonzero(high > low)
        of, low, found = owner[whole][some], low[some], (high - low)[some]
        by = np.lexsort((low, of * np.int64(self.n + 1) + found))
        of, low, found = of[by], low[by], found[by]
        first = np.searchsorted(of, np.arange(n + 1))
        nth = np.arange(len(of)) - first[of] + (places - np.diff(first))[of]
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (low[1:] != low[:-1])
        take = (nth < (np.ceil(SEARCHED * places) + 1)[of]) & fresh
        of, low, found = of[take], low[take], found[take]
        pairs, i, upto = [], 0, np.cumsum(found)
        while i < len(of):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SLICE, "right")))
            c = found[i:j]
            row = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[i:j], c)
            pairs.append(different(np.repeat(of[i:j], c) * np.int64(self.m) + self.owner[row]))
            i = j
        both = different(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        return both // self.m, both % self.m

    def similarity(self, number: np.ndarray, text: int) -> float:
        own = slice(self.bag[text], self.bag[text + 1])
        word, count = np.unique(number, return_counts=True)
        at = np.minimum(np.searchsorted(self.bag_word[own], word), own.stop - own.start - 1)
        hit = self.bag_word[own][at] == word
        return 2 * int(np.minimum(count[hit], self.count[own][at[hit]]).sum()) / (len(number) + int(self.sizes[text]))

    def spans(self, number: np.ndarray, text: int) -> tuple[int, int]:
        """(spans, words in them) of the query's stretches of which all runs of GRAM words stand in the text."""
        own = self.text[self.begin[text] : self.begin[text] + self.sizes[text]].astype(np.int64)
        grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, GRAM) for x in (number, own)])
        code = np.zeros(len(grams), np.int64)
        for column in grams.T:
            code = np.unique(code * (self.n + self.m + 2) + column + 1, return_inverse=True)[1]
        places = len(number) - GRAM + 1
        held = np.isin(code[:places], code[places:]) & (grams[:places] >= 0).all(axis=1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2] + GRAM - 1
        # spans that overlap are one
        new = np.concatenate([[True], begin[1:] >= end[:-1]]) if len(begin) else np.empty(0, bool)
        covered = np.zeros(len(number) + 1, np.int64)
        np.add.at(covered, begin, 1)
        np.add.at(covered, end, -1)
        return int(new.sum()), int((np.cumsum(covered)[:-1] > 0).sum())


def indexes(held: DataFrame, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """(shard, index) of all evaluation records, one a fingerprint, and the number of shards; a shard is built by one task."""
    words = held.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    shards = max(1, -(-words // shard_words))
    rows = held.select(F.pmod(F.xxhash64("fp"), F.lit(shards)).cast("int").alias("shard"), "fp", "words")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, names, texts = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if names:
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([packed_index(names, texts)], pa.binary())], ["shard", "index"])

        for batch in batches:
            for s, fp, raw in zip(*arrow_columns(batch, "shard", "fp", "words")):
                if s != shard:
                    yield from done()
                    shard, names, texts = s, [], []
                names.append(fp)
                texts.append(np.frombuffer(raw, np.uint32))
        yield from done()

    return written(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, "shard int, index binary"), "index"), shards


#: The index a worker has loaded last, by a name.
LOADED: dict[str, TextIndex] = {}


def searched(train: DataFrame, index: bytes) -> DataFrame:
    """(a, b, spans, span_words): fingerprints of training records and evaluation records of one shard at least LEAST_SIMILARITY alike, but not of the
    same words."""
    shared = train.sparkSession.sparkContext.broadcast(index)
    name = xxhash.xxh3_128_hexdigest(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in LOADED:
            LOADED.clear()
            LOADED[name] = TextIndex(shared.value)
        own = LOADED[name]
        for batch in batches:
            fps, raw = arrow_columns(batch, "fp", "words")
            texts = [np.frombuffer(x, np.uint32) for x in raw]
            found = []
            for i, j in blocks(raw, 1024, 1 << 20):
                lengths = np.array([len(t) for t in texts[i:j]])
                owner, words = np.repeat(np.arange(j - i), lengths), np.concatenate(texts[i:j])
                number = own.numbers(words)
                query, text = own.candidates(number, owner, j - i)
                at = np.cumsum(lengths) - lengths
                of_query = sketches(words.astype(np.int64), owner, j - i)
                # the shorter of two similar bags has two thirds of the words of the longer one at least
                close = 3 * np.minimum(lengths[query], own.sizes[text]) >= 2 * np.maximum(lengths[query], own.sizes[text])
                query, text = query[close], text[close]
                for k in range(0, len(query), 1 << 12):
                    q, t = query[k : k + (1 << 12)], text[k : k + (1 << 12)]
                    maybe = np.flatnonzero(may_be_similar(of_query[q], own.sketch[t]))
                    for q, t in zip(q[maybe].tolist(), t[maybe].tolist()):
                        numbers = number[at[q] : at[q] + lengths[q]]
                        if own.names[t] != fps[i + q] and own.similarity(numbers, t) >= LEAST_SIMILARITY - 1e-12:
                            found.append((fps[i + q], int(own.names[t]), *own.spans(numbers, t)))
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(4)], ["a", "b", "spans", "span_words"])

    return train.select("fp", "words").mapInArrow(run, "a bigint, b bigint, spans bigint, span_words bigint")


def matches(feats: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(a, b, spans, span_words) over all shards, one after the other; training records of the same words in another order count with their longest spans."""
    held = feats.filter("not train").groupBy("fp").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    index, shards = indexes(held, shard_words)
    train = feats.filter("train")
    out = []
    for shard in range(shards):
        # one shard at a time: bounded by shard_words, whatever the data's size
        row = index.filter(F.col("shard") == shard).select("index").head()
        if row:
            out.append(written(searched(train, bytes(row[0])), "matches"))
    if not out:
        return feats.sparkSession.createDataFrame([], "a bigint, b bigint, spans bigint, span_words bigint")
    return reduce(DataFrame.unionByName, out).groupBy("a", "b").agg(F.max("spans").alias("spans"), F.max("span_words").alias("span_words"))


def overlaps(texts: DataFrame) -> DataFrame:
    """(src, train_id, other_id, spans, span_words): every pair of a train record and a record of another split, at least 0.8 alike.

    Spans and words are null for pairs with the same words."""
    feats = written(features(texts), "features")
    found = matches(feats)
    members = feats.select("src", "id", "fp", "train").distinct()
    same = members.groupBy("fp").agg(F.bool_or("train").alias("t"), F.bool_and("train").alias("all")).filter("t and not all")
    same = same.select(F.col("fp").alias("a"), F.col("fp").alias("b"), F.lit(None).cast("bigint").alias("spans"), F.lit(None).cast("bigint").alias("span_words"))
    left = members.filter("train").select("fp", "src", F.col("id").alias("train_id"))
    right = members.filter("not train").select("fp", F.col("id").alias("other_id"))
    return expanded(found.unionByName(same), left, right).select("src", "train_id", "other_id", "spans", "span_words")


def overlap_pairs(texts: DataFrame) -> DataFrame:
    """(src, id_a, id_b), id_a < id_b."""
    return overlaps(texts).select("src", F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b"))


def overlap_report(texts: DataFrame) -> DataFrame:
    """(src, split, source, records, pairs): how many records of each split and source overlap with train, and in how many pairs."""
    of = texts.select("src", F.col("id").alias("other_id"), "split", "source").groupBy("src", "other_id").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    return overlaps(texts).join(of, ["src", "other_id"]).groupBy("src", "split", "source").agg(F.count_distinct("other_id").alias("records"), F.count("*").alias("pairs"))
