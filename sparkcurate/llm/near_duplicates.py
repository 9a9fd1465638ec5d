"""Near-duplicate records by improved consistent weighted sampling (problem 1).

Plan: (1) one pass counts in how many different bags each two-word shingle bucket occurs, in a table of fixed size; (2) one
pass tokenises, weighs shingles by tf-idf and draws SAMPLES consistent weighted samples a record: two records agree in
a sample with a probability equal to their weighted Jaccard similarity; the samples form BANDS bands of ROWS, each sample in two.
Records of one bag of words are one fingerprint from here on.  (3) Records that share a band are candidates; (4) every candidate
is verified on the whole bags: weighted Jaccard similarity of the word counts of at least 2/3, which is the same as a similarity
(Dice) of at least 0.8.

Two-word shingles are used, not five-word ones, because the similarity asked for is one of words: with edits spread
evenly, records with four fifths of their words in common may share few runs of five.

A band that very many different bags share (more than HOT) is not expanded into pairs; its records go through an exact
prefix filter instead: two bags of Jaccard similarity t share at least one of their first n - ceil(t n) + 1 words in any
fixed order of all words, here the order of rarity.  A word in the prefixes of very many bags is joined in cells.  So no pair is lost
there, and no task gets an unbounded group.

Nulls and blanks count as no words; records under 20 words are in no pair; a row delivered twice counts once; extra
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.bags import CELL, MIX1, U64, arrow_columns, bags_of, blocks, counted, counts_of, expanded, mixed, runs, shingle_counts, verified, words_of
from sparkcurate.llm.shared import written

SHINGLE, BUCKET_BITS = 2, 16
BANDS, ROWS, SAMPLES = 60, 3, 90
#: The samples of each band: three neighbours, and three a third of all samples apart; two bands share at most one sample.
PARTS = np.concatenate([np.arange(SAMPLES).reshape(-1, ROWS), np.arange(SAMPLES).reshape(ROWS, -1).T])
LEAST_WORDS, LEAST_SIMILARITY = 20, 0.8
HOT = 1000


def gamma2_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of n equal parts."""
    p = (np.arange(n) + 0.5) / n
    x = np.where(p < 0.5, np.sqrt(2 * p), 1 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), 1e-9)
    return x


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010) of weighted sets of 64-bit keys.

    For each sample and key, r and c follow gamma(2, 1) and beta is uniform, all from the key's hash alone; with
    t = floor(ln w / r + beta), the key with the least ln c - r (t - beta + 1) is drawn, and (key, t) is the sample.
    That least value is itself an almost unique name of (sample, key, t), so it serves as the sample.
    """

    def __init__(self, samples: int, seed: int = 1) -> None:
        q = gamma2_quantiles()
        self.r, self.ln_c = q.astype(np.float32), np.log(q).astype(np.float32)
        self.inv_r = (1 / q).astype(np.float32)
        self.odd = mixed(np.arange(1, samples + 1, dtype=U64) * U64(0x1F123BB5) + U64(seed)) | U64(1)

    def draw(self, keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples of several sets at once, as bits: uint32 [samples, sets]; starts: where each (not empty) set begins."""
        ln_w = np.log(weights).astype(np.float32)
        out = np.empty((len(self.odd), len(starts)), np.float32)
        for i, odd in enumerate(self.odd):
            h = (keys * odd).view(np.uint16).reshape(-1, 4)
            at = h[:, 3].astype(np.intp)
            beta = h[:, 1].astype(np.float32)
            beta *= np.float32(1 / 65536)
            t = self.inv_r.take(at)
            t *= ln_w
            t += beta
            np.floor(t, out=t)
            t -= beta
            t += np.float32(1)
            t *= self.r.take(at)
            np.subtract(self.ln_c.take(h[:, 2]), t, out=t)
            out[i] = np.minimum.reduceat(t, starts)
        return out.view(np.uint32)


SCHEMA = "src string, id bigint, n int, fp bigint, words binary, counts binary, sample binary"
ARROW = pa.schema([("src", pa.string()), ("id", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("sample", pa.binary())])


def features(texts: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """src, id, n, fingerprint, bag and samples (16 bits each) of every record with enough words; texts: src, id, text."""
    seen, records = shingle_counts(texts, SHINGLE, BUCKET_BITS, least_words)
    idf = np.log(1 + records / np.maximum(seen, 1)).astype(np.float64)
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, weight = Sampler(SAMPLES), shared.value
        for batch in batches:
            srcs, keys, texts = arrow_columns(batch, "src", "id", "text")
            for i, j in blocks(texts):
                ids, at = words_of(texts[i:j])
                n = np.diff(at)
                keep = np.flatnonzero(n >= least_words)
                if not len(keep):
                    continue
                src = srcs[i:j]
                bags = bags_of(ids, at, src)
                h, tf, owner = counted(*runs(ids, at, SHINGLE))
                ok = (n >= least_words)[owner]
                h, tf, owner = h[ok], tf[ok], owner[ok]
                s = sampler.draw(mixed(h), tf * weight[(h & U64((1 << BUCKET_BITS) - 1)).astype(np.intp)], np.searchsorted(owner, keep))
                salt = np.array([xxhash.xxh3_64_intdigest(src[k].encode()) for k in keep], U64)
                low = mixed(s.astype(U64) ^ salt).astype(np.uint16).T.copy()  # tables share no samples
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([src[k] for k in keep], pa.string()),
                        pa.array([keys[i + k] for k in keep], pa.int64()),
                        pa.array(n[keep].astype(np.int32)),
                        *(pa.array([bags[k][c] for k in keep], kind) for c, kind in ((0, pa.int64()), (1, pa.binary()), (2, pa.binary()))),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    schema=ARROW,
                )

    return texts.select("src", "id", "text").mapInArrow(run, SCHEMA)


def bands_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, fp) of every (fp, sample): the hash of a band's number and its samples."""
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for i in range(0, len(fp), 2048):
            own = fp[i : i + 2048]
            s = np.frombuffer(b"".join(batch.column(1)[i : i + 2048].to_pylist()), np.uint16).reshape(len(own), SAMPLES).astype(U64)
            x = (s[:, PARTS[:, 0]] << U64(32)) | (s[:, PARTS[:, 1]] << U64(16)) | s[:, PARTS[:, 2]]
            x = mixed(mixed(x) ^ np.arange(1, BANDS + 1, dtype=U64))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64).ravel()), pa.array(np.repeat(own, BANDS))], ["band", "fp"])


def pairs_in_order(hot: int):
    """A function over (band, fp) in order of band and fp: (a, b), a < b, for every two fingerprints of a band; of a band of more than ``hot`` only (fp, null)
    for each.  A task holds no more than one batch and ``hot`` rows of the band before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(band: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            begin = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
            size = np.diff(np.append(begin, len(band)))
            for n in np.unique(size[(size > 1) & (size <= hot)]):
                first = begin[size == n]
                i, j = np.triu_indices(n, 1)
                for k in range(0, len(first), max(1, (1 << 20) // len(i))):
                    at = first[k : k + max(1, (1 << 20) // len(i)), None]
                    yield pa.RecordBatch.from_arrays([pa.array(fp[at + i].ravel()), pa.array(fp[at + j].ravel())], ["a", "b"])
            crowd = np.repeat(size > hot, size)
            if crowd.any():
                yield pa.RecordBatch.from_arrays([pa.array(fp[crowd]), pa.nulls(int(crowd.sum()), pa.int64())], ["a", "b"])

        band, fp, running = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            band, fp = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((band, fp)))
            if running is not None:  # a band already found to be crowded goes on
                more = int(np.searchsorted(band != running, True))
                yield pa.RecordBatch.from_arrays([pa.array(fp[:more]), pa.nulls(more, pa.int64())], ["a", "b"])
                band, fp = band[more:], fp[more:]
                running = running if not len(band) else None
            if len(band):
                last = int(np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))[-1])
                yield from of(band[:last], fp[:last])
                band, fp = band[last:], fp[last:]
                if len(band) > hot:
                    running = band[0]
                    yield from of(band, fp)
                    band, fp = band[:0], fp[:0]
        yield from of(band, fp)

    return run


def band_pairs(feats: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b of fingerprints that share a band, fingerprints of bands shared by more than ``hot``): one shuffle of (band, fingerprint),
    once per fingerprint."""
    one = feats.groupBy("fp").agg(F.first("sample").alias("sample"))
    rows = one.select("fp", "sample").mapInArrow(bands_of, "band bigint, fp bigint").repartition("band").sortWithinPartitions("band", "fp")
    found = written(rows.select("band", "fp").mapInArrow(pairs_in_order(hot), "a bigint, b bigint").distinct(), "bands")
    return found.filter("b is not null"), found.filter("b is null").select(F.col("a").alias("fp"))


def elements(words: bytes, counts: bytes, src: str) -> np.ndarray:
    """The k-th time of a word in a bag of a table as an element of its own, which makes the multiset a set."""
    own = np.frombuffer(words, np.uint32)
    every = np.repeat(own.astype(np.int64), counts_of(counts, len(own)))
    nth = np.arange(len(every)) - np.searchsorted(every, every)
    return mixed(every.astype(U64) * MIX1 + nth.astype(U64) + U64(xxhash.xxh3_64_intdigest(src.encode())))


def prefix_pairs(feats: DataFrame, some: DataFrame, least: float = LEAST_SIMILARITY, cell: int = CELL) -> DataFrame:
    """All pairs among the fingerprints ``some`` of one table that can reach the similarity: those that share a word of their prefixes
    and whose sizes allow it.  Exact, for bags that no band can tell apart.

    Rarity is counted in 2**BUCKET_BITS buckets of words, over the bags in question."""
    t = least / (2 - least)
    size = 1 << BUCKET_BITS
    bags = written(feats.select("src", "fp", "n", "words", "counts").join(some, "fp", "left_semi").groupBy("fp").agg(*(F.first(c).alias(c) for c in ("src", "words", "counts", "n"))), "crowded")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for row in zip(*arrow_columns(batch, "words", "counts", "src")):
                total += np.bincount((elements(*row) >> U64(64 - BUCKET_BITS)).astype(np.int64), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    got = bags.select("words", "counts", "src").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(size, np.int64)
    often[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    shared = feats.sparkSession.sparkContext.broadcast(often)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            fp, word, sizes = [], [], []
            for words, counts, src, own, n in zip(*arrow_columns(batch, "words", "counts", "src", "fp", "n")):
                e = elements(words, counts, src)
                keep = e[np.lexsort((e, often[(e >> U64(64 - BUCKET_BITS)).astype(np.int64)]))][: n - math.ceil(t * n - 1e-9) + 1]
                fp += [own] * len(keep)
                word += keep.view(np.int64).tolist()
                sizes += [n] * len(keep)
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(word, pa.int64()), pa.array(sizes, pa.int32())], ["fp", "word", "n"])

    rows = written(bags.mapInArrow(explode, "fp bigint, word bigint, n int"), "prefixes")
    cells = rows.groupBy("word").agg(F.count("*").alias("m")).filter("m > 1").select("word", F.ceil(F.col("m") / cell).cast("int").alias("cells"))
    rows = rows.join(cells, "word").withColumn("own", F.pmod(F.xxhash64("fp"), "cells").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    left = rows.select("word", F.col("own").alias("i"), every.alias("j"), F.col("fp").alias("a"), F.col("n").alias("na"))
    right = rows.select("word", every.alias("i"), F.col("own").alias("j"), F.col("fp").alias("b"), F.col("n").alias("nb"))
    alike = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(t - 1e-9))
    return left.join(right, ["word", "i", "j"]).filter(alike).select("a", "b").distinct()


def similar_bags(feats: DataFrame, least: float = LEAST_SIMILARITY, hot: int = HOT) -> DataFrame:
    """(a, b, sim): all pairs of different fingerprints at least so similar."""
    candidates, crowded = band_pairs(feats, hot)
    if not crowded.isEmpty():
        candidates = written(candidates.unionByName(prefix_pairs(feats, crowded, least)).distinct(), "candidates")
    return verified(candidates, feats, least)


def near_duplicate_pairs(texts: DataFrame) -> DataFrame:
    """(src, id_a, id_b), id_a < id_b: every pair of records at least 0.8 alike, exact copies included."""
    feats = written(features(texts), "features")
    found = similar_bags(feats).select("a", "b")
    members = feats.select("src", "id", "fp").distinct()
    copies = members.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    rows = expanded(found.unionByName(copies), members.select("fp", "src", F.col("id").alias("x")), members.select("fp", F.col("id").alias("y")))
    return rows.filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))).select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(links: DataFrame) -> DataFrame:
    """(fp, least): every fingerprint of links (a, b) and the least one that a chain of links leads to.

    Large and small stars in turn (Kiveris et al. 2014): each keeps what is connected, and after some rounds, about the
    logarithm of the longest chain, every fingerprint has one link, to its least.  Rounds are written, so plans do not grow.
    """
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = written(large, "large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        edges = written(small, "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("v").alias("fp"), F.col("u").alias("least"))
        state = now


def near_duplicate_classes(texts: DataFrame) -> DataFrame:
    """(src, id, class_id, n_links): one row per record with enough words; a class is all records that chains of links lead to, and its name their
    least id; n_links is the number of different bags linked directly.  Copies are of one class; a record in no pair is one of its own."""
    feats = written(features(texts), "features")
    found = written(similar_bags(feats).select("a", "b"), "found")
    links = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count("*").alias("links"))
    of = feats.select("src", "id", "fp").distinct().join(links.withColumnRenamed("a", "fp"), "fp", "left").join(components(found), "fp", "left")
    of = of.select("src", "id", F.coalesce("least", "fp").alias("root"), F.coalesce("links", F.lit(0)).alias("n_links"))
    named = of.groupBy("root").agg(F.min("id").alias("class_id"))
    return of.join(named, "root").select("src", "id", "class_id", "n_links")
