"""Near duplicates and split overlaps against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import conversation_rows, dice, n_words, text, vocabulary

from sparkcurate.llm import bags, near_duplicates, split_overlap
from sparkcurate.llm.shared import written

SCHEMA = "src string, id bigint, split string, source string, text string"


@pytest.fixture(scope="module")
def rows():
    return conversation_rows()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def pairs_of(rows, allowed):
    one = list({(r[0], r[1]): r for r in rows if n_words(r[4]) >= 20}.values())
    out = set()
    for k, x in enumerate(one):
        for y in one[:k]:
            if x[0] == y[0] and allowed(x, y) and dice(x[4], y[4]) >= 0.8:
                out.add((x[0], min(x[1], y[1]), max(x[1], y[1])))
    return out


def test_near_duplicates_are_those_of_brute_force(df, rows):
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got))
    want = pairs_of(rows, lambda x, y: True)
    assert len(want) > 20
    # bands are drawn at random: at a similarity of just .8 a pair is missed once in some hundred times
    assert set(got) <= want and len(want - set(got)) <= 1


def test_hot_bands_take_the_exact_way(df, rows):
    feats = written(near_duplicates.features(df), "t")
    of = {r.fp: (r.src, r.id) for r in feats.select("fp", "src", "id").collect()}
    texts = {(r[0], r[1]): r[4] for r in rows}
    want = {(min(x, y), max(x, y)) for x in of for y in of if x != y and of[x][0] == of[y][0] and dice(texts[of[x]], texts[of[y]]) >= 0.8}
    # every record shares some band here, as all bands of two are crowded
    pairs, crowded = near_duplicates.band_pairs(feats, hot=1)
    assert pairs.isEmpty()
    hot = {tuple(r) for r in near_duplicates.similar_bags(feats, hot=1).select("a", "b").collect()}
    plain = {tuple(r) for r in near_duplicates.similar_bags(feats).select("a", "b").collect()}
    assert hot == plain == want


@pytest.mark.parametrize("cell", [2000, 2])
def test_prefix_filter_is_exact(df, rows, cell):
    feats = written(near_duplicates.features(df), "t")
    found = bags.verified(near_duplicates.prefix_pairs(feats, feats.select("fp").distinct(), cell=cell), feats, 0.8)
    of = {r.fp: (r.src, r.id) for r in feats.select("fp", "src", "id").collect()}
    texts = {(r[0], r[1]): r[4] for r in rows}
    got = {(min(of[r.a], of[r.b]), max(of[r.a], of[r.b])) for r in found.collect()}
    keys = sorted(set(of.values()))
    want = {(x, y) for i, y in enumerate(keys) for x in keys[:i] if x[0] == y[0] and dice(texts[x], texts[y]) >= 0.8}
    assert got == want


def test_classes_give_each_record_once(df, rows):
    got = near_duplicates.near_duplicate_classes(df).collect()
    assert len(got) == len({(r[0], r[1]) for r in rows if n_words(r[4]) >= 20})


def test_overlaps_are_those_of_brute_force(df, rows):
    got = [tuple(r) for r in split_overlap.overlap_pairs(df).collect()]
    assert len(got) == len(set(got))
    want = pairs_of(rows, lambda x, y: (x[2] == "train") != (y[2] == "train"))
    assert len(want) > 5
    assert set(got) == want


def test_shards_lose_nothing(df, monkeypatch):
    whole = {tuple(r) for r in split_overlap.overlaps(df).collect()}
    for name, value in (("SHARD_WORDS", 300), ("SLICE", 1)):
        monkeypatch.setattr(split_overlap, name, value)
    feats = written(split_overlap.features(df), "t")
    assert split_overlap.indexes(feats.filter("not train"), 300)[1] > 3
    monkeypatch.setattr(split_overlap.matches, "__defaults__", (300,))
    assert {tuple(r) for r in split_overlap.overlaps(df).collect()} == whole


def test_report_counts_pairs(df):
    rows = split_overlap.overlap_report(df).collect()
    assert sum(r.pairs for r in rows) == split_overlap.overlap_pairs(df).count()


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates.near_duplicate_pairs(empty).count() == 0
    assert split_overlap.overlap_pairs(empty).count() == 0


def test_one_long_text_and_repeats(spark):
    long = "wort " * 70_000 + "ende"
    df = spark.createDataFrame([("a", 1, "train", None, long), ("a", 2, "test", None, long + " mehr"), ("a", 1, "train", None, long)], SCHEMA)
    assert [tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()] == [("a", 1, 2)]
    assert [tuple(r) for r in split_overlap.overlap_pairs(df).collect()] == [("a", 1, 2)]


def test_word_hashes_follow_words():
    texts = ["Ein_Test, ein TEST", None, "", "été Über-maß 東京 x1", "\ud800 a"]
    ids, at = bags.words_of(texts)
    assert np.diff(at).tolist() == [4, 0, 0, 5, 1]
    assert ids[0] == ids[2] and ids[1] == ids[3] and ids[0] != ids[1]
    one = [bags.word_ids(t).tolist() for t in texts]
    assert sum(one, []) == ids.tolist()


def index_of(texts):
    return split_overlap.TextIndex(split_overlap.packed_index(list(range(10, 10 + len(texts))), [np.array(t, np.uint32) for t in texts]))


def test_index_gives_its_texts_back_and_counts_as_a_scan_does():
    rng = random.Random(5)
    texts = [[rng.randint(1, 6) for _ in range(rng.randint(1, 40))] for _ in range(60)] + [[7] * 50, [7] * 50]
    index = index_of(texts)
    assert [(index.words[index.text[b : b + n] - index.m]).tolist() for b, n in zip(index.begin, index.sizes)] == texts
    grams = [[rng.randint(1, 7) for _ in range(3)] for _ in range(300)] + [[7, 7, 7], [9, 7, 7]]
    low, high = index.rows([index.numbers(np.array([g[k] for g in grams], np.uint32)) for k in range(3)])
    for g, lo, hi in zip(grams, low, high):
        want = [t for t, x in enumerate(texts) for i in range(len(x) - 2) if x[i : i + 3] == g]
        assert sorted(index.owner[lo:hi].tolist()) == want


def test_candidates_hold_enough_places_of_the_query():
    rng = random.Random(6)
    texts = [[rng.randint(1, 30) for _ in range(60)] for _ in range(40)]
    queries = [[w if rng.random() < 0.8 else rng.randint(31, 40) for w in rng.choice(texts)] for _ in range(40)]
    index = index_of(texts)
    number, owner = index.numbers(np.concatenate([np.array(q, np.uint32) for q in queries])), np.repeat(np.arange(40), 60)
    got = set(zip(*(x.tolist() for x in index.candidates(number, owner, 40))))
    for i, q in enumerate(queries):
        for j, t in enumerate(texts):
            held = {tuple(t[k : k + 3]) for k in range(58)}
            n = sum(tuple(q[k : k + 3]) in held for k in range(58))
            assert (n == 0 or n <= 0.3 * 58 or (i, j) in got) and ((i, j) not in got or n > 0)


def test_spans_are_stretches_of_common_words():
    index = index_of([[1, 2, 3, 4, 5, 6, 7, 8, 9], [20] * 30])
    spans = lambda q, t=0: index.spans(index.numbers(np.array(q, np.uint32)), t)
    assert spans([1, 2, 3, 4, 99, 5, 6, 7, 98, 8, 9]) == (2, 7)
    assert spans([5, 6, 7, 8, 9, 1, 2, 3]) == (2, 8)
    assert spans([99, 1, 2]) == (0, 0) and spans([20] * 10, 1) == (1, 10)


def test_samples_agree_as_often_as_bags_do():
    sampler = near_duplicates.Sampler(2000)
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    a, b = rng.random(60) + 0.2, rng.random(60) + 0.2
    s = sampler.draw(np.concatenate([keys, keys]), np.concatenate([a, b]), np.array([0, 60]))
    assert abs((s[:, 0] == s[:, 1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def beside_copies(copies, others, n=40):
    """Rows (train) of copies of one text and of other texts, and rows (test) of n texts with random words of it replaced."""
    rng, words = random.Random(11), vocabulary(3000)
    base = text(rng, words, 100)
    rows = [("a", i, "train", "s", base) for i in range(copies)] + [("a", copies + i, "train", "s", text(rng, words, 100)) for i in range(others)]
    near = []
    while len(near) < n:
        t = " ".join(rng.choice(words) if rng.random() < 0.12 else w for w in base.split())
        if dice(base, t) >= 0.82:
            near.append(("a", 100_000 + len(near), "test", "s", t))
    return rows + near


def test_near_copies_beside_a_third_of_copies_overlap(spark):
    rows = beside_copies(400, 800)
    got = {(r.id_a, r.id_b) for r in split_overlap.overlap_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all((0, 100_000 + k) in got for k in range(40))


def test_shingles_count_once_per_bag(spark):
    one, two = "eins zwei drei vier fünf", "sechs sieben acht neun zehn"
    df = spark.createDataFrame([("a", i, one) for i in range(9)] + [("a", 9, two)], "src string, id int, text string")
    seen, n = bags.shingle_counts(df, 2, 16, 2)
    assert n == 2 and seen.max() <= 2 and seen.sum() == 8


def evenly_edited(rng, words, n, every, insert):
    t = [rng.choice(words) for _ in range(n)]
    at = lambda w: [w, rng.choice(words)] if insert else [rng.choice(words)]
    out = [x for k, w in enumerate(t) for x in (at(w) if k % every == every - 1 else [w])]
    return " ".join(t), " ".join(out)


@pytest.mark.parametrize(("every", "insert"), [(5, False), (6, False), (3, True), (4, True), (6, True)])
def test_evenly_spread_edits_overlap(spark, every, insert):
    """All pairs at 0.8 and more whose differences are replaced words, with a word inserted after every four or more, or after every three in the
    evaluation record."""
    rng, words = random.Random(12), vocabulary(3000)
    rows, want = [], set()
    for i in range(60):
        a, b = evenly_edited(rng, words, 200, every, insert)
        turned = i % 2 and (every, insert) != (3, True)
        rows += [("a", 2 * i, ("train", "test")[turned], "s", a), ("a", 2 * i + 1, ("test", "train")[turned], "s", b)]
        if dice(a, b) >= 0.8:
            want.add(("a", 2 * i, 2 * i + 1))
    assert len(want) > 50
    assert {tuple(r) for r in split_overlap.overlap_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_sketches_rule_out_no_similar_pair():
    rng, words = random.Random(13), vocabulary()
    texts = [text(rng, words, 60) for _ in range(30)] + ["wort " * 70_000, "wort " * 90_000]
    texts += [" ".join(rng.choice(words) if rng.random() < 0.15 else w for w in t.split()) for t in texts[:30]]
    ids, at = bags.words_of(texts)
    x = split_overlap.sketches((ids >> np.uint64(32)).astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(at)), len(texts))
    for i in range(len(texts)):
        may = split_overlap.may_be_similar(np.repeat(x[i : i + 1], len(x), 0), x)
        assert all(may[j] or dice(texts[i], texts[j]) < 0.8 for j in range(len(texts)))


def test_bands_find_pairs_at_the_threshold():
    """Two words of five differ in shingles at Dice 0.8: a weighted Jaccard similarity of about 0.44."""
    rng, n, missed = np.random.default_rng(4), 400, 0
    sampler = near_duplicates.Sampler(near_duplicates.SAMPLES)
    for _ in range(n):
        keys = rng.integers(1, 1 << 60, 156).astype(np.uint64)
        a, b = keys[:100], np.concatenate([keys[:61], keys[100:139]])
        s = sampler.draw(np.concatenate([a, b]), np.ones(200), np.array([0, 100]))
        missed += not (s[:, 0] == s[:, 1])[near_duplicates.PARTS].all(axis=1).any()
    assert missed <= 0.02 * n


def test_chains_are_one_class(spark):
    rng, words = random.Random(14), vocabulary(3000)
    rows = []
    for g in range(12):
        t = rng.sample(words, 110)
        # each text of a chain shares 85 of 100 words with the next, and 70 with the one after it
        chain = [t[:100], t[15:] + rng.sample(words, 5)]
        chain.append(chain[1][15:] + rng.sample(words, 15))
        rows += [("a", 3 * g + k, "train", "s", " ".join(x)) for k, x in enumerate(chain)]
    of = {r.id: r.class_id for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(len({of[3 * g + k] for k in range(3)}) == 1 for g in range(12)) and len(set(of.values())) == 12


def test_components_are_those_of_a_search(spark):
    rng = random.Random(15)
    links = [(k, k + 1) for k in range(100, 140)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(40)]
    links = [(min(x), max(x)) for x in links if x[0] != x[1]]
    want = {v: v for x in links for v in x}
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    got = near_duplicates.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    least = {r.fp: r.least for r in got}
    assert len(got) == len(least) and {v: least.get(v, v) for v in want} == want


def test_pairs_in_order_are_those_of_every_band():
    rng = random.Random(21)
    rows = sorted({(rng.randint(1, 60), rng.randint(1, 400)) for _ in range(700)} | {(30, k) for k in range(90)} | {(61, 1), (61, 2)})
    for width in (1, 7, 64, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows[i : i + width]], pa.int64()), pa.array([f for _, f in rows[i : i + width]], pa.int64())], ["band", "fp"]) for i in range(0, len(rows), width)]
        got = [tuple(r.values()) for b in near_duplicates.pairs_in_order(20)(iter(batches)) for r in b.to_pylist()]
        of = {}
        for b, f in rows:
            of.setdefault(b, []).append(f)
        want = [(x, y) for own in of.values() if len(own) <= 20 for i, x in enumerate(own) for y in own[i + 1 :]] + [(x, None) for own in of.values() if len(own) > 20 for x in own]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_expansion_in_cells_loses_nothing(spark):
    left = spark.createDataFrame([(f, k) for f in (1, 2) for k in range(9 * f)], "fp bigint, x bigint")
    right = spark.createDataFrame([(f, 100 + k) for f in (1, 3) for k in range(7)], "fp bigint, y bigint")
    pairs = spark.createDataFrame([(1, 1, "s"), (2, 3, "t"), (2, 9, "u")], "a bigint, b bigint, kind string")
    rows = [sorted(map(str, bags.expanded(pairs, left, right, cell).select("a", "b", "kind", "x", "y").collect())) for cell in (1000, 2)]
    assert rows[0] == rows[1] and len(rows[0]) == 9 * 7 + 18 * 7
