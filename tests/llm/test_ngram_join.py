from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ngram_join as N
from tidemark.llm.components import components


def test_plan_has_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.95), (0.9, 0.999)):
        bands, rows = N.plan_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= N.MAX_HASHES
    with pytest.raises(ValueError):
        N.plan_bands(0.01, 0.9999)


def corpus():
    r = random.Random(11)
    vocabulary = ["w%d" % i for i in range(3000)]
    texts = []
    for group in range(40):
        base = r.choices(vocabulary, k=r.choice([3, 12, 60, 150]))
        for _ in range(r.choice([1, 1, 2, 5, 30])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
    return texts


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets, n = [shingles(t) for t in texts], len(texts)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union and len(sets[i] & sets[j]) >= 0.8 * union:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(find(i), links[i]) for i in range(n)]


@pytest.mark.parametrize("block, small", [(256, 64), (7, 64), (256, 3), (7, 1)])
def test_against_brute_force(spark, block, small):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in N.join(docs, block=block, small=small).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_chance_meetings_make_no_groups(spark):
    """Texts of similarity near 0.5 share bands, but the candidate groups are those of the links."""
    r = random.Random(4)
    base = ["w%d" % i for i in range(200)]
    texts = []
    for i in range(120):
        words = list(base)
        for k in r.sample(range(200), 14):
            words[k] = f"x{i}_{k}"
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    near = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert max(near) < 0.8 and sum(near) / len(near) > 0.3
    bands, rows = N.plan_bands(0.8)
    signed = N.signatures(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, h long, text string"), bands, rows, 5)
    reps = signed.select(F.col("id").alias("rep"), "bands", "values")
    assert N.ties(reps, 0).count() > 60  # without a look at the values
    assert N.ties(reps, N.least_equal(bands * rows, 0.8)).count() < 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.class_id == r.doc_id, r.n_links) for r in N.join(docs).collect()} == {(True, 0)}


def test_least_equal():
    for hashes, threshold in ((120, 0.8), (100, 0.5)):
        k = N.least_equal(hashes, threshold)
        tail = sum(math.comb(hashes, i) * threshold**i * (1 - threshold) ** (hashes - i) for i in range(k))
        assert tail <= N.MISSED < tail + math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)


def test_one_of_each(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in N.one_of_each(docs).collect()} == {c for c, _ in brute(texts)}


def test_awkward(spark, awkward, empty):
    rows = {r.doc_id: r for r in N.join(awkward).collect()}
    assert len(rows) == 10 and rows[0].n_links == 0 and rows[0].class_id == 0 and rows[1].class_id == 1 and rows[None].class_id is None
    assert (rows[3].class_id, rows[4].class_id, rows[4].n_links, rows[4].copy_id) == (3, 3, 1, 3)
    assert N.join(empty).count() == 0 and N.one_of_each(empty).count() == 0
    kept = N.one_of_each(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 5, 6, 7, 8] and kept.count() == 9


def test_rows_are_documents(spark):
    """Repeated rows, one id with several texts, rows without ids, ids that are texts, clashing columns."""
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    data = [("b", long), ("b", long), ("a", other), ("b", other), (None, long + " more"), (None, "only here"), (None, "only here"), ("c", "!!"), ("d", "!!"), ("e", ""), ("f", None), ("f", None)]
    docs = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in data], "doc_id string, text string, key int, label string, __gone string")
    got = sorted(((r.doc_id, r.class_id, r.copy_id, r.n_links, r.n_grams) for r in N.join(docs).collect()), key=repr)
    expected = [("b", "b", "b", 2, 56)] * 2 + [("a", "a", "a", 1, 56), ("b", "a", "a", 1, 56), (None, "b", None, 2, 57), (None, None, None, 1, 1), (None, None, None, 1, 1), ("c", "c", "c", 1, 0), ("d", "c", "c", 1, 0), ("e", "e", "e", 0, 0), ("f", "f", "f", 0, 0), ("f", "f", "f", 0, 0)]
    assert got == sorted(expected, key=repr)
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([("b", long), ("a", other), (None, "only here"), ("c", "!!"), ("e", ""), ("f", None), ("f", None)], key=repr)


def test_one_large_group(spark):
    """Thousands of near copies of one text, many more than a block, are one class; each is linked to all others."""
    base = " ".join(f"w{i}" for i in range(80))
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " end"), F.col("id").cast("string")).alias("text"))
    assert {(r.class_id, r.n_links) for r in N.join(docs).collect()} == {(0, 1499)}
    assert [r.doc_id for r in N.one_of_each(docs).collect()] == [0]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(500, 501), (501, 502), (502, 503), (503, 504), (700, 700), (None, 3)]
    root = {x: x for e in edges for x in e if x is not None and None not in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
