from __future__ import annotations

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import kneser_ney as K
from tidemark.llm import toxicity as X
from tidemark.llm.words import buffers


def brute_model(texts):
    """Probability of the last byte of an n-gram, by the definition of interpolated modified Kneser-Ney, on dictionaries."""
    table = {}
    level = collections.Counter()
    for t in texts:
        s = bytes(K.ORDER - 1) + t.encode()
        level.update(s[i - K.ORDER + 1 : i + 1] for i in range(K.ORDER - 1, len(s)))
    for n in range(K.ORDER, 0, -1):
        of = collections.Counter(level.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        d = {k: max(0.0, min(k, k - (k + 1) * y * of[k + 1] / of[k])) if of[k] and of[1] else k / 2 for k in (1, 2, 3)}
        total, weight = collections.Counter(), collections.Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            weight[g[:-1]] += d[min(c, 3)]
        table[n] = level, d, total, weight
        level = collections.Counter(g[1:] for g in level)

    def p(g):
        if not g:
            return 1 / 256
        level, d, total, weight = table[len(g)]
        lower = p(g[1:])
        if not total[g[:-1]]:
            return lower
        c = level[g]
        return (c - d[min(c, 3)] if c else 0) / total[g[:-1]] + weight[g[:-1]] / total[g[:-1]] * lower

    return p


def fold(text):
    return xxhash.xxh64_intdigest(text.encode(), seed=42) % K.FOLDS


def brute_perplexities(texts, trusted):
    """Each text's perplexity by the model of the other folds' trusted texts."""
    models = [brute_model([t for t in trusted if fold(t) != k]) for k in range(K.FOLDS)]
    return [K.perplexity_by_definition((t or "").encode(), models[fold(t or "")]) for t in texts]


def brute_limits(perplexities, langs, is_trusted):
    """By language, the quantile of the trusted documents."""
    values = collections.defaultdict(list)
    for x, lang, good in zip(perplexities, langs, is_trusted, strict=True):
        if good and x is not None:
            values[lang].append(x)
    return {lang: sorted(v)[math.ceil(K.QUANTILE * len(v)) - 1] for lang, v in values.items()}


def sentences(n, seed):
    r = random.Random(seed)
    words = "the of and to in that it is was for on are as with they at be this have from".split()
    return [(" ".join(r.choices(words, k=r.randint(3, 60))) + ".").capitalize() for _ in range(n)]


def junk(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("#$%&*!QXZ0189| ", k=r.randint(20, 200))) for _ in range(n)]


def test_codes_are_the_texts_ngrams(monkeypatch):
    """However the bytes are cut, and across null, empty, short and long texts."""
    texts = ["abcdefgh" * 5, None, "", "a", "é", "xyz", "", "日本語 text", "q" * 50, "ab"]
    expected = [int.from_bytes((bytes(K.ORDER - 1) + t.encode())[i : i + K.ORDER], "big") for t in texts if t for i in range(len(t.encode()))]
    for chunk in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(K, "_CHUNK", chunk)
        raw, off = buffers(pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts)))
        runs = list(K.codes(raw, off))
        assert [int(x) for _, code in runs for x in code] == expected and [a for a, _ in runs] == list(range(0, len(expected), chunk))


def test_model_by_definition(spark):
    texts = [*sentences(40, 1), "Überß, é 日本 12!", "a", "a"]
    probe = [*sentences(5, 2), *junk(5, 3), "é", "", None, "日本語 text", texts[0], "\0\0a", "x" * 3000]
    labelled = spark.createDataFrame([(fold(t), K._packed(pa.py_buffer(t.encode()))) for t in texts], "fold int, text binary")
    model = K.train(K.other_folds(labelled))
    asked = [(k, int.from_bytes(b"the " + bytes([c]), "big")) for k in range(K.FOLDS) for c in range(256)]
    of = [brute_model([t for t in texts if fold(t) != k]) for k in range(K.FOLDS)]
    got = {(r.fold, r.g): r.p for r in K.probabilities(spark.createDataFrame(asked, "fold int, g bigint"), model).collect()}
    assert all(got[k, g] == pytest.approx(of[k](g.to_bytes(5, "big"))) for k, g in asked)
    assert all(sum(p for (k, _), p in got.items() if k == fold_number) == pytest.approx(1) for fold_number in range(K.FOLDS))
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(probe)], "doc_id long, text string, lang string")
    expected = brute_perplexities(probe, texts)
    for block_bytes in (1 << 24, 300):
        scored = {r.doc_id: r for r in K.score(docs, model, block_bytes=block_bytes).collect()}
        for i, x in enumerate(expected):
            assert scored[i].n_bytes == len((probe[i] or "").encode())
            assert scored[i].log_perplexity == (pytest.approx(math.log(x), rel=1e-5) if x else None)


def test_verdicts_by_definition(spark):
    """Perplexities, limits by language (few texts or many, null and empty apart) and verdicts."""
    r = random.Random(8)
    good, bad = sentences(80, 11), junk(30, 12)
    rows = [(i, t, r.choice(["en", "en", "en", "de", None, ""])) for i, t in enumerate(good + bad)]
    rows += [(500, good[0], "fr"), (501, bad[0], "fr"), (502, None, "en"), (503, "", "en"), (504, bad[1], "xx"), (504, bad[1], "xx")]
    labels = [(i, 1, 0) for i in range(0, 80, 2)] + [(i, 0, 0) for i in range(80, 110, 3)] + [(500, 1, 0), (502, 1, 0), (4, 0, 0)]
    trusted = {i for i, q, _ in labels if q} - {4}
    perplexity = brute_perplexities([t for _, t, _ in rows], [t for i, t, _ in rows if i in trusted and t])
    limits = brute_limits(perplexity, [x[2] for x in rows], [x[0] in trusted for x in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = K.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    found = {(g.doc_id): g for g in got}
    for (i, _, lang), x in zip(rows, perplexity, strict=True):
        g = found[i]
        assert g.perplexity == (pytest.approx(x, rel=1e-5) if x else None) and g.threshold == (pytest.approx(limits[lang], rel=1e-5) if lang in limits else None)
        assert g.accepted == (x is None or lang not in limits or x <= limits[lang] * (1 + 1e-6))
    kept = sorted(r.doc_id for r in K.keep_accepted(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())
    assert kept == sorted(g.doc_id for g in got if g.accepted) and 504 in kept


def test_held_out_accuracy(spark):
    good, bad = sentences(300, 5), junk(100, 6)
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "xx") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 if i < 300 else 0, 0) for i in range(0, 400, 2)] + [(i, 1 if i < 300 else 0, 0) for i in range(1, 200, 2)] + [(301, None, 0), (0, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.accepted for r in K.classify(docs, labels).collect()}
    held = [i for i in range(201, 400, 2)]
    assert sum(got[i] == (i < 300) for i in held) >= 0.97 * len(held)
    kept = K.keep_accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, ok in got.items() if ok}


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (8, 1, 1), (3, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = K.classify(awkward, labels).collect()
    assert len(out) == 10 and all(r.accepted and r.perplexity is None for r in out if r.doc_id in (0, 1))
    assert K.classify(awkward, labels.limit(0)).where("accepted").count() == 10
    assert K.classify(empty, labels).count() == 0 and K.keep_accepted(empty, labels).count() == 0
    assert K.keep_accepted(awkward, labels.limit(0)).count() == 10


def toxic_corpus(n, seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(2000)]
    rows = []
    for i in range(n):
        text = r.choices(words, k=r.randint(20, 200))
        toxic, low = r.random() < 0.2, r.random() < 0.2
        if toxic:
            for _ in range(2):
                text.insert(r.randrange(len(text)), r.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(text).upper() if low else " ".join(text), 0 if low else 1, int(toxic)))
    return rows


def test_chain_held_out(spark):
    rows = toxic_corpus(900, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] % 3], "doc_id long, quality int, toxic int")
    chain = X.train(docs, labels)
    assert [m.names for m in chain] == [["low_quality"], ["toxic"]] and len(chain[1].chained) == 1
    got = {r.doc_id: r for r in X.predict(docs, chain).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert sum(got[r[0]].toxic == bool(r[3]) for r in held) >= 0.95 * len(held)
    assert sum(got[r[0]].low_quality == (r[2] == 0) for r in held) >= 0.97 * len(held)


def test_earlier_probabilities_are_out_of_fold():
    """A document's own label has no part in the probability that later models learn from."""
    r = np.random.default_rng(1)
    n = 120
    owner, hashes = np.repeat(np.arange(n), 30), r.integers(0, 100, n * 30).astype(np.uint64)
    y, none = (r.random(n) < 0.5).astype(float), np.zeros((n, 0))
    before = X.out_of_fold(owner, hashes, y, none)
    for i in (0, 7, 50):
        flipped = y.copy()
        flipped[i] = 1 - y[i]
        after = X.out_of_fold(owner, hashes, flipped, none)
        assert after[i] == before[i] and (after != before).any()


def test_features_ignore_slices():
    texts = ["a b c", None, "", "A! b? a", "x" * 100]
    whole = [np.sort(h) for o, h, n in X.features(pa.array(texts))]
    assert len(np.concatenate(whole)) == 3 + 0 + 0 + 2 + 1 + 3 * len(texts)


def test_toxicity_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = X.predict(awkward, X.train(awkward, none)).collect()
    assert len(out) == 10 and not any(r.toxic for r in out)
    one = spark.createDataFrame([(7, 1, 1), (8, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert not any(r.toxic for r in X.predict(awkward, X.train(awkward, one)).collect())
    assert X.predict(empty, X.train(empty, none)).count() == 0
