from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D
from tidemark.llm.arrowmap import bitmap

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    windows = {}
    for name, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).update([name] if name is not None else [])
    out = []
    for text in texts:
        w, hit, names = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    names |= windows[tuple(w[p : p + n])]
        out.append((len(w), len(hit), sorted(names)))
    return out


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(30)] + ["É", "straße", "ok"]
    items = [(str(i), " ".join(r.choices(vocabulary, k=r.choice([0, 1, 4, 9, 10, 11, 25, 40])))) for i in range(60)]
    texts = []
    for _ in range(300):
        parts = r.choices(vocabulary, k=r.randint(0, 40))
        if r.random() < 0.6:
            item = r.choice(items)[1].split()
            a = r.randint(0, max(0, len(item) - 1))
            parts[r.randint(0, len(parts)) : 0] = item[a : a + r.randint(1, 30)]
        texts.append(r.choice([" ", ", ", "\n"]).join(p.upper() if r.random() < 0.1 and p.isascii() else p for p in parts))
    return texts, items


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    return docs, bench, {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in D.scan(docs, bench).collect()}


@pytest.mark.parametrize("seed, least", [(3, 0), (5, 10)])
def test_against_brute_force(spark, monkeypatch, seed, least):
    """Items of all lengths, or of ten words and more only; slices of a few texts and of many."""
    texts, items = corpus(seed)
    items = [(n, t) for n, t in items if len(t.split()) >= least]
    _, _, got = found(spark, texts, items)
    assert got == dict(enumerate(brute(texts, items)))


def test_report_and_clean(spark):
    texts, items = corpus(7)
    items = [*items, (None, "a null name has ten words that it marks in texts"), ("1", None)]
    texts = [*texts, "so a null name has ten words that it marks in texts here"]
    docs, bench, got = found(spark, texts, items)
    expected = brute(texts, items[:-1])
    assert got == dict(enumerate(expected)) and expected[-1] == (13, 11, [])
    rows = {r.doc_id: r for r in D.report(D.scan(docs, bench)).collect()}
    for i, (n, hit, names) in enumerate(expected):
        assert (rows[i].n_words, rows[i].n_hit, rows[i].n_items, rows[i].contaminated) == (n, hit, len(names), hit > 0)
        assert rows[i].items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    assert {r.doc_id for r in D.clean(docs, bench).collect()} == {i for i, e in enumerate(expected) if not e[1]}


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    """The bitmaps only spare work: with all bits set the results are the same."""
    monkeypatch.setattr(D, "bitmap", lambda wanted, name: np.full(1 << 10, ~np.uint64(0)))
    texts, items = corpus(9)
    _, _, got = found(spark, texts, items)
    assert got == dict(enumerate(brute(texts, items)))


def test_many_documents_share_a_passage(spark):
    """One passage in every document, in several items: each is hit, and the rows are dealt out among the salts."""
    passage = " ".join(f"p{i}" for i in range(30))
    items = [(f"i{k}", f"x{k} {passage} y{k}") for k in range(3)]
    texts = [f"d{i} {passage} e{i}" for i in range(400)] + ["nothing here"]
    _, _, got = found(spark, texts, items)
    assert all(got[i] == (32, 30, ["i0", "i1", "i2"]) for i in range(400)) and got[400] == (2, 0, [])


def test_no_text_of_the_benchmark_reaches_the_driver(spark, monkeypatch):
    """Nothing but bitmaps of a fixed size and the lengths of short items."""
    seen = []
    monkeypatch.setattr(D, "bitmap", lambda wanted, name: (seen.append(wanted.columns), bitmap(wanted, name))[1])
    bench = spark.range(3000).select(F.col("id").cast("string").alias("item_id"), F.concat_ws(" ", *(F.concat(F.lit("t"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100000)).cast("string")) for k in range(40))).alias("text"))
    docs = bench.select(F.col("item_id").cast("long").alias("doc_id"), F.concat(F.lit("start "), "text").alias("text"))
    assert D.report(D.scan(docs, bench)).where("n_hit = 40 and n_items = 1").count() == 3000
    assert seen == [["print"], ["w"]]


def test_awkward(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "one"), (2, "a b c d e f g h i j"), (3, None), (4, "")], "item_id long, text string")
    rows = {r.doc_id: r for r in D.report(D.scan(awkward, bench)).collect()}
    assert rows[3].contaminated and rows[4].n_hit == 1 and rows[8].n_hit == 10 and not rows[0].contaminated and rows[0].n_words == 0 and len(rows) == 10
    assert D.clean(awkward, bench).columns == awkward.columns and D.clean(awkward, bench).count() == 7
    assert D.report(D.scan(awkward, bench.limit(0))).where("contaminated").count() == 0
    assert D.report(D.scan(empty, bench)).count() == 0
