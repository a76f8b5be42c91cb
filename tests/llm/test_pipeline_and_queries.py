"""The pipeline against a brute-force version of its stages, and every registered query over awkward tables."""

from __future__ import annotations

import hashlib
import math
import random

import public_tokenizers
import pytest
import tiktoken
from test_classifiers import brute_limits, brute_perplexities, junk, sentences
from test_decontaminate import brute as brute_leaks
from test_ngram_join import brute as brute_links
from test_pseudonyms import feistel_pair

import corpus_pipeline
from tidemark.llm import bpe, pseudonyms, queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with junk, near and exact copies, benchmark passages and addresses, and the tables beside them."""
    r = random.Random(12)
    words = ["w%s" % "".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(1500)]
    text = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, text(30)) for i in range(6)]
    texts = [text(r.randint(30, 120)) for _ in range(60)]
    for k in range(0, 20, 2):
        copy = texts[k].split()
        if k % 4:
            copy[r.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += [f"{text(25)} {' '.join(items[k][1].split()[5:20])} {text(10)}" for k in range(4)]
    texts += [f"{text(40)} from 10.{k}.2.{k + 7} {text(9)}" for k in range(5)]
    texts += junk(25, 3)
    docs = [(100 + 3 * i, t, "en" if i % 4 else "de", "s", len(t)) for i, t in enumerate(texts)]
    labels = [(d[0], 0 if set(d[1]) & set("#$%&*!|") else 1, 0) for d in docs if d[0] % 2]
    folder = str(tmp_path_factory.mktemp("sf"))
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    save(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save(labels, "doc_id long, quality int, toxic int", "labels")
    save(items, "item_id long, text string", "benchmark")
    return folder, docs, labels, items


def brute_pipeline(docs, labels, items):
    good = {i for i, q, _ in labels if q == 1}
    perplexity = brute_perplexities([d[1] for d in docs], [d[1] for d in docs if d[0] in good])
    limits = brute_limits(perplexity, [d[2] for d in docs], [d[0] in good for d in docs])
    docs = [d for d, x in zip(docs, perplexity, strict=True) if x <= limits.get(d[2], math.inf) * (1 + 1e-6)]
    links = brute_links([d[1] for d in docs])
    docs = [d for i, d in enumerate(docs) if links[i][0] == i]
    leaks = brute_leaks([d[1] for d in docs], [(str(i), t) for i, t in items])
    docs = [d for d, leak in zip(docs, leaks, strict=True) if not leak[1]]
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = {}
    for i, t, *_ in docs:
        parts = t.split(" ")
        for k, p in enumerate(parts):
            if p.startswith("10.") and p.count(".") == 3:
                a, b, c, d = map(int, p.split("."))
                x, y = feistel_pair_with(pseudonyms.KEY, a * 256 + b, c * 256 + d)
                parts[k] = f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
        t = " ".join(parts)
        out[i] = (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest())
    return out


def feistel_pair_with(key, left, right):
    import test_pseudonyms

    before, test_pseudonyms.KEY = test_pseudonyms.KEY, key
    try:
        return feistel_pair("ip", left, right, 65536, 65536)
    finally:
        test_pseudonyms.KEY = before


def test_pipeline_is_its_stages(spark, tables):
    folder, docs, labels, items = tables
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    expected = brute_pipeline(docs, labels, items)
    assert 30 < len(expected) < len(docs) - 25
    assert got == expected


def test_stages_keep_the_columns(spark, tables):
    folder, docs, _, _ = tables
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"] and df.schema["n_chars"].dataType.typeName() == "long"


@pytest.fixture(scope="module", params=["awkward", "empty"])
def odd(request, spark, tmp_path_factory):
    """Tables with nulls, extra columns and repeated rows; or empty ones."""
    folder = str(tmp_path_factory.mktemp("odd"))
    texts = [None, "", "one", "one", "x" * 3000, "word " * 3000, sentences(1, 1)[0], "Released under the MIT License. 10.1.2.3", "a b c d e f g h i j k"]
    docs = [(i, t, None, None, None, i) for i, t in enumerate(texts)] + [(None, "null id", "en", "s", 7, 1), (8, "a b c d e f g h i j k", "en", "s", 1, 1)]
    cut = 0 if request.param == "empty" else None
    save = lambda rows, schema, name: spark.createDataFrame(rows[:cut], schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    save(docs, "doc_id long, text string, lang string, source string, n_chars long, id int", "documents")
    save([(2, 1, 0), (2, 0, 1), (6, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int", "labels")
    save([(1, "a b c d e f g h i j"), (None, "one"), (3, None)], "item_id long, text string", "benchmark")
    save([(1, 0, "user", "a"), (1, 1, "assistant", None), (None, None, None, None)], "conv_id long, turn long, role string, text string", "conversations")
    return folder, len(docs[:cut])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_over_odd_tables(spark, odd, name):
    folder, n = odd
    rows = queries.QUERIES[name](spark, folder).collect()
    expected = {"op1_license_scan": min(n, 1), "op6_chat_formatting": 1 + 2 * (n > 0)}
    if name != "op2_token_packing":
        assert len(rows) == expected.get(name, n)


def test_pipeline_over_odd_tables(spark, odd):
    folder, n = odd
    assert corpus_pipeline.run(spark, folder).count() <= n
