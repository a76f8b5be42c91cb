"""Benchmark decontamination by winnowed fingerprints (operator 10).

Of every run of ``WINDOW - GRAM + 1`` consecutive word 5-grams the one with the least hash is kept, in the benchmark and
in the documents: its fingerprints.  Any ten words that both share therefore share a fingerprint.  The documents'
fingerprints are joined to the benchmark's, and each hit is extended: the words before and after it are compared, up to
``WINDOW - GRAM`` on each side, which are all that a window with this fingerprint can hold.  A benchmark item of fewer than
ten words is one window; it is its own fingerprint, joined to the documents' runs of as many words.

Nothing of the benchmark is held in one place but two bitmaps of a fixed size, one of its fingerprints and one of
its windows.  A document's fingerprint takes part in the join if both may hold it, so that few rows but real hits are
shuffled; no text is.  The benchmark's rows are repeated ``SALTS`` times, and the documents' dealt out among them, so
that a passage which very many documents share is not joined by one task.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no window; an item whose id
is null marks words but is not listed; items that share an id are one item; repeated document rows give repeated results;
with an empty benchmark nothing is hit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import bitmap, in_bitmap, map_texts, split_likely
from .session import cut, workers_import
from .words import Words, inside_text, ngram_hashes, word_slices

WINDOW = 10
GRAM = 5
SALTS = 16


def winnow(grams: np.ndarray, ok: np.ndarray, span: int) -> np.ndarray:
    """Positions whose hash is the least of some ``span`` consecutive valid n-grams.

    ``ok`` marks the n-grams that lie inside one text; a window that holds
    another is no window.
    """
    m = len(grams) - span + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    least, good = grams[:m].copy(), ok[:m].copy()
    for j in range(1, span):
        np.minimum(least, grams[j : j + m], out=least)
        good &= ok[j : j + m]
    chosen = np.zeros(len(grams), dtype=bool)
    for j in range(span):
        chosen[j : j + m] |= good & (grams[j : j + m] == least)
    return np.flatnonzero(chosen)


def fingerprints(words: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept 5-grams."""
    grams = ngram_hashes(words.hash, GRAM)
    at = winnow(grams, inside_text(of, GRAM), WINDOW - GRAM + 1)
    return at, grams[at].view(np.int64)


def runs(words: Words, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all runs of n words inside a text."""
    at = np.flatnonzero(inside_text(of, n))
    return at, (ngram_hashes(words.hash, n)[at] ^ np.uint64(n)).view(np.int64)


#: A fingerprint: its hash, its words (all of a short item's), and those before (nearest first) and after it.
PRINT = [T.StructField("print", T.LongType()), T.StructField("mid", T.StringType()), T.StructField("before", T.ArrayType(T.StringType())), T.StructField("after", T.ArrayType(T.StringType()))]
_PRINT = pa.struct([("print", pa.int64()), ("mid", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string())), ("at", pa.int64())])


def _print(words: Words, of: np.ndarray, p: int, n: int, value: int) -> dict:
    text = of[p]
    first, end = int(words.first[text]), int(words.first[text + 1])
    spell = lambda places: [words.word(i).decode() for i in places]
    near = WINDOW - GRAM if n == GRAM else 0
    return {"print": int(value), "mid": " ".join(spell(range(p, p + n))), "before": spell(range(p - 1, max(p - 1 - near, first - 1), -1)), "after": spell(range(p + n, min(p + n + near, end))), "at": p - first}


def benchmark_prints(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, n, print, mid, before, after, windows) of every item: n is 5, or the number of words of a short item; windows are the hashes of those that hold the print."""

    def factory():
        def mapper(column: pa.Array) -> list[pa.Array]:
            out: list[list[dict]] = []
            for _, _, words in word_slices(column):
                of = words.text_of_word()
                whole = ngram_hashes(words.hash, WINDOW).view(np.int64)
                by_text: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
                at, values = fingerprints(words, of)
                for p, v in zip(at.tolist(), values.tolist(), strict=True):
                    first, end = int(words.first[of[p]]), int(words.first[of[p] + 1])
                    starts = range(max(first, p - WINDOW + GRAM), min(p, end - WINDOW) + 1)
                    by_text[of[p]].append(_print(words, of, p, GRAM, v) | {"n": 0, "windows": [int(whole[s]) for s in starts]})
                for i, n in enumerate(np.diff(words.first).tolist()):
                    if 0 < n < WINDOW:
                        p = int(words.first[i])
                        value = int((ngram_hashes(words.hash[p : p + n], n)[:1] ^ np.uint64(n)).view(np.int64)[0])
                        by_text[i].append(_print(words, of, p, n, value) | {"before": [], "after": [], "n": n, "windows": []})
                out += by_text
            return [pa.array(out, pa.list_(pa.struct([*_PRINT, pa.field("n", pa.int64()), pa.field("windows", pa.list_(pa.int64()))])))]

        return mapper

    kind = T.ArrayType(T.StructType([*PRINT, T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("windows", T.ArrayType(T.LongType()))]))
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    found = map_texts(items, factory, [T.StructField("prints", kind)], "text", ["item"])
    return found.select("item", F.explode("prints").alias("p")).select("item", "p.n", "p.print", "p.mid", "p.before", "p.after", "p.windows")


def _likely_prints(source: DataFrame, prints_map, windows_map, lengths: list[int]) -> DataFrame:
    """(k.., h, n_words, prints) of the documents (k.., h, text): the fingerprints that the bitmaps may hold."""

    def factory():
        def mapper(column: pa.Array) -> list[pa.Array]:
            counts: list[np.ndarray] = []
            out: list[list[dict]] = []
            for _, _, words in word_slices(column):
                of = words.text_of_word()
                by_text: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
                at, values = fingerprints(words, of)
                there = in_bitmap(prints_map.value, values)
                at, values = at[there], values[there]
                if len(at):
                    whole = ngram_hashes(words.hash, WINDOW).view(np.int64)
                    starts = at[:, None] - np.arange(WINDOW - GRAM + 1)
                    inside = (starts >= 0) & (starts + WINDOW <= len(of))
                    inside &= of[np.maximum(starts, 0)] == of[np.minimum(starts + WINDOW, len(of)) - 1]
                    held = inside & in_bitmap(windows_map.value, whole[np.clip(starts, 0, max(len(whole) - 1, 0))]) if len(whole) else np.zeros_like(inside)
                    for p, v in zip(at[held.any(axis=1)].tolist(), values[held.any(axis=1)].tolist(), strict=True):
                        by_text[of[p]].append(_print(words, of, p, GRAM, v) | {"n": 0})
                for n in lengths:
                    at, values = runs(words, of, n)
                    there = in_bitmap(prints_map.value, values)
                    for p, v in zip(at[there].tolist(), values[there].tolist(), strict=True):
                        by_text[of[p]].append(_print(words, of, p, n, v) | {"before": [], "after": [], "n": n})
                out += by_text
                counts.append(np.diff(words.first))
            return [pa.array(np.concatenate(counts), pa.int64()), pa.array(out, pa.list_(pa.struct([*_PRINT, pa.field("n", pa.int64())])))]

        return mapper

    kind = T.ArrayType(T.StructType([*PRINT, T.StructField("at", T.LongType()), T.StructField("n", T.LongType())]))
    return map_texts(source, factory, [T.StructField("n_words", T.LongType()), T.StructField("prints", kind)], "text", [c for c in source.columns if c != "text"])


def _alike(a: str, b: str):
    """How many of the first words of two arrays agree, one after the other."""
    out = F.lit(0)
    for i in range(WINDOW - GRAM - 1, -1, -1):
        out = F.when(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), out + 1).otherwise(0)
    return out


def _hits(docs: DataFrame, benchmark: DataFrame, text: str, keep: Sequence[str], item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """((k.., h, n_words) of each row, (k.., h, start, end, item) of each hit); h hashes the text."""
    workers_import(docs.sparkSession)
    theirs = cut(benchmark_prints(benchmark, item_id, item_text))
    lengths = sorted(r.n for r in theirs.where("n > 0").select("n").distinct().collect())  # below WINDOW
    spark = docs.sparkSession.sparkContext
    prints_map = spark.broadcast(bitmap(theirs.select("print"), "print"))
    windows_map = spark.broadcast(bitmap(theirs.select(F.explode("windows").alias("w")), "w"))
    keys = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, keys, strict=True)), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("h"), F.col(f"`{text}`").cast("string").alias("text"))
    found = cut(_likely_prints(source, prints_map, windows_map, lengths))
    ours = found.select(*keys, "h", F.explode("prints").alias("p")).distinct().select(*keys, "h", "p.*", F.pmod(F.xxhash64(*keys, "h", "p.at"), F.lit(SALTS)).alias("salt"))
    salted = theirs.select("item", "n", "print", "mid", F.col("before").alias("before_"), F.col("after").alias("after_"), F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))).alias("salt"))
    joined = ours.join(salted, ["salt", "print", "n", "mid"]).withColumn("l", _alike("before", "before_")).withColumn("r", _alike("after", "after_"))
    size = F.when(F.col("n") > 0, F.col("n")).otherwise(GRAM)
    hits = joined.where(f"n > 0 or l + r + {GRAM} >= {WINDOW}").select(*keys, "h", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + size + F.col("r")).alias("end"), "item")
    return found.select(*keys, "h", "n_words"), hits


SPANS = "array<struct<start:bigint,end:bigint>>"


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",), item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_words``, ``spans`` (hit word ranges, end exclusive, merged) and ``items`` (sorted ids)."""
    rows, hits = _hits(docs, benchmark, text, keep, item_id, item_text)
    keys = [c for c in rows.columns if c != "n_words"]
    by_row = hits.groupBy(*keys).agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    merged = by_row.select(*(F.col(c).alias(f"_{c}") for c in keys), *_merged("spans"), "items")
    same = [rows[c].eqNullSafe(F.col(f"_{c}")) for c in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    none = F.expr(f"cast(array() as {SPANS})")
    return rows.join(merged, condition, "left").select(*(F.col(k).alias(c) for k, c in zip(keys, keep, strict=False)), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def _merged(column: str) -> list:
    """Overlapping and touching ranges of an array of (start, end) made one: a range begins where no earlier one reaches."""

    @F.pandas_udf(SPANS)
    def merge(spans):
        out = []
        for one in spans:
            a = np.array(sorted((int(x["start"]), int(x["end"])) for x in one), dtype=np.int64).reshape(-1, 2)
            reach = np.maximum.accumulate(a[:, 1])
            first = np.flatnonzero(np.append(True, a[1:, 0] > reach[:-1]))
            last = np.append(first[1:] - 1, len(a) - 1)
            out.append([{"start": int(s), "end": int(e)} for s, e in zip(a[first, 0], reach[last], strict=True)])
        import pandas as pd

        return pd.Series(out, dtype=object)

    return [merge(column).alias(column)]


def report(found: DataFrame) -> DataFrame:
    """The digest columns of :func:`scan`'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that share no window with the benchmark, with their columns as they were; only texts that may be hit are shuffled."""
    _, hits = _hits(docs, benchmark, text, [doc_id], item_id, item_text)
    gone = cut(hits.select(F.col("k0").alias("__gone_id"), F.col("h").alias("__gone_h")).distinct())
    key = F.xxhash64(F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`").cast("string")))
    maybe, others = split_likely(docs, key, gone.select(F.xxhash64("__gone_id", "__gone_h").alias("key")), "key")
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__gone_id")) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col("__gone_h"))
    return others.unionByName(maybe.join(gone, same, "left_anti"))
