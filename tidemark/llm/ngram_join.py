"""N-gram Jaccard self-join of documents by MinHash banding (operator 4).

1. One pass hashes each text's set of word 5-grams and takes ``bands * rows``
   MinHash values; band and row counts come from the target recall.  Texts with
   equal sets (copies) become one representative with a count.
2. Representatives are shuffled on their band hashes.  In a bucket of at most
   ``SMALL`` members those are tied whose MinHash values agree as often as values of
   texts at the threshold do (all but one in 10^6), so that texts that met by chance
   connect no groups; in a larger bucket every member is tied to the least one.  A
   bucket of n members makes less than n ties, never n^2.  Connected components of the
   ties are the candidate groups.
3. The members' full sets are compared inside each candidate group, by blocks of
   bounded size; pairs are counted where they are found and are not emitted.  Only the
   texts of candidates are shuffled, once for a group of one block.

The result has one row per row of the table: ``class_id`` (the least document id that
links connect it to), ``copy_id`` (the least id with an equal set), ``n_links``
(other rows at or over the threshold) and ``n_grams``.

Defined results: a text of one to four words is a single n-gram; texts without words
(empty, symbols only) are copies of those that are the same; a null text is no
copy of any; ids may be null, repeated and of any type that has an order, each row is
a document of its own, and a class of rows without ids has a null ``class_id``; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import free_name, likely, map_texts
from .components import components
from .session import cut, workers_import
from .words import Words, inside_text, ngram_hashes, word_slices

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
BLOCK = 256
SMALL, MISSED = 64, 1e-6


def plan_bands(threshold: float, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` values that finds a
    pair of the threshold similarity with probability ``recall`` or more."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-p)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding of that many hash values has the recall asked for")
    return best


def gram_sets(words: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the n-grams of text i are ``hashes[first[i]:first[i + 1]]``, repeats included."""
    of = words.text_of_word()
    grams = ngram_hashes(words.hash, n)
    ok = inside_text(of, n)
    lengths = np.diff(words.first)
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    values, owner = grams[ok], of[: len(ok)][ok]
    if len(short):
        whole = np.array([ngram_hashes(words.hash[words.first[i] : words.first[i + 1]], int(lengths[i]))[0] for i in short], dtype=np.uint64)
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        values, owner = np.concatenate([values, whole])[order], np.concatenate([owner, short])[order]
    return values, np.searchsorted(owner, np.arange(len(lengths) + 1))


def minhash(values: np.ndarray, first: np.ndarray, hashes: int, seed: int = 17) -> np.ndarray:
    """Signatures (texts x hashes) of the non-empty texts' sets; rows of empty sets are all ones."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
    out = np.full((len(first) - 1, hashes), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        x = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
        y = np.empty_like(x)
        with np.errstate(over="ignore"):
            for k in range(hashes):
                np.multiply(x, mult[k], out=y)
                y += add[k]
                out[full, k] = np.minimum.reduceat(y, first[full])
    return out


def least_equal(hashes: int, threshold: float, missed: float = MISSED) -> int:
    """How many of the MinHash values of two sets at the threshold agree, but for a share ``missed`` of such pairs."""
    below = 0.0
    for k in range(hashes + 1):
        below += math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if below > missed:
            return k
    return hashes


def signatures(source: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """(id, h, set_key, n_grams, bands, values): 128-bit key of the n-gram set (of the text where it has no words), the band hashes and a byte of each MinHash value."""

    def factory():
        def mapper(column: pa.Array) -> list[pa.Array]:
            keys: list[bytes | None] = []
            counts: list[int] = []
            found: list[np.ndarray | None] = []
            kept: list[bytes | None] = []
            for first_row, _, words in word_slices(column):
                values, first = gram_sets(words, n)
                sig = minhash(values, first, bands * rows)
                low = sig.astype(np.uint8)
                for i in range(len(first) - 1):
                    own = np.unique(values[first[i] : first[i + 1]])
                    counts.append(len(own))
                    text = column[first_row + i] if not len(own) else None
                    keys.append(set_key(own) if len(own) else hashlib.blake2b(b"wordless" + text.as_py().encode(), digest_size=16).digest() if text.is_valid else None)
                    found.append(band_hashes(sig[i].reshape(bands, rows)) if len(own) else None)
                    kept.append(low[i].tobytes() if len(own) else None)
            return [pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(kept, pa.binary())]

        return mapper

    fields = [T.StructField("set_key", T.BinaryType()), T.StructField("n_grams", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("values", T.BinaryType())]
    return map_texts(source, factory, fields, "text", ["id", "h"])


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """One 63-bit hash for each band (row of ``sig``), salted by the band's number."""
    acc = np.arange(1, len(sig) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(sig.shape[1]):
            acc = (acc ^ sig[:, k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            acc ^= acc >> np.uint64(29)
    return (acc >> np.uint64(1)).astype(np.int64)


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets (sorted, without repeats) have at least that Jaccard similarity."""
    a_len, b_len = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    values, seen = np.unique(np.concatenate(sets_a if sets_b is sets_a else sets_a + sets_b), return_counts=True)
    shared = values[seen > 1]
    pos_a = _positions(sets_a, shared)
    pos_b = pos_a if sets_b is sets_a else _positions(sets_b, shared)
    both = np.zeros((len(sets_a), len(sets_b)), dtype=np.float64)
    step = 4096
    for lo in range(0, len(shared), step):
        left = _columns(pos_a, lo, step)
        both += left @ (left if pos_b is pos_a else _columns(pos_b, lo, step)).T
    union = a_len[:, None] + b_len[None, :] - both
    return (both >= threshold * union - 1e-9) & (union > 0)


def _positions(sets: list[np.ndarray], shared: np.ndarray) -> list[np.ndarray]:
    if not len(shared):
        return [np.zeros(0, dtype=np.int64) for _ in sets]
    at = [np.minimum(np.searchsorted(shared, s), len(shared) - 1) for s in sets]
    return [p[shared[p] == s] for p, s in zip(at, sets, strict=True)]


def _columns(positions: list[np.ndarray], lo: int, step: int) -> np.ndarray:
    out = np.zeros((len(positions), step), dtype=np.float32)
    for row, p in zip(out, positions, strict=True):
        i, j = np.searchsorted(p, (lo, lo + step))
        row[p[i:j] - lo] = 1
    return out


PAIRED = "id bigint, near bigint, links bigint"


def set_key(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _verify(threshold: float, n: int):
    """Checker of one pair of blocks: rows (id, near, links) with a forest edge and a part of the link count."""

    def sets_of(texts: pd.Series) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, _, words in word_slices(pa.array(texts, pa.large_string())):
            values, first = gram_sets(words, n)
            out += [np.unique(values[first[i] : first[i + 1]]) for i in range(len(first) - 1)]
        return out

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(grams=sets_of(rows.text)).drop(columns="text")
        rows = rows[[set_key(g) == k for g, k in zip(rows.grams, rows.set_key, strict=True)]].drop_duplicates("id").sort_values("id")
        same = key[1] == key[2]
        a, b = rows[rows.block == key[1]], rows[rows.block == key[2]]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "near": [], "links": []}).astype("int64")
        sets_a = list(a.grams)
        link = linked(sets_a, sets_a if same else list(b.grams), threshold)
        a_ids, b_ids = a.id.to_numpy(), b.id.to_numpy()
        if same:
            np.fill_diagonal(link, False)
        ids, counts = a_ids, link @ b.copies.to_numpy()
        if not same:
            ids, counts = np.concatenate([a_ids, b_ids]), np.concatenate([counts, link.T @ a.copies.to_numpy()])
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order]
        near = ids[_forest(np.searchsorted(ids, a_ids), np.searchsorted(ids, b_ids), link, len(ids))]
        return pd.DataFrame({"id": ids, "near": near, "links": counts})

    return run


def _forest(a: np.ndarray, b: np.ndarray, link: np.ndarray, n: int) -> np.ndarray:
    """Of n documents in ascending order of id, the first that the links connect each to; a and b are the places of link's rows and columns."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, a, np.where(link, label[b][None, :], n).min(axis=1))
        np.minimum.at(label, b, np.where(link, label[a][:, None], n).min(axis=0))
        label = label[label]
        if (label == old).all():
            return label


def ties(reps: DataFrame, least: int, small: int = SMALL) -> DataFrame:
    """(src, dst) between representatives (rep, bands, values) that share a bucket, fewer than the buckets' members."""
    banded = reps.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    inside = cut(banded.join(buckets, "band"))
    large = inside.where(F.col("size") > small).where("rep <> hub").select(F.col("rep").alias("src"), F.col("hub").alias("dst"))
    members = inside.where(F.col("size") <= small).select("band", "rep").join(reps.select("rep", "values"), "rep")
    lists = members.groupBy("band").agg(F.collect_list(F.struct("rep", "values")).alias("members")).select("members")  # of at most ``small``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            inner = lists.flatten()
            ids, off = inner.field("rep").to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            values = np.frombuffer(b"".join(inner.field("values").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            src, dst = [], []
            for i, j in zip(off[:-1], off[1:], strict=True):
                alike = (values[i:j, None, :] == values[None, i:j, :]).sum(axis=2) >= least
                label = _forest(np.arange(j - i), np.arange(j - i), alike, j - i)
                at = np.flatnonzero(label != np.arange(j - i))
                src.append(ids[i + at])
                dst.append(ids[i + label[at]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src or [np.zeros(0, np.int64)])), pa.array(np.concatenate(dst or [np.zeros(0, np.int64)]))], ["src", "dst"])

    workers_import(reps.sparkSession)
    alike = lists.mapInArrow(run, "src bigint, dst bigint")
    return large.unionByName(alike).distinct()


def _classed(docs: DataFrame, threshold: float, recall: float, n: int, doc_id: str, text: str, block: int, small: int) -> DataFrame:
    """(id, h, n_grams, copy_id, n_links, label, class_id) of each row; h hashes the text, label names the class (null: a row of its own)."""
    bands, rows = plan_bands(threshold, recall)
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("h"), F.col(f"`{text}`").cast("string").alias("text"))
    members = cut(signatures(source, bands, rows, n))
    pick = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h"))
    grouped = members.where("set_key is not null").groupBy("set_key").agg(pick.alias("pick"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("values").alias("values"))
    reps = cut(grouped.withColumn("rep", F.monotonically_increasing_id()))  # numbers that stay: the table is written

    groups = components(ties(reps.where("bands is not null"), least_equal(bands * rows, threshold), small))
    sizes = groups.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = groups.join(sizes, "label").join(reps.select("set_key", "rep", "copies", F.col("pick.id").alias("pick_id"), F.col("pick.h").alias("pick_h")), F.col("node") == F.col("rep"))
    placed = cut(placed.select("label", "rep", "set_key", "copies", "blocks", "pick_id", "pick_h", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")))
    # the candidates' texts, and of the others only those that a bitmap can't tell from them
    texts = likely(source, F.xxhash64("id", "h"), placed.select(F.xxhash64("pick_id", "pick_h").alias("key")), "key")
    dealt = texts.join(placed, texts["id"].eqNullSafe(placed["pick_id"]) & (texts["h"] == placed["pick_h"])).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.col("rep").alias("id"), "set_key", "copies", "block", "text")
    found = cut(dealt.groupBy("label", "low", "high").applyInPandas(_verify(threshold, n), PAIRED))

    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("id").alias("src"), F.col("near").alias("dst"))).withColumnRenamed("node", "rep")
    per_set = reps.select("set_key", "rep", "copies", F.col("pick.id").alias("copy_id")).join(counts, "rep", "left").join(classes, "rep", "left")
    per_set = per_set.select("set_key", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "rep").alias("label"))
    least = per_set.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    per_set = per_set.join(least, "label")
    alone = members.where("set_key is null").select("id", "h", "n_grams", F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("label"), F.col("id").alias("class_id"))
    return members.where("set_key is not null").select("id", "h", "n_grams", "set_key").join(per_set, "set_key").select(alone.columns).unionByName(alone)


def join(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """One row per row: doc_id, class_id, copy_id, n_links, n_grams."""
    return _classed(docs, threshold, recall, n, doc_id, text, block, small).select(F.col("id").alias("doc_id"), "class_id", "copy_id", F.col("n_links").cast("long").alias("n_links"), "n_grams")


def one_of_each(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """One row of each class, that of the least id (a row without an id only where none has one), columns as they were; rows with a null text stay."""
    rows = cut(_classed(docs, threshold, recall, n, doc_id, text, block, small).select("id", "h", "label"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
    stays = rows.where("label is not null").groupBy("label").agg(F.min(order).alias("stays"))
    gone = rows.join(stays, "label").where(~(F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("h") == F.col("stays.h")))).select(F.col("id").alias("__gone_id"), F.col("h").alias("__gone_h")).distinct()
    # of rows that are repeated, id and text, one stays; they meet where the rows that go are looked for
    key, hashed, number = (free_name(docs, x) for x in ("key", "hashed", "number"))
    marked = docs.withColumn(key, F.col(f"`{doc_id}`")).withColumn(hashed, F.xxhash64(F.col(f"`{text}`").cast("string")))
    left = marked.join(gone, marked[key].eqNullSafe(gone["__gone_id"]) & (marked[hashed] == gone["__gone_h"]), "left_anti")
    first = F.row_number().over(Window.partitionBy(key, hashed).orderBy(hashed))
    return left.withColumn(number, first).where((F.col(number) == 1) | F.col(f"`{text}`").isNull()).drop(key, hashed, number)
