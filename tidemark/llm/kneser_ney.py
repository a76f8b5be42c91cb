"""Quality classifier: interpolated modified Kneser-Ney perplexity (operator 8).

The model is one of byte ``ORDER``-grams, the bytes of the texts as they are, trained on every text that the labels
call good.  Texts are dealt by a hash of the text into ``FOLDS`` folds, and a document is scored by the model of the
other folds' trusted texts, whether it is trusted itself or not: all trusted texts are counted, none is scored by
counts that it (or an exact copy) is part of, and the limits hold for texts that no label has seen.

Nothing that grows with the corpus is held in one place.  Each task counts its texts' n-grams and emits the ones it
met; the counts are summed by n-gram (an integer of ``ORDER`` bytes; its low bytes are its suffix, its high bytes its
context).  The orders over two share the two bytes before the last, so n-grams dealt out by these have all that their
continuation counts, contexts' totals and probabilities need: the n-grams asked for are joined to the counts there, in
one exchange for all orders.  The two lowest orders are 2 ** 16 numbers a fold.  The documents are dealt out once in
blocks of about ``BLOCK_BYTES``.  A block asks for the n-grams that occur in it, each once, joined to their probabilities by n-gram,
and the answers come back to the block, where they are looked up byte by byte.

A document is rejected if its perplexity (per byte) lies over the ``QUANTILE`` of the perplexities of the trusted
documents in its language, however many there are.

Defined results: a null or empty text has null perplexity and is accepted; a null language is a language of its own,
and so is an empty one; a language without a trusted document has no limit, and its documents are accepted; a
document with contradicting labels is not trusted; repeated rows are scored (and, if trusted, counted) each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .session import cut, drop_written, workers_import, written
from .words import buffers

ORDER = 5
FOLDS = 2
QUANTILE = 0.995
BLOCK_BYTES = 32 << 20
COUNTED_BYTES = 4 << 20
BITMAP_BITS = 1 << 24
_CHUNK, _MOST_COUNTED, _PACKED = 1 << 20, 1 << 19, 12 << 20
_CODEC = pa.Codec("zstd", 3)


def codes(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, n-gram codes) of consecutive runs of the bytes ``raw[off[0]:off[-1]]``, one code for each byte.

    Text i is ``raw[off[i]:off[i + 1]]``, and every text is preceded by ``ORDER - 1`` zero bytes.  The work is cut into runs
    of at most ``_CHUNK`` bytes, inside texts too.
    """
    data, starts = raw[off[0] : off[-1]], off - off[0]
    for a in range(0, len(data), _CHUNK):
        b = min(a + _CHUNK, len(data))
        lead = min(a, ORDER - 1)
        part = np.concatenate([np.zeros(ORDER - 1 - lead, np.int64), data[a - lead : b].astype(np.int64)])
        code = part[ORDER - 1 :].copy()
        for back in range(1, ORDER):
            code |= part[ORDER - 1 - back : len(part) - back] << (8 * back)
        # bytes of the text before are no part of a text's first n-grams
        i, j = np.searchsorted(starts, (a - ORDER + 2, b))
        for k in range(ORDER - 1):
            at = starts[i:j] + k
            ends = np.append(starts, len(data))[i + 1 : j + 1]
            at = at[(at >= a) & (at < b) & (at < ends)] - a
            code[at] &= (1 << (8 * (k + 1))) - 1
        yield a, code


def count_grams(texts: DataFrame) -> DataFrame:
    """(fold, g, c): how often each n-gram occurs in all the texts (fold, compressed text) of a fold."""
    workers_import(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: list[pd.Series] = [pd.Series(dtype=np.int64) for _ in range(FOLDS)]

        def rows(fold: int) -> Iterator[pa.RecordBatch]:
            whole = counted[fold]
            for i in range(0, len(whole), 1 << 16):
                part = whole.iloc[i : i + (1 << 16)]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, fold, np.int32)), pa.array(part.index.to_numpy(np.int64)), pa.array(part.to_numpy(np.int64))], ["fold", "g", "c"])
            counted[fold] = pd.Series(dtype=np.int64)

        for batch in batches:
            fold_of = batch.column(0).to_numpy()
            for fold in range(FOLDS):
                raw, off = buffers(pa.array([_unpack(t.as_buffer()).to_pybytes() for t in batch.column(1).filter(pa.array(fold_of == fold))], pa.binary()).cast(pa.large_binary()).view(pa.large_string()))
                for _, code in codes(raw, off):
                    at, used = pd.factorize(code)
                    times = pd.Series(np.bincount(at, minlength=len(used)).astype(np.int64), index=used)
                    counted[fold] = counted[fold].add(times, fill_value=0).astype(np.int64) if len(counted[fold]) else times
                    if len(counted[fold]) > _MOST_COUNTED:
                        yield from rows(fold)
        for fold in range(FOLDS):
            yield from rows(fold)

    return texts.select("fold", "text").mapInArrow(run, "fold int, g bigint, c bigint").groupBy("fold", "g").agg(F.sum("c").alias("c"))


class Model(NamedTuple):
    """Models of all folds: ``counts`` (fold, g, c) of the highest order; ``discounts[fold, n, k]`` of an n-gram with count k (3 stands
    for more); ``pairs[fold, g]``, the probability of a pair's last byte after the other; ``buckets``, of how many the n-grams are dealt to."""

    counts: DataFrame
    discounts: np.ndarray
    pairs: np.ndarray
    buckets: int


def _by_context(grams: DataFrame, buckets: int):
    """Groups of n-grams (fold, g) that agree in the two bytes before the last: a bucket has all that share a context of two bytes
    or more, or a suffix of three or more.  One such context has 256 ** (ORDER - 2) n-grams at most, whatever the corpus."""
    near = F.shiftright("g", 8).bitwiseAND((1 << 16) - 1)
    return grams.withColumn("bucket", F.pmod(F.xxhash64(near), F.lit(buckets)).cast("int")).groupBy("fold", "bucket")


def _levels(counts: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, n-grams in order, counts) of a bucket, for each order down to three: counts as they are, continuation counts below."""
    grams, times = counts.column("g").to_numpy(), counts.column("c").to_numpy()
    order = np.argsort(grams)
    grams, times = grams[order], times[order]
    for n in range(ORDER, 2, -1):
        yield n, grams, times
        grams, times = np.unique(grams & ((1 << (8 * (n - 1))) - 1), return_counts=True)


def _discounts(times_of: np.ndarray) -> np.ndarray:
    """By count (0 to 3, and 3 for more), of the numbers of n-grams with counts 1 to 4."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if times_of[0] > 0:
        y = times_of[0] / (times_of[0] + 2 * times_of[1])
        for k in (1, 2, 3):
            if times_of[k - 1] > 0:
                out[k] = min(max(k - (k + 1) * y * times_of[k] / times_of[k - 1], 0.0), k)
    return out


def smoothed(counts: DataFrame, buckets: int) -> Model:
    """Discounts and pairs' probabilities of each fold's counts.

    What comes to the driver is bounded by the alphabet: 2 ** 16 continuation counts of pairs and four numbers an order, by fold.
    """
    workers_import(counts.sparkSession)

    def run(rows: pa.Table) -> pa.Table:
        order, key, value = [], [], []
        for n, grams, times in _levels(rows):
            order.append(np.full(4, n)), key.append(np.arange(1, 5)), value.append(np.bincount(np.minimum(times, 5), minlength=6)[1:5])
        pairs, times = np.unique(grams & 0xFFFF, return_counts=True)
        order.append(np.full(len(pairs), 2)), key.append(pairs), value.append(times)
        n = sum(map(len, key))
        return pa.table({"fold": pa.array(np.full(n, rows.column("fold")[0].as_py(), np.int32)), "n": pa.array(np.concatenate(order).astype(np.int32)), "key": pa.array(np.concatenate(key).astype(np.int64)), "value": pa.array(np.concatenate(value).astype(np.int64))})

    met = _by_context(counts, buckets).applyInArrow(run, "fold int, n int, key bigint, value bigint").groupBy("fold", "n", "key").agg(F.sum("value").alias("value")).toArrow()
    fold, n, key, value = (met.column(c).to_numpy() for c in ("fold", "n", "key", "value"))
    discounts, pairs = np.zeros((FOLDS, ORDER + 1, 4)), np.zeros((FOLDS, 1 << 16))
    for k in range(FOLDS):
        for order in range(3, ORDER + 1):
            of = np.zeros(6)
            of[key[(fold == k) & (n == order)]] = value[(fold == k) & (n == order)]
            discounts[k, order] = _discounts(of[1:])
        after = np.zeros(1 << 16, np.int64)
        after[key[(fold == k) & (n == 2)]] = value[(fold == k) & (n == 2)]
        after = after.reshape(256, 256)  # pairs' first bytes are contexts
        lower = np.full(256, 1 / 256)
        for times in ((after > 0).sum(axis=0)[None, :], after):
            less = _discounts(np.bincount(np.minimum(times, 5).ravel(), minlength=6)[1:5])[np.minimum(times, 3)]
            total = times.sum(axis=1, keepdims=True)
            lower = np.where(total > 0, (times - less + less.sum(axis=1, keepdims=True) * lower) / np.maximum(total, 1), lower)
        pairs[k] = np.broadcast_to(lower, (256, 256)).ravel()
    return Model(counts, discounts, pairs, buckets)


def probabilities(asked: DataFrame, model: Model) -> DataFrame:
    """(fold, g, p): the probability of the last byte of each n-gram (fold, g), given once, after the others.

    The n-grams asked for meet the counts in the bucket of their contexts; there a bucket's orders are summed up and interpolated.
    """
    spark = asked.sparkSession
    workers_import(spark)
    shared = spark.sparkContext.broadcast((model.discounts, model.pairs))

    def run(counts: pa.Table, asked: pa.Table) -> pa.Table:
        want = asked.column("g").to_numpy()
        p = np.zeros(0)
        if len(want):
            fold = asked.column("fold")[0].as_py()
            p = shared.value[1][fold, want & 0xFFFF]
            for n, grams, times in reversed(list(_levels(counts))) if counts.num_rows else ():
                less = shared.value[0][fold, n][np.minimum(times, 3)]
                starts = np.flatnonzero(np.append(True, np.diff(grams >> 8) != 0))
                contexts, total = grams[starts] >> 8, np.add.reduceat(times, starts)
                weight = np.add.reduceat(less, starts)
                gram = want & ((1 << (8 * n)) - 1)
                i, j = np.searchsorted(grams[:-1], gram), np.searchsorted(contexts[:-1], gram >> 8)
                own = np.where(grams[i] == gram, times[i] - less[i], 0.0)
                p = np.where(contexts[j] == gram >> 8, (own + weight[j] * p) / total[j], p)
        return pa.table({"fold": asked.column("fold"), "g": asked.column("g"), "p": pa.array(p, pa.float64())})

    return _by_context(model.counts, model.buckets).cogroup(_by_context(asked.select("fold", "g"), model.buckets)).applyInArrow(run, "fold int, g bigint, p double")


def train(trusted: DataFrame, buckets: int = 1, made: list[str] | None = None) -> Model:
    """The models of all trusted texts (fold, text), one for each fold; ``made`` as in :func:`written`."""
    return smoothed(written(count_grams(trusted), made), buckets)


def fold_of(text: str):
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(FOLDS)).cast("int")


def other_folds(trusted: DataFrame) -> DataFrame:
    """The texts (fold, text) once for each fold that is to be scored without them."""
    return trusted.select(F.explode(F.array(*(F.when(F.col("fold") != k, F.lit(k)) for k in range(FOLDS)))).alias("fold_"), "text").where("fold_ is not null").select(F.col("fold_").alias("fold"), "text")


def score(docs: DataFrame, model: Model, *, keep: Sequence[str] = ("doc_id", "lang"), block_bytes: int = BLOCK_BYTES, total: int | None = None, made: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``n_bytes`` and ``log_perplexity`` (null for an empty text) of documents with a column text.

    ``model`` is that of a fold's own number: the one which scores it; ``total`` is the documents' number of bytes, if known; ``made`` as in :func:`written`.
    """
    workers_import(docs.sparkSession)
    total = _bytes(docs) if total is None else total
    blocks = max(1, -(-total // (FOLDS * block_bytes)))
    spread = F.pmod(F.xxhash64(*keep, "text", F.lit("block")), F.lit(blocks)).cast("int")
    dealt = docs.select((spread * FOLDS + fold_of("text")).alias("block"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce("text", F.lit("")).alias("text"))
    carried = to_arrow_schema(T.StructType(dealt.schema.fields[1:]))
    packed = dealt.mapInArrow(_packer(carried), "block int, rows binary")

    def ask(rows: pa.Table) -> pa.Table:
        raw, off = buffers(_unpacked(rows.column("rows"), carried).column("text"))
        used = np.zeros(0, np.int64)
        for _, code in codes(raw, off):
            used = pd.unique(np.concatenate([used, pd.unique(code)]))
        block = rows.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(used), block, np.int32)), "fold": pa.array(np.full(len(used), block % FOLDS, np.int32)), "g": pa.array(used)})

    # the n-grams of all documents, each once, by a pass of its own: it shuffles no text
    known = written(probabilities(_distinct_grams(docs), model).select("fold", "g", F.log(F.greatest("p", F.lit(1e-12))).cast("float").alias("logp")), made)
    # one exchange of the packed documents serves both who ask and who look up
    pairs = packed.groupBy("block").applyInArrow(ask, "block int, fold int, g bigint")
    answers = pairs.hint("merge").join(known, ["fold", "g"]).select("block", "g", "logp")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("log_perplexity", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def look_up(rows: pa.Table, answered: pa.Table) -> pa.Table:
        rows = _unpacked(rows.column("rows"), carried)
        raw, off = buffers(rows.column("text"))
        index = pd.Index(answered.column("g").to_numpy())
        logs = answered.column("logp").to_numpy().astype(np.float64)
        starts, sums = off - off[0], np.zeros(len(off) - 1)
        for a, code in codes(raw, off):
            part = logs[index.get_indexer(code)]
            i = int(np.searchsorted(starts, a, side="right")) - 1
            j = int(np.searchsorted(starts, a + len(code), side="left"))
            owners = np.arange(i, min(j, len(sums)))
            owners = owners[(np.minimum(starts[owners + 1], a + len(code)) > np.maximum(starts[owners], a))]
            sums[owners] += np.add.reduceat(part, np.maximum(starts[owners] - a, 0))
        n = np.diff(off)
        made = [*(rows.column(f"k{i}").cast(f.type) for i, f in enumerate(list(arrow)[: len(keep)])), pa.array(n, pa.int64()), pa.array(-sums / np.maximum(n, 1), pa.float64(), mask=n == 0)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made], schema=arrow)

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(look_up, schema)


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _distinct_grams(docs: DataFrame) -> DataFrame:
    """(fold, g) of the documents, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = [np.zeros(0, np.int64) for _ in range(FOLDS)]

        def rows(fold: int) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(met[fold]), 1 << 16):
                part = met[fold][i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), fold, np.int32)), pa.array(part)], ["fold", "g"])
            met[fold] = np.zeros(0, np.int64)

        for batch in batches:
            folds = batch.column(0).to_numpy()
            for fold in range(FOLDS):
                raw, off = buffers(batch.column(1).filter(pa.array(folds == fold)))
                for _, code in codes(raw, off):
                    met[fold] = pd.unique(np.concatenate([met[fold], pd.unique(code)]))
                    if len(met[fold]) > _MOST_COUNTED:
                        yield from rows(fold)
        for fold in range(FOLDS):
            yield from rows(fold)

    return docs.select(fold_of("text").alias("fold"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "fold int, g bigint").distinct()


def _packed(data: pa.Buffer) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _unpack(data: pa.Buffer) -> pa.Buffer:
    return _CODEC.decompress(data.slice(8), int.from_bytes(data.slice(0, 8).to_pybytes(), "little"))


def _packer(schema: pa.Schema):
    """Rows (block, columns of ``schema``) as rows (block, bytes), each the compressed rows of one block among some ``_PACKED`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packs() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            block = table.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
            columns = table.select(range(1, table.num_columns)).cast(schema)
            for i, j in zip(starts, np.append(starts[1:], len(order)), strict=True):
                part = columns.take(pa.array(order[i:j])).combine_chunks()
                one = pa.RecordBatch.from_arrays([c.chunk(0) for c in part.columns], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.array([block[order[i]]], pa.int32()), pa.array([_packed(one.serialize())], pa.binary())], ["block", "rows"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.nbytes for b in held) >= _PACKED:
                    yield from packs()
        if held:
            yield from packs()

    return run


def _unpacked(column: pa.ChunkedArray, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(_unpack(b.as_buffer()), schema) for b in column], schema=schema)


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Ids (as text) whose labels all say good."""
    return labels.where("quality is not null").groupBy(F.col(doc_id).cast("string").alias("id")).agg(F.min("quality").alias("q")).where("q = 1 and id is not null").select("id")


def trusted_texts(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(fold, text, compressed) of the documents (doc_id, text) whose id is in ``good``.

    A bitmap of hashed ids, of a fixed size, leaves out most other documents where they are read; the rest are
    joined on their ids, always by sort and merge, so that the plan is the same at every size.
    """
    workers_import(docs.sparkSession)
    slot = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS))
    words = good.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    rows = words.toArrow()  # at most BITMAP_BITS / 64 rows
    bitmap = np.zeros(BITMAP_BITS // 64, dtype=np.uint64)
    bitmap[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy().astype(np.uint64)
            bits = shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))
            left = batch.filter(pa.array((bits & np.uint64(1)).astype(bool)))
            yield pa.RecordBatch.from_arrays([left.column(0), left.column(1), pa.array([_packed(t.as_buffer()) for t in left.column(2)], pa.binary())], ["id", "fold", "text"])

    named = docs.select(F.col("doc_id").cast("string").alias("id"), "text").where("id is not null and length(text) > 0")
    likely = named.select("id", fold_of("text").alias("fold"), "text", slot.alias("slot")).mapInArrow(run, "id string, fold int, text binary")
    return likely.join(good.hint("merge"), "id", "left_semi").select("fold", "text")


def _source(docs: DataFrame, doc_id: str, lang: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold and accepted of every document."""
    return _judged(_source(docs, doc_id, lang, text), labels, quantile).select("doc_id", "lang", "n_bytes", F.exp("log_perplexity").alias("perplexity"), F.exp("threshold").alias("threshold"), "accepted")


def _judged(source: DataFrame, labels: DataFrame, quantile: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents (doc_id, lang, text) with key (a hash of the text), n_bytes, log_perplexity, threshold and accepted; without texts."""
    good = cut(trusted_ids(labels))
    total = _bytes(source)
    # tasks over very little text would emit most n-grams that they meet anew
    parts = max(1, -(-total // COUNTED_BYTES))
    made: list[str] = []
    model = train(other_folds(trusted_texts(source, good)).coalesce(parts), parts, made)
    scored = cut(score(source.withColumn("key", F.xxhash64("text")), model, keep=("doc_id", "lang", "key"), block_bytes=block_bytes, total=total, made=made))
    drop_written(source.sparkSession, made)
    trusted = scored.where("log_perplexity is not null").join(good.withColumnRenamed("id", "__id"), F.col("doc_id").cast("string") == F.col("__id"), "left_semi")
    limits = trusted.groupBy(F.col("lang").alias("of_lang")).agg(F.percentile_approx("log_perplexity", quantile, 10000).alias("threshold"))
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")), "left").drop("of_lang")
    return out.withColumn("accepted", F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True)))


def keep_accepted(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The documents that the classifier accepts, with their columns as they were."""
    verdicts = _judged(_source(docs, doc_id, lang, text), labels, quantile)
    gone = verdicts.where("not accepted").select(F.col("doc_id").alias("__gone_id"), F.col("lang").alias("__gone_lang"), F.col("key").alias("__gone_key")).distinct()
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__gone_id")) & F.col(f"`{lang}`").cast("string").eqNullSafe(F.col("__gone_lang")) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col("__gone_key"))
    return docs.join(gone, same, "left_anti")


def perplexity_by_definition(text: bytes, probability) -> float | None:
    """Perplexity per byte of a text by a function of n-grams (as bytes), for tests and inspection."""
    padded = bytes(ORDER - 1) + text
    logs = [math.log(max(probability(padded[i : i + ORDER]), 1e-12)) for i in range(len(text))]
    return math.exp(-sum(logs) / len(logs)) if logs else None
