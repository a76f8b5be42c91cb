"""Toxicity by a chain of linear classifiers (operator 7).

The categories are predicted in order; the probability of each earlier category is a
feature of the later ones.  In training that probability is out of fold (predicted by
models that have not seen the document), so that the later models learn how far an
unseen document's value can be trusted.

Features are the presence of each word (by its 64-bit hash), and binned shares of upper
case, of symbols and of distinct words.  A model keeps the features whose log-odds
ratio is significant and weighs them by a logistic regression on those ratios.

The models are fitted on the driver on at most ``SAMPLE`` labelled documents, those of the
least id hash; every document is scored, whole, without a shuffle.

Defined results: a null text is an empty text; without labelled documents, or without both
values of a category, its probability is the share of the labels (0 without labels) and no
document is over the threshold; rows are scored each, repeated or not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import map_texts
from .words import Words, buffers, find_sorted, mix64, slices

SAMPLE, FOLDS, MAX_FEATURES, LEAST_DOCS, LEAST_Z = 12_000, 3, 20_000, 3, 3.0

#: Categories in the order of the chain, each with its condition on the labels.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}

_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[0x41:0x5B] = 1
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,'-\""]] = 1


def _binned(kind: int, share: np.ndarray) -> np.ndarray:
    """A feature for each text: the share's bin, in powers of two."""
    bins = np.clip(np.floor(np.log2(np.maximum(share, 2.0**-10))), -10, 0).astype(np.int64) + 10
    return mix64((np.uint64(0xA5A5 + kind) << np.uint64(32)) + bins.astype(np.uint64))


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text numbers, feature hashes, texts) of consecutive slices; a text may name a feature more than once."""
    raw, off = buffers(column)
    for i, j in slices(off):
        data, bounds = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        words = Words(data, bounds)
        of, n = words.text_of_word(), j - i
        size = np.maximum(np.diff(bounds), 1)
        total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])  # noqa: E731, B023
        counts = np.maximum(np.diff(words.first), 1)
        pairs = np.unique(of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ words.hash, return_index=True)[1]
        distinct = np.bincount(of[pairs], minlength=n)
        extra = [_binned(0, total(_UPPER[data]) / size), _binned(1, total(_SYMBOL[data]) / size), _binned(2, distinct / counts)]
        owner = np.concatenate([of[pairs], *[np.arange(n)] * len(extra)])
        yield owner, np.concatenate([words.hash[pairs], *extra]), n


@dataclass
class Linear:
    """Weights of feature hashes (sorted) and of the earlier categories' logits."""

    keys: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    bias: float
    threshold: float = 2.0
    names: list[str] = field(default_factory=list)

    def margins(self, owner: np.ndarray, hashes: np.ndarray, texts: int, earlier: np.ndarray) -> np.ndarray:
        hit, at = find_sorted(self.keys, hashes)
        return self.bias + np.bincount(owner[hit], weights=self.weights[at], minlength=texts) + earlier @ self.chained


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(owner: np.ndarray, hashes: np.ndarray, y: np.ndarray, earlier: np.ndarray, *, steps: int = 300, l2: float = 0.02) -> Linear:
    """Logistic regression on the significant features' log-odds ratios."""
    n, positive = len(y), int(y.sum())
    if not n or positive in (0, n):
        share = positive / n if n else 0.0
        return Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(earlier.shape[1]), float(logit(np.array([share]))[0]))
    keys, place = np.unique(hashes, return_inverse=True)
    inside = np.bincount(place, weights=y[owner], minlength=len(keys))
    outside = np.bincount(place, minlength=len(keys)) - inside
    a, b = inside + 0.5, outside + 0.5
    ratio = np.log(a / (positive - inside + 0.5)) - np.log(b / (n - positive - outside + 0.5))
    z = ratio / np.sqrt(1 / a + 1 / b + 1 / (positive - inside + 0.5) + 1 / (n - positive - outside + 0.5))
    chosen = np.flatnonzero((inside + outside >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))
    chosen = np.sort(chosen[np.argsort(-np.abs(z[chosen]), kind="stable")[:MAX_FEATURES]])
    keys, ratio = keys[chosen], ratio[chosen]
    hit, at = find_sorted(keys, hashes)
    rows, value = owner[hit], ratio[at]
    w, c, bias = np.full(len(keys), 0.5), np.zeros(earlier.shape[1]), float(logit(np.array([positive / n]))[0])
    m1, m2 = np.zeros(len(keys) + len(c) + 1), np.zeros(len(keys) + len(c) + 1)
    for step in range(1, steps + 1):
        p = sigmoid(bias + np.bincount(rows, weights=w[at] * value, minlength=n) + earlier @ c)
        error = (p - y) / n
        gradient = np.concatenate([np.bincount(at, weights=error[rows] * value, minlength=len(keys)) + l2 / n * w, earlier.T @ error + l2 / n * c, [error.sum()]])
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        w, c, bias = w - move[: len(keys)], c - move[len(keys) : -1], bias - move[-1]
    return Linear(keys, w * ratio, c, float(bias))


def best_threshold(y: np.ndarray, p: np.ndarray) -> float:
    """The threshold of the greatest F1 among the out-of-fold probabilities, half way to the next lower one."""
    if not len(y) or y.sum() in (0, len(y)):
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ranked = p[order]
    last = np.append(ranked[1:] < ranked[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((ranked[k] + (ranked[k + 1] if k + 1 < len(ranked) else 0.0)) / 2)


def out_of_fold(owner: np.ndarray, hashes: np.ndarray, y: np.ndarray, earlier: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """Each document's probability by a model of the other folds; documents are dealt to folds by their number."""
    fold, unseen = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        learn, held = fold != k, fold == k
        if held.any():
            renumber, rows = np.cumsum(learn) - 1, learn[owner]
            model = fit_linear(renumber[owner[rows]], hashes[rows], y[learn], earlier[learn])
            renumber, rows = np.cumsum(held) - 1, held[owner]
            unseen[held] = sigmoid(model.margins(renumber[owner[rows]], hashes[rows], int(held.sum()), earlier[held]))
    return unseen


def fit_chain(owner: np.ndarray, hashes: np.ndarray, labels: dict[str, np.ndarray], folds: int = FOLDS) -> list[Linear]:
    """One model per category, in order."""
    chain, earlier = [], np.zeros((len(next(iter(labels.values()))), 0))
    for name, y in labels.items():
        y = y.astype(np.float64)
        unseen = out_of_fold(owner, hashes, y, earlier, folds)
        model = fit_linear(owner, hashes, y, earlier)
        model.threshold, model.names = best_threshold(y, unseen), [name]
        chain.append(model)
        earlier = np.column_stack([earlier, logit(unseen)])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, *, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> list[Linear]:
    """The chain fitted on at most ``sample`` labelled documents; contradicting labels of an id count by their majority."""
    categories = categories or CATEGORIES
    share = lambda condition: (F.avg(F.expr(f"cast({condition} as double)")) > 0.5)
    known = labels.where(f"{doc_id} is not null").groupBy(F.col(doc_id).alias("label_id")).agg(*(share(c).alias(f"y{i}") for i, c in enumerate(categories.values())))
    known = known.dropna().orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    source = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text")).join(F.broadcast(known), "label_id")
    found = map_texts(source, _feature_lists, [T.StructField("f", T.ArrayType(T.LongType()))], "text", ["label_id", *(f"y{i}" for i in range(len(categories)))])
    rows = found.toArrow()
    rows = rows.sort_by([("label_id", "ascending")])
    lists = rows["f"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int64()))
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) if len(lists) else [])
    hashes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return fit_chain(owner, hashes, {name: rows[f"y{i}"].to_numpy(zero_copy_only=False).astype(bool) for i, name in enumerate(categories)})


def _feature_lists():
    def mapper(column: pa.Array) -> list[pa.Array]:
        values, sizes = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for owner, hashes, n in features(column):
            order = np.argsort(owner, kind="stable")
            values.append(hashes[order].view(np.int64))
            sizes.append(np.bincount(owner, minlength=n))
        return [pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(values)))]

    return mapper


def predict(docs: DataFrame, chain: Sequence[Linear], *, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``p_<category>`` and ``<category>`` (probability over the threshold) in the chain's order."""
    shared = docs.sparkSession.sparkContext.broadcast(list(chain))

    def factory():
        models = shared.value

        def mapper(column: pa.Array) -> list[pa.Array]:
            parts: list[list[np.ndarray]] = [[] for _ in models]
            for owner, hashes, n in features(column):
                earlier = np.zeros((n, 0))
                for part, model in zip(parts, models, strict=True):
                    p = sigmoid(model.margins(owner, hashes, n, earlier))
                    part.append(p)
                    earlier = np.column_stack([earlier, logit(p)])
            probabilities = [np.concatenate(p) for p in parts]
            return [a for p, m in zip(probabilities, models, strict=True) for a in (pa.array(p, pa.float64()), pa.array(p > m.threshold, pa.bool_()))]

        return mapper

    fields = [f for m in chain for f in (T.StructField(f"p_{m.names[0]}", T.DoubleType()), T.StructField(m.names[0], T.BooleanType()))]
    return map_texts(docs, factory, fields, text, keep)
