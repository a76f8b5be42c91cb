"""Document fingerprints of closed syncmers (operator 3), DataFrame functions only.

The sequence is the text's tokens, lower case, after ``K - 1`` start marks.  A token is
a white-space separated word; a word of more than ``LONGEST`` bytes is cut into runs of at
most as many letters, digits and underscores, single characters of scripts that write no
spaces, and other single characters, so that texts without spaces, Chinese or code, have
anchors all along.  A run of ``K`` tokens is an anchor (a closed
syncmer) if the least hash of its inner runs of ``S`` tokens is that of the first or the
last one.  Whether a run is an anchor depends on its own tokens alone, so an edit moves no
anchor that it doesn't touch.  The fingerprint is the 32-bit hashes of all anchors of
the text, repeats among them, in order of place, as hexadecimal digits; their places
(the number of the run's last token) are a column of their own.

Likeness matches the anchors of two whole texts, the k-th occurrence of a hash with the
k-th; of the matched ones it takes as many as come in the same order in both texts (the
longest increasing subsequence), and divides by the anchors of both without these.

Defined results: a null text is an empty text, with an empty fingerprint; two
empty fingerprints have likeness 1; a text with tokens but without an anchor has
the hash of all its tokens as its only anchor, at place 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pseudonyms import let

K, S, SIZE = 5, 2, None  # SIZE: all anchors are kept
LONGEST = 24
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
PART = rf"[\p{{L}}\p{{M}}\p{{N}}_&&[^{_UNSPACED}]]{{1,{LONGEST}}}+|\S"
BUCKET_ROWS, COARSE = 1000, 32


def tokens(text: Column) -> Column:
    """Array of the text's tokens."""
    long = lambda w: F.octet_length(w) > LONGEST
    cut = lambda w: F.when(long(w), F.regexp_extract_all(w, F.lit(PART), F.lit(0))).otherwise(F.array(w))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return let(words, lambda ws: F.when(F.exists(ws, long), F.flatten(F.transform(ws, cut))).otherwise(ws))


def places(text: Column) -> Column:
    """Array of (at, anchor): all anchors of the text in order of place; hashes are 0 .. 2^32 - 1."""
    words = tokens(text)
    one = lambda at, anchor: F.struct(at.cast("int").alias("at"), anchor.alias("anchor"))

    def of_words(w: Column) -> Column:
        hashes = F.concat(F.array_repeat(F.lit(0).cast("long"), K - 1), F.transform(w, lambda x: F.xxhash64(x)))

        def of_hashes(h: Column) -> Column:
            inner = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, S))))

            def of_inner(s: Column) -> Column:
                last = K - S
                kept = F.transform(
                    s,
                    lambda x, i: F.when(
                        (i + K <= F.size(h)) & (F.least(x, F.get(s, i + last)) <= F.least(*(F.get(s, i + j) for j in range(1, last)))),
                        one(i, F.shiftrightunsigned(F.xxhash64(x, F.get(s, i + 2), F.get(h, i + 4)), 32)),
                    ),
                )
                return F.filter(kept, lambda x: x.isNotNull())

            return let(inner, of_inner)

        found = let(hashes, of_hashes)
        return let(found, lambda f: F.when((F.size(f) == 0) & (F.size(w) > 0), F.array(one(F.lit(0), F.shiftrightunsigned(F.xxhash64(F.array_join(w, " ")), 32)))).otherwise(f))

    return let(words, of_words)


def anchors(text: Column) -> Column:
    """Sorted array of all different anchor hashes."""
    return F.sort_array(F.array_distinct(places(text)["anchor"]))


def fingerprint(found: Column) -> Column:
    return F.array_join(F.transform(found["anchor"], lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def _parts(rows: Column, begins, body) -> Column:
    """``body(first, last)`` of each run of ``rows``; ``begins(i)`` says whether a run begins at index i > 0."""
    indices = F.filter(F.transform(rows, lambda _, i: i), lambda i: (i == 0) | begins(i))
    return let(indices, lambda starts: F.transform(starts, lambda a, k: body(a, F.coalesce(F.get(starts, k + 1), F.size(rows)) - 1)))


def _numbered(found: Column, side: int) -> Column:
    """(anchor, occurrence, side, index) of each anchor."""

    def of_sorted(s: Column) -> Column:
        row = lambda a, i: let(F.get(s, i), lambda x: F.struct(x["anchor"].alias("anchor"), (i - a).alias("k"), F.lit(side).alias("side"), x["i"].alias("i")))
        return F.flatten(_parts(s, lambda i: F.get(s, i)["anchor"] != F.get(s, i - 1)["anchor"], lambda a, b: F.transform(F.sequence(a, b), lambda i: row(a, i))))

    return let(F.sort_array(F.transform(found, lambda x, i: F.struct(x["anchor"].alias("anchor"), i.alias("i")))), of_sorted)


def _in_order(pairs: Column) -> Column:
    """Length of the longest subsequence of (a, b), in order of a, in which b increases.

    Pairs that follow each other in both texts are one run, of which all or none belong to it.
    """
    breaks = lambda i: (F.get(pairs, i)["a"] != F.get(pairs, i - 1)["a"] + 1) | (F.get(pairs, i)["b"] != F.get(pairs, i - 1)["b"] + 1)
    runs = _parts(pairs, breaks, lambda i, j: F.struct(F.get(pairs, i)["b"].alias("low"), F.get(pairs, j)["b"].alias("high"), (j - i + 1).alias("n")))
    none = F.expr("cast(array() as array<struct<high: int, n: int>>)")

    def add(done: Column, run: Column) -> Column:
        before = F.array_max(F.transform(F.filter(done, lambda d: d["high"] < run["low"]), lambda d: d["n"]))
        return F.concat(done, F.array(F.struct(run["high"].alias("high"), (run["n"] + F.coalesce(before, F.lit(0))).alias("n"))))

    return F.coalesce(F.array_max(F.transform(F.aggregate(runs, none, add), lambda d: d["n"])), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Of two texts' places: anchors matched in order, over the anchors of both texts without these."""

    def of_both(s: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            return let(F.get(s, i + 1), lambda y: F.when((x["anchor"] == y["anchor"]) & (x["k"] == y["k"]), F.struct(x["i"].alias("a"), y["i"].alias("b"))))

        return let(F.sort_array(F.filter(F.transform(s, pair), lambda p: p.isNotNull())), _in_order)

    matched = let(F.sort_array(F.concat(_numbered(a, 0), _numbered(b, 1))), of_both)
    none = ~F.arrays_overlap(a["anchor"], b["anchor"])
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).when(none, F.lit(0.0)).otherwise(let(matched, lambda m: m / (F.size(a) + F.size(b) - m)))


def add_fingerprint(docs: DataFrame, *, text: str = "text", sketch: str = "sketch") -> DataFrame:
    """The documents with a column of their different anchors, in ascending order; one narrow stage."""
    return docs.withColumn(sketch, anchors(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def _bucketed(docs: DataFrame, rows: int) -> DataFrame:
    """Columns b0 and b1: ranges of ids, in order, of about ``rows`` documents; null ids come first.

    b0 lies between quantiles of the ids (at most COARSE ** 2 of them); b1 splits that range evenly.
    """
    n = docs.count()
    wanted = max(1, -(-n // rows))
    quantiles = min(COARSE * COARSE, wanted)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / quantiles for i in range(quantiles)] + [1.0], 20 * COARSE * COARSE)).first()[0] or [0, 0]
    cuts = sorted(set(cuts))
    groups = [cuts[i : i + COARSE] for i in range(0, len(cuts), COARSE)]
    table = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    heads = F.array(*(F.lit(g[0]) for g in groups))
    below = lambda array, x: F.size(F.filter(array, lambda c: c <= x))
    coarse = F.greatest(below(heads, F.col("doc_id")) - 1, F.lit(0))
    b0 = F.greatest(let(coarse, lambda c: c * COARSE + below(F.get(table, c), F.col("doc_id")) - 1), F.lit(0))
    flat = F.array(*map(F.lit, [*cuts, cuts[-1] + 1]))
    out = docs.withColumn("b0", F.when(F.col("doc_id").isNull(), -1).otherwise(b0))
    parts = -(-wanted // quantiles)
    low, high = F.get(flat, F.col("b0")), F.get(flat, F.col("b0") + 1)
    share = F.floor((F.col("doc_id") - low) * parts / F.greatest(high - low, F.lit(1)))
    return out.withColumn("b1", F.when(F.col("b0") < 0, 0).otherwise(F.greatest(F.lit(0), F.least(share, F.lit(parts - 1)))).cast("int") if parts > 1 else F.lit(0))


def with_next(docs: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id and text of each document, and ``next_text``: that of the next document by doc_id (then text), or of the first.

    The table is dealt out once, by ranges of ids.  Each range also gets the first
    document of the next range, found by an aggregate that keeps one row a range.
    """
    base = _bucketed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rows)
    firsts = base.groupBy("b0", "b1").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    keys = base.select("b0", "b1").distinct()
    # the range before each: in its own b0, or the last one of the b0 before (of which there are at most COARSE ** 2 + 1)
    lasts = keys.groupBy("b0").agg(F.struct("b0", F.max("b1").alias("b1")).alias("own"))
    ends = lasts.agg(F.max("own").alias("end"))
    lasts = lasts.select("b0", F.lag("own").over(Window.orderBy("b0")).alias("above")).crossJoin(F.broadcast(ends))
    inner = keys.select("b0", "b1", F.lag("b1").over(Window.partitionBy("b0").orderBy("b1")).alias("p1"))
    before = inner.join(lasts, "b0").select("b0", "b1", F.when(F.col("p1").isNotNull(), F.struct("b0", F.col("p1").alias("b1"))).otherwise(F.coalesce("above", "end")).alias("p"))
    guests = firsts.join(before, ["b0", "b1"]).select(F.col("first.doc_id").alias("doc_id"), F.col("first.text").alias("text"), F.col("p.b0").alias("b0"), F.col("p.b1").alias("b1"), F.lit(True).alias("guest"))
    all_rows = base.withColumn("guest", F.lit(False)).unionByName(guests)
    here = Window.partitionBy("b0", "b1").orderBy("guest", "doc_id", "text")
    return all_rows.withColumn("next_text", F.lead("text").over(here)).where("not guest").select("doc_id", "text", "next_text")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints, with the anchors' places, of each document and of its edited text, and likeness to the edited text and to the next document."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - tail), F.substr("next_text", F.lit(1), tail)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), places(F.col("text")).alias("own"), places(F.col("edited")).alias("other"), places(F.col("next_text")).alias("following"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), F.col("own.at").alias("places"), fingerprint(F.col("other")).alias("edited_fingerprint"), F.col("other.at").alias("edited_places"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next")
    )
