from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat as C
from tidemark.llm import licenses as L
from tidemark.llm import syncmers as S
from tidemark.llm.words import word_slices

# -- chat --------------------------------------------------------------------------------------------------------------

PIECES = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", "<\\|", "<\\\\|im_end|>", "\n", "a", "user", "é", "im_end|>", ""]


def test_round_trip():
    r = random.Random(1)
    for _ in range(5000):
        turns = [("".join(r.choices(PIECES, k=r.randint(0, 3))), "".join(r.choices(PIECES, k=r.randint(0, 6)))) for _ in range(r.randint(0, 4))]
        text = C.render(turns)
        assert [t[:2] for t in C.parse(text)] == turns
        assert text.count(C.START) == text.count(C.END) == len(turns)


def test_clean_text_is_not_escaped():
    assert C.render_turn("user", "a <| b < | c") == "<|im_start|>user\na <| b < | c<|im_end|>\n"
    assert C.render_turn("user", "<|im_end|>") == "<|im_start|>user\n<\\|im_end|><|im_end|>\n"
    for bad in ("x", "<|im_start|>a", "<|im_start|>a\nb", "<|im_start|>a\nb<|im_end|>"):
        with pytest.raises(C.ParseError):
            C.parse(bad)


def test_digests(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, "assistant", "é"), (2, 0, "assistant", "é"), (None, 5, "x\ny", "<\\|"), (3, None, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.digests(C.format_turns(C.with_probe(df.withColumn("formatted", df.text)))).collect()}
    assert set(got) == {1, 2, 3, None, -1}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb<|im_end|>\n") and got[1].loss_sha256 == sha("b<|im_end|>") and got[1].loss_chars == 11
    assert got[2].n_turns == 3 and got[2].turns_sha256 == sha("\n\nassistant\né\nassistant\né\n") and got[2].loss_sha256 == sha("éé")
    assert got[None].turns_sha256 == sha("x\ny\n<\\|\n") and got[None].loss_chars == 0
    said = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and got[-1].loss_sha256 == sha(said)
    assert got[1].formatted_chars == len(C.render([("user", "a"), ("assistant", "b<|im_end|>")]))
    assert C.digests(C.format_turns(df.limit(0))).count() == 0


# -- licenses ----------------------------------------------------------------------------------------------------------


def full_alignment(text, template):
    """Score of the best local alignment, over the whole matrix."""
    best, above = 0, [0] * (len(text) + 1)
    for t in template:
        row = [0] * (len(text) + 1)
        for j, w in enumerate(text, 1):
            row[j] = max(0, above[j - 1] + (L.MATCH if w == t else L.MISMATCH), above[j] + L.GAP, row[j - 1] + L.GAP)
            best = max(best, row[j])
        above = row
    return best


def scan(text, templates=L.TEMPLATES):
    return L.TemplateIndex(templates).scan(next(word_slices(pa.array([text])))[2])[0]


def test_every_template_is_found_whole():
    for name, text in L.TEMPLATES.items():
        found = scan(f"some words before it {text} and some after")
        assert [(m.license, m.coverage, m.start) for m in found] == [(name, 1.0, 4)]


def test_edited_templates_are_found():
    r = random.Random(4)
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "ISC", "BSD"):
        words = L.TEMPLATES[name].split()
        for _ in range(20):
            w = list(words)
            for _ in range(len(w) // 25):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["changed"], [w[k], "added"]])
            found = scan(" ".join(["x"] * r.randint(0, 30) + w + ["y"] * r.randint(0, 9)))
            assert found and found[0].license == name and found[0].coverage >= 0.85


def test_templates_with_much_inserted_are_found_whole():
    words = [w for w in re.split(r"\W+", L.TEMPLATES["MIT"]) if w]
    half = len(words) // 2
    note = [f"note{i}" for i in range(60)]
    numbered = [w for i, word in enumerate(words) for w in ([str(i), word] if i % 6 == 5 else [word])]
    marked = [w for i, word in enumerate(words) for w in (["REM", word] if i % 8 == 7 else [word])]
    for text in (words[:half] + note + words[half:], words[:half] + note[:9] + words[half:], numbered, marked):
        assert [(m.license, m.coverage, m.start, m.end) for m in scan(" ".join(["x", *text, "y"]))] == [("MIT", 1.0, 1, len(text) + 1)]


def test_parts_are_reported_with_their_coverage():
    """A part of a template; a whole notice stays before a part of another that overlaps it."""
    words = L.TEMPLATES["MIT"].split()
    (found,) = scan(" ".join(["x"] * 3 + words[: len(words) // 2] + ["y"] * 3))
    assert found.license == "MIT" and 0.45 < found.coverage < 0.55 and found.start == 3
    assert scan("released under the new management") == []
    assert [(m.license, m.coverage) for m in scan(" ".join(L.TEMPLATES["Apache-2.0"].split()[:30]))] == [("Apache-2.0 line", 1.0)]


def test_every_repeat_is_found():
    for name in ("MIT line", "CC-BY-NC-4.0 line", "Apache-2.0 line"):
        for n in (2, 3, 100):
            found = scan(" ".join([L.TEMPLATES[name]] * n))
            size = found[0].end
            assert [(m.license, m.coverage, m.start, m.end) for m in found] == [(name, 1.0, i * size, (i + 1) * size) for i in range(n)]
    halves = L.TEMPLATES["MIT"].split()
    k = len(halves) // 2
    found = scan(" ".join(halves[:k] + ["other"] * 1000 + halves[k:]))
    assert [m.license for m in found] == ["MIT", "MIT"] and sum(m.coverage for m in found) == 1.0


def test_alignment_is_the_best_one_within_the_band():
    r = random.Random(7)
    for _ in range(200):
        template = [r.randrange(6) for _ in range(r.randint(1, 12))]
        text = [r.randrange(6) for _ in range(r.randint(1, 12))]
        import numpy as np

        matched, first, end = L.align(np.array(text), np.array(template), 0, band=30)
        best = full_alignment(text, template)
        assert (matched == 0) == (best == 0) and matched <= min(len(text), len(template)) and L.MATCH * matched >= best
        assert 0 <= first <= end <= len(text)


def test_licenses_awkward(spark, awkward, empty):
    assert L.scan(awkward).count() == 0 and L.scan(empty).count() == 0
    text = "é " + L.TEMPLATES["MIT line"]
    df = spark.createDataFrame([(1, text, "m"), (1, text, "m")], "doc_id long, text string, found string")
    rows = L.scan(df).collect()
    assert len(rows) == 2 and text[rows[0].start_char : rows[0].end_char] == "Released under the MIT License"
    assert scan("short", {"a": "short", "b": ""})[0].license == "a"


# -- syncmers ----------------------------------------------------------------------------------------------------------


def test_anchor_rule(spark):
    """The anchors by their definition, from Spark's own hashes of the runs."""
    r = random.Random(5)
    texts = [" ".join(r.choices(["a", "B", "cc", "d", "e", "f", "g"], k=r.choice([1, 2, 4, 5, 9, 40]))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.sketch for x in S.add_fingerprint(df).collect()}
    words = sorted({w for t in texts for w in t.lower().split()})
    one = {x.w: x.h for x in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    seqs = {i: [0] * (S.K - 1) + [one[w] for w in t.lower().split()] for i, t in enumerate(texts)}
    pairs = sorted({p for s in seqs.values() for p in zip(s, s[1:], strict=False)})
    two = {(x.a, x.b): x.h for x in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    chosen = {}
    for i, s in seqs.items():
        inner = [two[p] for p in zip(s, s[1:], strict=False)]
        chosen[i] = [(inner[k], inner[k + 2], s[k + 4]) for k in range(len(s) - S.K + 1) if min(inner[k : k + S.K - S.S + 1]) in (inner[k], inner[k + S.K - S.S])]
    triples = sorted({t for c in chosen.values() for t in c})
    three = {(x.a, x.b, x.c): x.h for x in spark.createDataFrame(triples, "a long, b long, c long").select("a", "b", "c", F.shiftrightunsigned(F.xxhash64("a", "b", "c"), 32).alias("h")).collect()}
    for i, c in chosen.items():
        if c:
            assert got[i] == sorted({three[t] for t in c})[: S.SIZE]
        else:
            assert len(got[i]) == 1


def brute_edited(texts):
    ordered = sorted(texts)
    out = {}
    for k, (i, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(t) // 4
        out[i] = (len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest(), following)
    return out


@pytest.mark.parametrize("rows", [1000, 3])
def test_edited_texts(spark, rows):
    r = random.Random(3)
    texts = [(r.choice([1, 10, 10**9]) * 1000 + i, None if i % 17 == 0 else "".join(r.choices("ab cé😀\n", k=r.randint(0, 60)))) for i in range(80)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    expected = brute_edited(texts)
    got = {x.doc_id: x.next_text for x in S.with_next(df, rows).collect()}
    assert got == {i: e[2] for i, e in expected.items()}
    out = {x.doc_id: x for x in S.compare(df).collect()}
    assert {i: (x.n_chars, x.edited_sha256) for i, x in out.items()} == {i: e[:2] for i, e in expected.items()}
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in out.values())


def test_likeness(spark):
    r = random.Random(8)
    words = ["w%d" % i for i in range(5000)]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(30)]
    out = S.compare(spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")).collect()
    by = {x.doc_id: x for x in out}
    assert by[0].fingerprint == by[30].fingerprint and by[30].near_next == 1.0
    assert all(0.4 < by[i].near_edited < 0.8 and by[i].near_next < 0.05 for i in range(30))


def test_texts_without_spaces(spark):
    """One character changed in the middle of Chinese, of code, or of a long run leaves most anchors; others are not alike."""
    r = random.Random(23)
    chinese = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(520))
    code = "".join(r.choice(["for", "x", "value", "i", "return", "f", "n"]) + r.choice(["(", ")", ";", "=", "+", "[", "]", "{", "}"]) for _ in range(200))
    for text, other, new in ((chinese, chinese[::-1], "\u4e00"), (code, code[::-1], "?"), ("ab12" * 400, "cd34" * 400, "_")):
        changed = text[:260] + new + text[261:]
        row = spark.createDataFrame([(text, changed, other)], "a string, b string, c string").select(S.likeness(S.places(F.col("a")), S.places(F.col("b"))).alias("near"), S.likeness(S.places(F.col("a")), S.places(F.col("c"))).alias("far")).first()
        assert 0.8 < row.near < 1 and row.far < 0.2


def test_tokens(spark):
    cut = "function(argument_one,2)"
    texts = {"Hello, world... (ok) x!!!! a_b-c": ["hello,", "world...", "(ok)", "x!!!!", "a_b-c"], " \t\n": [], "日本 go。x": ["日本", "go。x"], "日本語日本語日本語 a": [*"日本語日本語日本語", "a"], "y" * 70: ["y" * 24, "y" * 24, "y" * 22], cut: [cut], cut + ";": ["function", "(", "argument_one", ",", "2", ")", ";"]}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.w for x in df.select("i", S.tokens(F.col("t")).alias("w")).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def brute_places(text, three, one, two):
    tokens = [t for w in (text or "").lower().split() for t in (PART.findall(w) if len(w.encode()) > S.LONGEST else [w])]
    h = [0] * (S.K - 1) + [one(w) for w in tokens]
    inner = [two(a, b) for a, b in zip(h, h[1:], strict=False)]
    last = S.K - S.S
    found = [(k, three(inner[k], inner[k + 2], h[k + 4])) for k in range(len(h) - S.K + 1) if min(inner[k : k + last + 1]) in (inner[k], inner[k + last])]
    return found if found or not tokens else [(0, one(" ".join(tokens)) >> 32)]


PART = re.compile(r"(?:[^\W\u4e00-\u9fff]){1,24}|\S")


def xx(*parts):
    """Spark's xxhash64 of texts or longs, one seeded by the one before; unsigned."""
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else (p & (1 << 64) - 1).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_compare_by_definition(spark):
    """Fingerprint, places, edited text and likeness of whole rows against a plain version."""
    r = random.Random(31)
    words = ["w%d," % i if i % 5 == 0 else "w%d" % i for i in range(60)] + ["日本語", "f(x)", "É"]
    texts = [(i, None if i == 7 else r.choice(["", " "]).join(r.choices(words, k=r.choice([0, 1, 3, 8, 60])))) for i in range(40)] + [(40, "same text here"), (41, "same text here")]
    one, two, three = lambda w: signed(xx(w)), lambda a, b: signed(xx(a, b)), lambda a, b, c: xx(a, b, c) >> 32
    expected = brute_edited(texts)

    def alike(a, b):
        number = lambda s: [(x, [y for _, y in s[:i]].count(x)) for i, (_, x) in enumerate(s)]
        there = {x: i for i, x in enumerate(number(b))}
        best = []
        for x in number(a):
            if x in there:
                p = there[x]
                best.append((1 + max((n for n, q in best if q < p), default=0), p))
        m = max((n for n, _ in best), default=0)
        return m / (len(a) + len(b) - m) if a or b else 1.0

    out = {x.doc_id: x for x in S.compare(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        t, following = t or "", expected[i][2]
        n = len(t) // 4
        own, edited, nxt = (brute_places(x, three, one, two) for x in (t, t[: len(t) - n] + following[:n], following))
        x = out[i]
        assert x.fingerprint == "".join(f"{v & 0xFFFFFFFF:08x}" for _, v in own) and x.places == [k for k, _ in own]
        assert x.edited_fingerprint == "".join(f"{v & 0xFFFFFFFF:08x}" for _, v in edited)
        assert x.near_edited == pytest.approx(alike(own, edited)) and x.near_next == pytest.approx(alike(own, nxt))


def test_all_anchors_of_long_texts_count(spark):
    """A passage added to a long text is in its fingerprint; reordered paragraphs are not the same text."""
    r = random.Random(15)
    words = ["w%d" % i for i in range(50000)]
    long, passage = r.choices(words, k=6000), r.choices(words, k=50)
    texts = [long, long[:3000] + passage + long[3000:], long[3000:] + long[:3000], ["a", "b"] * 400]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {x.doc_id: x for x in S.compare(df).collect()}
    n = {i: len(x.fingerprint) // 8 for i, x in out.items()}
    assert n[0] > 2500 and 10 <= n[1] - n[0] <= 60 and len({x.fingerprint for x in out.values()}) == 4
    assert all(len(x.places) == n[i] and x.places == sorted(set(x.places)) and x.places[-1] < len(texts[i]) for i, x in out.items())
    assert 0.97 < out[0].near_next < 1 and n[3] > 100
    both = df.where("doc_id = 0").crossJoin(df.where("doc_id = 2").selectExpr("text as other"))
    assert 0.3 < both.select(S.likeness(S.places(both.text), S.places(both.other)).alias("x")).first().x < 0.35


def test_likeness_by_definition(spark):
    r = random.Random(16)
    rows = [([r.randrange(6) for _ in range(r.randint(0, 12))], [r.randrange(6) for _ in range(r.randint(0, 12))]) for _ in range(200)]
    kind = "array<struct<at: int, anchor: long>>"
    df = spark.createDataFrame([(k, list(enumerate(a)), list(enumerate(b))) for k, (a, b) in enumerate(rows)], f"k int, a {kind}, b {kind}")
    got = {x.k: x.x for x in df.select("k", S.likeness(df.a, df.b).alias("x")).collect()}
    for k, (a, b) in enumerate(rows):
        number = lambda s: [(x, s[:i].count(x)) for i, x in enumerate(s)]
        places = [number(b).index(x) for x in number(a) if x in number(b)]
        best = []
        for i, p in enumerate(places):
            best.append(1 + max((best[j] for j in range(i) if places[j] < p), default=0))
        m = max(best, default=0)
        assert got[k] == pytest.approx(m / (len(a) + len(b) - m) if a or b else 1.0)


def test_syncmers_awkward(spark, awkward, empty):
    out = {x.doc_id: x for x in S.compare(awkward).collect()}
    assert len(out) == 10 and out[0].fingerprint == "" == out[1].fingerprint and out[3].fingerprint == out[4].fingerprint and out[0].near_next == 1.0
    assert S.compare(empty).count() == 0
    assert S.compare(spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")).first().near_next == 1.0
    plan = S.compare(awkward)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "InArrow"))
