from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe, packing

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = "aaabbbc  \n\n\t'sdtreTHE0123456789!!..é日本語​\x85\x1c　😀"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def texts(n, size):
    r = random.Random(4)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, size))) for _ in range(n)] + ["the cat sat on the mat's edge, isn't it? 12345 <|endoftext|>", "a" * 700, "-" * 300, "ab" * 200, " " * 90]


def test_same_ids_as_the_library(encoder):
    for t in texts(3000, 40):
        ids = encoder.encode(t)
        assert ids == LIBRARY.encode_ordinary(t)
        assert encoder.decode(ids) == t.encode()


def test_every_token_and_pair_rule(encoder):
    r = random.Random(1)
    v = encoder.vocabulary
    for _ in range(4000):
        a, b = r.randrange(len(RANKS)), r.randrange(len(RANKS))
        assert v.fits(a, b) == (v.merged(v.tokens[a] + v.tokens[b]) == [a, b])


def test_append_and_edit_pieces(encoder):
    r = random.Random(8)
    for t in texts(300, 50):
        data = t.encode()
        cut = r.randint(0, len(data))
        p = bpe.Piece(encoder.vocabulary, data[:cut])
        p.append(data[cut:])
        assert p.last == bpe.Piece(encoder.vocabulary, data).last
        a = r.randint(0, len(data))
        b = r.randint(a, min(len(data), a + 6))
        new = "".join(r.choices(ALPHABET, k=r.randint(0, 5))).encode()
        p.replace(a, b, new)
        assert p.last == bpe.Piece(encoder.vocabulary, data[:a] + new + data[b:]).last


def test_an_edit_computes_only_what_is_near(encoder):
    p = bpe.Piece(encoder.vocabulary, b"abcdefgh" * 500)
    assert p.replace(100, 101, b"zz") < 2 * encoder.vocabulary.longest + 50


def test_append_and_edit_texts(encoder):
    r = random.Random(9)
    for t in texts(1500, 60):
        x = bpe.EncodedText(encoder, t)
        a = r.randint(0, len(t))
        b = r.randint(a, min(len(t), a + 5))
        new = "".join(r.choices(ALPHABET, k=r.randint(0, 6)))
        x.replace(a, b, new)
        assert x.ids() == LIBRARY.encode_ordinary(t[:a] + new + t[b:])
        x.append(" and more")
        assert x.ids() == LIBRARY.encode_ordinary(x.text)
    long = bpe.EncodedText(encoder, "word " * 2000)
    assert long.replace(5000, 5004, "other") < 10


def test_frame(spark, awkward, empty):
    out = bpe.encode(awkward, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "id"))
    source = {r.doc_id: r.text or "" for r in awkward.collect()}
    for r in out.collect():
        ids = LIBRARY.encode_ordinary(source[r.doc_id])
        assert (r["ids"], r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(source[r.doc_id].encode()).hexdigest()
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def brute_best_fit(sizes, length):
    rooms, rows = [], []
    for p in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= sizes[p]]
        if fits:
            least = min(fits)[0]
            i = max(i for room, i in fits if room == least)
        else:
            i = len(rooms)
            rooms.append(length)
            rows.append([])
        rooms[i] -= sizes[p]
        rows[i].append(p)
    return sorted(rooms)


def test_best_fit_decreasing():
    r = random.Random(6)
    for _ in range(30):
        length = r.choice([8, 100, 2048])
        sizes = [r.randint(1, length) for _ in range(r.randint(0, 300))]
        rows = packing.best_fit_decreasing(sizes, length)
        assert sorted(p for row in rows for p in row) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[p] for p in row) for row in rows) == brute_best_fit(sizes, length)


def test_packing_is_lossless(spark, awkward, empty):
    packed = packing.pack(awkward, RANKS, public_tokenizers.PATTERN, length=64, group_tokens=1000).collect()
    found: dict = {}
    for r in packed:
        ids, positions = np.frombuffer(r["ids"], dtype="<u2"), np.frombuffer(r.position_ids, dtype="<u2")
        assert len(ids) == len(positions) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for doc, part, offset, a, b in zip(r.doc_ids, r.parts, r.offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert list(positions[a:b]) == list(range(b - a)) and offset == part * 64
            found[doc, part] = ids[a:b].tolist()
        assert set(ids[r.n_tokens :].tolist()) <= {len(RANKS)}
    for r in awkward.collect():
        ids = [i for part in range(len(found)) for i in found.get((r.doc_id, part), [])]
        assert ids == LIBRARY.encode_ordinary(r.text or "")
    assert len({r.pack_id for r in packed}) == len(packed)
    assert packing.pack(empty, RANKS, public_tokenizers.PATTERN).count() == 0
