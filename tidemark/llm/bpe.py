"""Byte-level BPE by prefix dynamic programming (operator 9), and exact decoding.

For every byte prefix of a piece there is exactly one token that can end a valid
encoding of that prefix: a token whose pair with the last token of the shorter
prefix survives merging.  Storing that token for each prefix gives the encoding
by walking back, lets text be appended without looking at what came before, and
lets an edit be encoded anew only until the stored tokens agree again.

Defined results: a null text is an empty text with no ids; a piece of any length
takes time and memory in proportion to its bytes; caches are bounded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowmap import map_texts

CACHED_BYTES, CACHED_PAIRS, SLICE_CHARS = 100 << 20, 400_000, 2 << 20
_NONE = 1 << 60


class Vocabulary:
    """Token ranks, and which pairs of tokens may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self._blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self._lengths, self._offsets = lengths, np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """The merges of a few bytes, least rank and leftmost first, until ``stop`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best, at = _NONE, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], _NONE)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts that a token's own merges leave at its left (0) or right (1) end, from the token itself down to a
        byte: (bytes, rank from which on it is there, rank at which it is merged away)."""
        known = self._spines[side].get(token)
        if known is None:
            data, until, known = self.tokens[token], _NONE, []
            while True:
                rank = self.ranks[data] if len(data) > 1 else -1
                known.append((data, rank, until))
                if len(data) == 1:
                    break
                halves = self.merged(data, 2)
                data, until = self.tokens[halves[-1 if side else 0]], rank
            self._spines[side][token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, next to each other, are left unmerged: no two parts that stand at the
        boundary at the same time make a token that is merged before either of them is gone."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            get, known = self.ranks.get, True
            for a, a_from, a_until in self._spine(left, 1):
                for b, b_from, b_until in self._spine(right, 0):
                    rank = get(a + b)
                    if rank is not None:
                        when = max(rank, a_from, b_from)
                        if when < a_until and when <= b_until:
                            known = False
                            break
                if not known:
                    break
            self._pairs[key] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.tokens[token]) == [token]
        return known

    def extend(self, last: list[int], data: bytes, end: int) -> None:
        """Append to ``last`` the last tokens of the prefixes up to ``end`` bytes."""
        get, pair, fits, longest = self.ranks.get, self._pairs.get, self.fits, self.longest
        for stop in range(len(last) + 1, end + 1):
            for start in range(stop - 1, max(-1, stop - longest - 1), -1):
                token = get(data[start:stop])
                if token is None:
                    continue
                if start:
                    ok = pair(last[start - 1] << 32 | token)
                    if ok is None:
                        ok = fits(last[start - 1], token)
                else:
                    ok = self.whole(token)
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError(f"byte {data[stop - 1]} is not in the vocabulary")

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self._lengths[ids]
        before = np.cumsum(lengths) - lengths
        return self._blob[np.repeat(self._offsets[ids] - before, lengths) + np.arange(int(lengths.sum()))].tobytes()


class Piece:
    """The last token of every byte prefix of one piece."""

    __slots__ = ("vocabulary", "data", "last")

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exactly the state of the longer piece; only the new prefixes are computed."""
        self.data += more
        self.vocabulary.extend(self.last, self.data, len(self.data))

    def replace(self, start: int, stop: int, by: bytes) -> int:
        """Edit the bytes start..stop; returns how many prefixes were computed anew."""
        old, shift = self.last, len(by) - (stop - start)
        self.data = self.data[:start] + by + self.data[stop:]
        self.last = old[:start]
        agreed = done = 0
        while len(self.last) < len(self.data):
            end = len(self.last) + 1
            self.vocabulary.extend(self.last, self.data, end)
            done += 1
            same = end - shift > stop and old[end - shift - 1] == self.last[-1]
            agreed = agreed + 1 if same else 0
            if agreed >= self.vocabulary.longest:  # all that a later token can rest on is as it was
                self.last += old[end - shift :]
        return done

    def ids(self) -> list[int]:
        token = self.vocabulary.ranks.get(self.data)
        if token is not None:
            return [token]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Text to ids and back; each match of the pattern is encoded separately.

    Ids of pieces are kept, as little-endian unsigned 32-bit integers, up to ``CACHED_BYTES``.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.find = self.pattern.findall
        self._known: dict[str, bytes] = {}
        self._held = 0

    def _learn(self, pieces: set[str]) -> None:
        """Encode the pieces not known yet, in order, so that each starts from the prefix it shares with the one before."""
        if self._held > CACHED_BYTES:
            self._known.clear()
            self._held = 0
        extend, ranks, tokens = self.vocabulary.extend, self.vocabulary.ranks, self.vocabulary.tokens
        before, last = b"", []
        for piece in sorted(p for p in pieces if p not in self._known):  # the order of characters is that of their bytes
            data = piece.encode()
            token = ranks.get(data)
            if token is None:
                shared = 0
                for x, y in zip(before, data, strict=False):
                    if x != y:
                        break
                    shared += 1
                del last[shared:]
                extend(last, data, len(data))
                before, out, end = data, [], len(data)
                while end:
                    token = last[end - 1]
                    out.append(token)
                    end -= len(tokens[token])
                out.reverse()
            else:
                out = [token]
            self._known[piece] = struct.pack(f"<{len(out)}I", *out)
            self._held += 2 * len(data) + 4 * len(out) + 150

    def packed_all(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        lists = [self.find(t) for t in texts]
        self._learn(set().union(*lists))
        known = self._known.__getitem__
        return [b"".join(map(known, pieces)) for pieces in lists]

    def packed(self, text: str) -> bytes:
        return self.packed_all([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def decode(self, ids: Sequence[int]) -> bytes:
        return self.vocabulary.decode(np.asarray(ids, dtype=np.int64))


class EncodedText:
    """A text with its pieces, for exact appends and for edits that encode only what changed."""

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text = encoder, text
        found = list(encoder.pattern.finditer(text))
        self.starts = [m.start() for m in found]
        self.parts = [encoder.packed(m.group()) for m in found]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, by: str) -> int:
        """Edit the characters start..stop; returns how many pieces were encoded anew."""
        shift = len(by) - (stop - start)
        keep = max(0, bisect_right(self.starts, start) - 3)  # white space may be two pieces, and looks one character past its end
        old_starts, old_parts = self.starts, self.parts
        self.text = self.text[:start] + by + self.text[stop:]
        starts, parts = old_starts[:keep], old_parts[:keep]
        where = {s + shift: i for i, s in enumerate(old_starts) if s >= stop}
        done = 0
        for m in self.encoder.pattern.finditer(self.text, old_starts[keep] if keep < len(old_starts) else 0):
            if m.start() >= start + len(by) and m.start() in where:
                i = where[m.start()]
                starts = starts + [s + shift for s in old_starts[i:]]
                parts = parts + old_parts[i:]
                break
            starts.append(m.start())
            parts.append(self.encoder.packed(m.group()))
            done += 1
        self.starts, self.parts = starts, parts
        return done

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.parts), dtype="<u4").tolist()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", keep: Sequence[str] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """``keep`` columns, ``ids`` (array of int; only if asked for), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    The vocabulary, of a fixed size, goes to every task; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def factory():
        encoder = encoder_of(shared.value)

        def mapper(column: pa.Array) -> list[pa.Array]:
            packed, sizes, ids_sha, text_sha = [], [], [], []
            for texts in text_slices(column):
                for data in encoder.packed_all(texts):
                    ids = np.frombuffer(data, dtype="<u4")
                    sizes.append(len(ids))
                    ids_sha.append(hashlib.sha256(data).hexdigest())
                    text_sha.append(hashlib.sha256(encoder.vocabulary.decode(ids)).hexdigest())
                    if with_ids:
                        packed.append(ids)
            out = [pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                out.insert(0, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, "<u4"), *packed]).astype(np.int32))))
            return out

        return mapper

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_texts(docs, factory, [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + fields, text, keep)


def text_slices(column: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of about SLICE_CHARS characters."""
    run: list[str] = []
    size = 0
    for value in column:
        run.append(value.as_py() or "")
        size += len(run[-1])
        if size >= SLICE_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


_encoders: dict[int, Encoder] = {}


def encoder_of(vocabulary: tuple[dict[bytes, int], str]) -> Encoder:
    """The encoder of a vocabulary, kept while a Python worker lives; only the latest is kept."""
    key = id(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*vocabulary)
        _encoders[key].source = vocabulary  # keeps the id from being used again
    return _encoders[key]
