"""Byte-level BPE (operator 12): encoding and decoding with a given rank file.

A text is split by the pattern; each match becomes tokens on its own. A match that is a token is that token. Else it starts as
single bytes, and the leftmost of its adjacent pairs whose joined bytes have the least rank is merged, until no pair is a token.

1. The driver reads the rank file (its path is a parameter) and lists every split of a token into two tokens: the pairs that can merge. This
   list depends on the vocabulary only, and is sent to the tasks, which hash it into a table of open addresses.
2. A task splits its texts, a few megabytes at a time, and looks up the matches it has met before. New ones are dealt into buckets by length.
3. A bucket is one matrix, a row for each match, padded. Each round every row merges its leftmost pair of minimum rank and closes up, so
   the matrix is one column narrower; the two pairs beside the merge are looked up anew. Rows without pairs leave.
4. Matches longer than ``WIDEST`` bytes are one row each, and a round merges all pairs of the minimum rank from left to right. That equals
   one merge at a time unless a merge makes a pair of lower rank; then the round ends there.

Whole texts are encoded, whatever their length; a task holds the tokens of ``PIECE_BYTES`` of texts, or of one longer text, and up to ``MATCHES`` matches.

Null and empty texts have no tokens. Repeated rows are encoded alike. Invalid UTF-8 counts as U+FFFD. Special tokens do not exist: their
strings are ordinary text. Other columns pass, but for one with the result's name, which is replaced. An empty table gives no rows. ``decode`` gives null for null ids and
for ids that hold a null or no token of the vocabulary; bytes need not be whole characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.share import Shared
from ledgerloom.llm.text import C1, U, slices

WIDEST = 128  # bytes of a match in the widest matrix
CELLS = 1 << 22  # cells of a matrix
MATCHES = 1 << 18  # distinct matches a task remembers
NONE = np.int32(np.iinfo(np.int32).max)
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[start : start + size]`` one after the other, and their offsets."""
    ends = np.concatenate(([0], np.cumsum(size)))
    return flat[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)], ends


class Vocabulary:
    """Tokens by id, and the pairs of tokens that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte is no token")
        self.whole = ranks
        top = max(ranks.values()) + 1
        by_id = [b""] * top
        for token, i in ranks.items():
            by_id[i] = token
        self.size = np.array([len(t) for t in by_id], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(ranks[t[:k]] << 32 | ranks[t[k:]]): i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pair, self.joined = np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32)
        self._keys: np.ndarray | None = None

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a file with a token in base 64 and its rank on each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))})

    def _hash(self) -> None:
        bits = max(4, int(np.ceil(np.log2(2 * len(self.pair) + 1))))
        self._shift, self._mask = U(64 - bits), U((1 << bits) - 1)
        keys, ids = np.full(1 << bits, EMPTY), np.full(1 << bits, NONE)
        todo = np.arange(len(self.pair))
        slot = (self.pair * C1) >> self._shift
        while len(todo):
            free = keys[slot[todo]] == EMPTY
            keys[slot[todo[free]]] = self.pair[todo[free]]  # one of those that want a slot gets it
            own = keys[slot[todo]] == self.pair[todo]
            ids[slot[todo[own]]] = self.joined[todo[own]]
            todo = todo[~own]
            slot[todo] = (slot[todo] + U(1)) & self._mask
        self._keys, self._ids = keys, ids

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (and id) of each pair joined, NONE where it is no token; ids below 0 are padding."""
        if self._keys is None:
            self._hash()
        key = left.astype(np.int64).view(np.uint64) << U(32) | (right.astype(np.int64).view(np.uint64) & U(0xFFFFFFFF))
        slot = (key * C1) >> self._shift
        out = np.full(key.shape, NONE)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key, slot, flat = key.ravel(), slot.ravel(), out.ravel()
        while len(todo):
            held = self._keys[slot[todo]]
            hit = held == key[todo]
            flat[todo[hit]] = self._ids[slot[todo[hit]]]
            todo = todo[~hit & (held != EMPTY)]
            slot[todo] = (slot[todo] + U(1)) & self._mask
        return out

    def merge_rows(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each row (padded with -1 at the end) after all merges, and how many there are."""
        out, rows = np.full_like(tokens, -1), np.arange(len(tokens))
        rank = self.find(tokens[:, :-1], tokens[:, 1:])
        while len(rows) and tokens.shape[1] > 1:
            at = rank.argmin(1)
            least = rank[np.arange(len(rows)), at]
            done = least == NONE
            if done.any():
                out[rows[done], : tokens.shape[1]] = tokens[done]
                rows, tokens, rank, at, least = (v[~done] for v in (rows, tokens, rank, at, least))
            place, n = np.arange(len(rows)), tokens.shape[1] - 1
            tokens[place, at] = least
            column = np.arange(n)[None]
            tokens = np.take_along_axis(tokens, column + (column > at[:, None]), 1)
            rank = np.take_along_axis(rank, column[:, : n - 1] + (column[:, : n - 1] >= at[:, None]), 1)
            for side in (at - 1, at):
                has = (side >= 0) & (side < n - 1)
                r, c = place[has], side[has]
                rank[r, c] = self.find(tokens[r, c], tokens[r, c + 1])
        out[rows, : tokens.shape[1]] = tokens
        return out, (out >= 0).sum(1)

    def merge_long(self, tokens: np.ndarray) -> np.ndarray:
        rank = self.find(tokens[:-1], tokens[1:])
        while len(rank) and (least := rank.min()) < NONE:
            at = np.flatnonzero(rank == least)
            run = np.cumsum(np.concatenate(([0], np.diff(at) != 1)))  # of overlapping pairs every other one goes
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            place = at - np.arange(len(at))
            while True:
                new, keep = tokens.copy(), np.ones(len(tokens), bool)
                new[at], keep[at + 1] = least, False
                new = new[keep]
                joined = np.full(len(at), least, np.int32)
                # What a merge makes: with all to its left merged, nothing to its right.
                left = self.find(np.where(place > 0, new[np.maximum(place - 1, 0)], -1), joined)
                right = self.find(joined, np.where(at + 2 < len(tokens), tokens[np.minimum(at + 2, len(tokens) - 1)], -1))
                early = np.flatnonzero(np.minimum(left, right)[:-1] < least)
                if not len(early):
                    break
                at, place = at[: early[0] + 1], place[: early[0] + 1]
            old = np.flatnonzero(keep)
            rank = rank[old[:-1]]
            near = np.unique(np.concatenate((place - 1, place)))
            near = near[(near >= 0) & (near < len(new) - 1)]
            rank[near] = self.find(new[near], new[near + 1])
            tokens = new
        return tokens

    def encode_matches(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all matches one after the other, and each one's number of tokens."""
        out: list = [None] * len(matches)
        buckets: dict[int, list[int]] = {}
        for i, m in enumerate(matches):
            token = self.whole.get(m)
            if token is not None:
                out[i] = (token,)
            elif len(m) > WIDEST:
                out[i] = self.merge_long(self.single[np.frombuffer(m, np.uint8)])
            else:
                buckets.setdefault((len(m) - 1).bit_length(), []).append(i)
        for bits, members in buckets.items():
            width = 1 << bits
            for lo in range(0, len(members), CELLS // width):
                own = members[lo : lo + CELLS // width]
                size = np.array([len(matches[i]) for i in own])
                inside = np.arange(width)[None] < size[:, None]
                tokens = np.full(inside.shape, -1, np.int32)
                tokens[inside] = self.single[np.frombuffer(b"".join(matches[i] for i in own), np.uint8)]
                merged, n = self.merge_rows(tokens)
                for i, row, k in zip(own, merged, n.tolist(), strict=True):
                    out[i] = row[:k]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int32, int(sizes.sum())), sizes


class Encoder:
    """Remembers the tokens of matches it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, matches: list[str]) -> None:
        tokens, size = self.vocabulary.encode_matches([m.encode() for m in matches])
        self.known.update(zip(matches, range(len(self.known), len(self.known) + len(matches)), strict=True))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.flat, self.size = np.concatenate((self.flat, tokens)), np.concatenate((self.size, size))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, and the offsets of each text's."""
        matches = [self.pattern.findall(t) for t in texts]
        every = set().union(*matches)
        new = [m for m in every if m not in self.known]
        if new and len(self.known) + len(new) > MATCHES:
            self.clear()
            new = list(every)
        if new:
            self.learn(new)
        ends = np.concatenate(([0], np.cumsum([len(m) for m in matches]))).astype(np.int64)
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(matches)), np.int64, int(ends[-1]))
        tokens, at = gather(self.flat, self.start[number], self.size[number])
        return tokens, at[ends]


def _strings(column: pa.Array) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in column.cast(pa.large_binary()).to_pylist()]


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocabulary, pattern)
    for batch in batches:
        for piece in slices(batch, "_text"):
            tokens, ends = encoder.encode(_strings(piece.column("_text")))
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], ids], [*piece.schema.names[:-1], "_ids"])


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    top = len(vocabulary.size)
    for batch in batches:
        lists = batch.column("_ids")
        held = lists.flatten()
        null = lists.is_null().to_numpy(zero_copy_only=False)
        n = np.where(null, 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        ids = held.fill_null(-1).to_numpy(zero_copy_only=False)
        known = (ids >= 0) & (ids < top)
        known[known] = vocabulary.size[ids[known]] > 0
        row = np.repeat(np.arange(len(n)), n)
        null[row[~known]] = True
        ids = ids[known]
        data, at = gather(vocabulary.bytes, vocabulary.start[ids], vocabulary.size[ids])
        ends = at[np.concatenate(([0], np.cumsum(np.bincount(row[known], minlength=len(n)))))]
        valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [valid, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out.cast(pa.binary())], [*batch.schema.names[:-1], "_bytes"])


def _map(df: DataFrame, column, name: str, out: str, kind: T.DataType, task) -> DataFrame:
    """``df`` and column ``out``, which ``task`` makes from ``column`` (named ``name`` inside, the last one)."""
    rest = [c for c in df.columns if c != out]
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], column.alias(name))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out_name := "_ids" if name == "_text" else "_bytes", kind)])
    done = rows.mapInArrow(task, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col(out_name).alias(out))


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text's tokens."""
    shared = Shared(docs.sparkSession, vocabulary)
    text = F.col(f"`{text_col}`").cast("string")
    return _map(docs, text, "_text", out, T.ArrayType(T.IntegerType()), lambda it: _encode(it, shared.value, pattern))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """``rows`` with the bytes of each row's tokens."""
    shared = Shared(rows.sparkSession, vocabulary)
    ids = F.col(f"`{ids_col}`").cast("array<int>")
    return _map(rows, ids, "_ids", out, T.BinaryType(), lambda it: _decode(it, shared.value))
