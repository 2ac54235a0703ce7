"""Byte-level BPE by ranks, as numpy matrices: every row merges its leftmost pair of least rank each round.

The distinct pieces of a slice of texts are put in matrices by length, one row
a piece, one column a token. A hash table gives the rank of a pair of ids. A
row in which no pair merges is done and leaves the matrix; the columns to the
right of a merge move up by one. Ids equal what the rank file's own library
gives, as both take the same pair each time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import columns_of, text_pieces

_NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Longer pieces (bytes) are merged one by one with a heap: a matrix takes a round over the whole row for every merge.
MATRIX_BYTES = 256
#: Distinct pieces that a worker remembers before it starts afresh.
REMEMBERED = 150_000


class PairTable:
    """Hash table from a pair of ids to the id (= rank) of the merged token, with linear probing, looked up in bulk."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            (ranks[token[:i]], ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self._bits = max(4, int(np.ceil(np.log2(2 * len(pairs) + 1))))
        size = 1 << self._bits
        self._keys = np.full(size, -1, np.int64)
        self._values = np.full(size, _NONE, np.int32)
        self._probes = 1
        keys, slots = (left << 32) | right, self._slot((left << 32) | right)
        while len(keys):
            free = self._keys[slots] == -1
            _, firsts = np.unique(slots[free], return_index=True)
            placed = np.flatnonzero(free)[firsts]
            self._keys[slots[placed]] = keys[placed]
            self._values[slots[placed]] = merged[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, merged, slots = keys[rest], merged[rest], (slots[rest] + 1) & (size - 1)
            self._probes += bool(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self._bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, the largest int32 where they do not merge (also where an id is negative)."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slot(keys)
        found = np.where(self._keys[slots] == keys, self._values[slots], _NONE)
        open_ = np.flatnonzero((self._keys[slots] != keys) & (self._keys[slots] != -1))
        for _ in range(self._probes):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & (len(self._keys) - 1)
            held = self._keys[slots[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self._values[slots[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return found.reshape(shape)


class ByteBPE:
    """Encoder and decoder of one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        count = max(ranks.values()) + 1
        self.lengths = np.zeros(count, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        flat = bytearray(int(self.lengths.sum()))
        for token, rank in ranks.items():
            flat[self.starts[rank] : self.starts[rank] + len(token)] = token
        self.bytes = np.frombuffer(bytes(flat), np.uint8)
        self._known: dict[str, bytes] = {}  # ids as native int32

    def merge_rows(self, rows: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Ids of every row of a matrix of byte ids, ``counts`` long and padded with -1."""
        out: list[np.ndarray] = [None] * len(rows)  # type: ignore[list-item]
        where = np.arange(len(rows))
        ranks = self.pairs.ranks(rows[:, :-1], rows[:, 1:]) if rows.shape[1] > 1 else np.zeros((len(rows), 0), np.int32)
        while len(where):
            if ranks.shape[1]:
                at = ranks.argmin(1)
                least = ranks[np.arange(len(at)), at]
                going = least != _NONE
            else:
                going = np.zeros(len(where), bool)
            for i in np.flatnonzero(~going):
                out[where[i]] = rows[i, : counts[i]].copy()
            if not going.any():
                break
            if not going.all():  # rows that are done leave the matrix
                rows, ranks, counts, where, at, least = (x[going] for x in (rows, ranks, counts, where, at, least))
            counts = counts - 1
            line = np.arange(len(at))
            rows[line, at] = least
            right = np.arange(rows.shape[1] - 1) > at[:, None]
            rows = np.where(right, rows[:, 1:], rows[:, :-1])
            ranks = np.where(right[:, :-1], ranks[:, 1:], ranks[:, :-1])
            if ranks.shape[1]:
                has = at < ranks.shape[1]
                i, j = line[has], at[has]
                ranks[i, j] = self.pairs.ranks(rows[i, j], rows[i, j + 1])
                has = at > 0
                i, j = line[has], at[has]
                ranks[i, j - 1] = self.pairs.ranks(rows[i, j - 1], rows[i, j])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        whole = len(ids)
        initial = self.pairs.ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(initial[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(initial != _NONE)]
        heapq.heapify(heap)
        flat, lookup = self.bytes.tobytes(), self.ranks

        def token(i: int) -> bytes:
            return flat[self.starts[ids[i]] : self.starts[ids[i]] + self.lengths[ids[i]]]

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= whole or ids[j] != b:
                continue  # one side has merged since
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < whole:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < whole:
                    new = lookup.get(token(x) + token(y))
                    if new is not None:
                        heapq.heappush(heap, (new, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each of these distinct pieces."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list[np.ndarray] = [None] * len(raw)  # type: ignore[list-item]
        lengths = np.array([len(b) for b in raw])
        rest = []
        for i, b in enumerate(raw):
            whole = self.ranks.get(b)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(b) > MATRIX_BYTES:
                out[i] = self.merge_long(b)
            else:
                rest.append(i)
        rest = np.array(rest, np.int64)
        edges = [0, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 48, 96, MATRIX_BYTES]
        for low, high in zip(edges, edges[1:]):
            own = rest[(lengths[rest] > low) & (lengths[rest] <= high)]
            for at in range(0, len(own), 1 << 16):
                part = own[at : at + (1 << 16)]
                width = int(lengths[part].max())
                flat = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
                rows = np.where(np.arange(width) < lengths[part][:, None], self.byte_ids[flat], np.int32(-1))
                for i, ids in zip(part, self.merge_rows(rows, lengths[part])):
                    out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; null and empty texts have none."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self._known) > REMEMBERED:
            self._known.clear()
        new = list({p for pieces in split for p in pieces}.difference(self._known))
        self._known.update(zip(new, (ids.tobytes() for ids in self.encode_pieces(new))))
        return [np.frombuffer(b"".join(map(self._known.__getitem__, pieces)), np.int32) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after another, gathered from one table."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[at].tobytes()


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """The tokenizer of a rank file (base-64 token and rank a line), kept by a worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBPE(ranks, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row: the whole text by byte-level BPE, no special tokens.

    Null and empty texts get an empty array; repeated rows and null ids stay.
    Other columns are not read. ``ranks_path`` names a file that every
    executor has.
    """
    source = columns_of(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        for piece, texts in text_pieces(batches, text_col):
            yield pa.RecordBatch.from_arrays([piece.column(id_col), _list_array(bpe.encode(texts))], names=[id_col, "ids"])

    return source.mapInArrow(run, T.StructType([source.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary) of the rows of ``encode``; null ids decode to null."""
    source = columns_of(encoded, [id_col, "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        for batch in batches:
            texts = pa.array([None if x is None else bpe.decode(x) for x in _lists(batch.column("ids"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[id_col, "ids", "decoded"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType())]))


def _list_array(lists: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32), pa.int32()))


def _lists(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for valid, low, high in zip(column.is_valid().to_pylist(), offsets, offsets[1:]):
        yield values[low:high] if valid else None


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, its ids decoded again, and both hashed.

    One pass, so ids and bytes do not leave the task between the steps.
    ids_sha256 is over the decimal ids with commas between them. Rows are as
    in ``encode``.
    """
    source = columns_of(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        decimal = np.array([str(i) for i in range(len(bpe.lengths))], object)
        for piece, texts in text_pieces(batches, text_col):
            encoded = bpe.encode(texts)
            ids_hash = [hashlib.sha256(",".join(decimal[ids].tolist()).encode()).hexdigest() for ids in encoded]
            decoded_hash = [hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in encoded]
            counts = pa.array([len(ids) for ids in encoded], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [piece.column(id_col), _list_array(encoded), counts, pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())],
                names=[id_col, "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    fields = [source.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")]
    return source.mapInArrow(run, T.StructType(fields))
