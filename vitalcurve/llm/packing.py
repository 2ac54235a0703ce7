"""Packing documents into token windows by the sum-of-squares rule.

Documents come one after another. What is longer than a window fills whole
windows of its own; the rest goes into a window whose fill level makes the sum
of the squares of the numbers of partly filled windows, over all levels, least.
So no level gathers many windows, and pieces of the sizes that are missing are
always met by windows that wait for them. Only the array of those numbers and
the open windows are held.

Open windows are bounded: beyond ``OPEN_WINDOWS`` those of the commonest levels,
half of all, are closed, and at the end of a task all of them are. Closing lays the pieces
of the windows end to end, in the order of their windows, and cuts them where a
window is full; the last words of a task are cut into lengths that are powers
of two, so nothing is padded. Every task packs its own documents, a scan of the
table needs no shuffle, and the result is written, so a lost task is packed
anew as a whole or not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import columns_of, text_pieces, written
from .tokens import PIECE_CHARS, load

#: Tokens in a sequence.
WINDOW = 2_048
#: Partly filled windows that a task holds at most.
OPEN_WINDOWS = 8_192
#: Sequences of one task; the task's number stands above these bits.
_TASK_BITS = 40


class Packer:
    """Windows of ``size`` tokens; pieces are any rows (document number, start, length)."""

    def __init__(self, size: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        if size < 1 or open_windows < 1:
            raise ValueError("a window holds one token at least, and one window is open at least")
        self.size, self.open_windows = size, open_windows
        #: Partly filled windows of each level; ``size`` stands for full ones, whose number does not count, and stays 0.
        self.levels = np.zeros(size + 1, np.int64)
        self._windows: list[list[list[tuple]]] = [[] for _ in range(size + 1)]
        self._held = 0

    def best_level(self, length: int) -> int:
        """The level whose windows take ``length`` more tokens at the least sum of squares; 0 is a new window.

        A window that leaves level h for level k changes the sum by
        2 * (number at k - number at h) + 2; one that becomes full or is new
        changes only one of the two. Of equally good levels the highest.
        """
        last = self.size - length
        here, there = self.levels[: last + 1], self.levels[length:]
        change = 2 * (there - here) + 2
        change[0] = 2 * there[0] + 1 if last else 0
        if last:
            change[last] = 1 - 2 * here[last]
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return last - int(change[::-1].argmin())

    def add(self, doc: int, total: int) -> list[list[tuple[int, int, int]]]:
        """Places a document of ``total`` tokens; returns the windows that are now closed, each a list of pieces."""
        closed = [[(doc, at, self.size)] for at in range(0, total - self.size + 1, self.size)]
        rest = total % self.size
        if rest:
            closed += self._put([(doc, total - rest, rest)], rest)
        return closed

    def _put(self, pieces: list[tuple], length: int) -> list[list[tuple]]:
        level = self.best_level(length)
        window = self._windows[level].pop() if level else []
        window += pieces
        if level:
            self.levels[level] -= 1
            self._held -= 1
        if level + length == self.size:
            return [window]
        self._windows[level + length].append(window)
        self.levels[level + length] += 1
        self._held += 1
        if self._held <= self.open_windows:
            return []
        taken: list[list[tuple]] = []
        for common in np.argsort(-self.levels, kind="stable").tolist():
            if len(taken) > max(1, self.open_windows // 2):
                break
            taken += self._taken(common)
        closed, left = self._cut(taken)
        if left:
            closed += self._put(left, sum(n for *_, n in left))
        return closed

    def _taken(self, level: int) -> list[list[tuple]]:
        windows = self._windows[level]
        self._windows[level] = []
        self.levels[level] = 0
        self._held -= len(windows)
        return windows

    def _cut(self, windows: list[list[tuple]]) -> tuple[list[list[tuple]], list[tuple]]:
        """The pieces of ``windows`` in full windows, cut where one ends, and what is left over."""
        full, now, room = [], [], self.size
        for doc, start, length in (piece for window in windows for piece in window):
            while length >= room:
                full.append([*now, (doc, start, room)])
                start, length, now, room = start + room, length - room, [], self.size
            if length:
                now.append((doc, start, length))
                room -= length
        return full, now

    def finish(self) -> list[list[tuple[int, int, int]]]:
        """Closes all open windows: full ones, and lengths that are powers of two."""
        closed, left = self._cut([w for level in range(self.size - 1, 0, -1) for w in self._taken(level)])
        while left:
            whole = 1 << (sum(n for *_, n in left).bit_length() - 1)
            part, room = [], whole
            while room:
                doc, start, length = left[0]
                took = min(room, length)
                part.append((doc, start, took))
                left[0] = (doc, start + took, length - took)
                room -= took
                if took == length:
                    left.pop(0)
            closed.append(part)
        return closed


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", open_windows: int = OPEN_WINDOWS
) -> DataFrame:
    """(id, start, length, doc_tokens, sequence_id, offset bigint, ids binary) of every piece of every document.

    A document is the ids of its whole text and ``end_id``, so a null or empty
    text is one token; strings of special tokens in a text become those tokens,
    as by the library's default. Pieces of a sequence follow one another from
    offset 0 without gaps; start counts the document's ids before the piece;
    ids are the piece's, as little-endian unsigned 32-bit integers. A sequence
    has ``window`` ids, or a power of two at the end of a task. Repeated rows
    and null ids are documents like others. An empty table gives no row. Other
    columns are not read.
    """
    source = columns_of(docs, [id_col, text_col])
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = load(tokenizer_path, special=True)
        packer, sequence = Packer(window, open_windows), TaskContext.get().partitionId() << _TASK_BITS
        # document number to its id, the token ids that are still open, their place in it, and its length
        held: dict[int, list] = {}
        number = 0

        def rows(closed: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for pieces in closed:
                offset = 0
                for doc, start, length in pieces:
                    name, ids, first, total = document = held[doc]
                    out.append((name, start, length, total, sequence, offset, ids[start - first : start - first + length].astype("<u4").tobytes()))
                    offset += length
                    if start + length == total:
                        del held[doc]
                    elif total - start - length < window:  # all that is open stands behind
                        document[1:3] = ids[start + length - first :].copy(), start + length
                sequence += 1
            columns = list(zip(*out)) or [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary())], names=[id_col, *names, "ids"]
            )

        for piece, texts in text_pieces(batches, text_col, PIECE_CHARS):
            closed: list = []
            for doc, ids in zip(piece.column(id_col).to_pylist(), encoder.encode(texts)):
                ids = np.append(np.frombuffer(ids, encoder.dtype), encoder.dtype.type(end_id))
                held[number] = [doc, ids, 0, len(ids)]
                closed += packer.add(number, len(ids))
                number += 1
            yield rows(closed)
        yield rows(packer.finish())

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(source.schema[id_col].dataType)
    fields = [source.schema[id_col], *(T.StructField(n, T.LongType()) for n in names), T.StructField("ids", T.BinaryType())]
    return written(source.mapInArrow(run, T.StructType(fields)), "packed")
