"""Periodic runs of words by string synchronising sets.

For a scale t (a power of two) the set S holds the positions i whose fragments
of t words, at i..i+t, have their least hash at i or at i+t. Whether i is in S
depends on the 2t words from i on alone, so inside a run of period q the set
repeats every q words; and every t positions in a row hold one of S, unless
the words there have a period of t/3 or less. For each run with t <= q < 2t and
four periods or more, two consecutive members of S with equal contexts of 2t
words lie exactly q apart; such pairs propose their distance as a period.

Positions whose fragment of t words has a period of t/3 or less are left out
of S, or it would be dense there. They are detected apart, by the nearest
repeat of the fragment's first half, and their regions propose the small
periods that S omits. Periods below the first scale are read off by comparing
neighbours. Every proposal is checked and extended word by word.

All documents of a slice of the table are one array of word numbers, with
numbers that occur nowhere else between them, so the steps are a few numpy
passes a scale; documents without a repeated context leave before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import columns_of, text_pieces

#: A run has so many words at least, and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Periods below this are found by comparing neighbours; the first scale, a power of two.
_FIRST_SCALE = 4
#: Up to so many distances are compared one by one, more by sorting.
_COMPARED = 16
#: Words compared at a time when a run is extended.
_STEP = 64
_NONE = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the fragments of 2 * size words, from those of size; past the end each gets one of its own."""
    out = np.arange(len(hashes), dtype=np.uint64) + np.uint64(1 << 62)
    if size < len(hashes):
        out[:-size] = hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:]
    return _mixed(out)


def _nearest_repeat(hashes: np.ndarray, limit: int) -> np.ndarray:
    """How far behind each position its hash next occurs, 0 where that is further than ``limit``."""
    near = np.zeros(len(hashes), np.int64)
    if limit <= _COMPARED:
        for d in range(min(limit, len(hashes) - 1), 0, -1):
            near[:-d][hashes[d:] == hashes[:-d]] = d
        return near
    order = np.argsort(hashes, kind="stable")
    apart = np.diff(order)
    hit = (hashes[order[1:]] == hashes[order[:-1]]) & (apart <= limit)
    near[order[:-1][hit]] = apart[hit]
    return near


def _least_ahead(values: np.ndarray, size: int) -> np.ndarray:
    """The least of the size + 1 values from each position on (size a power of two), for all but the last ``size`` positions."""
    least, reach = values, 1
    while reach < size:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    return np.minimum(least[:-1], least[1:])


def _streaks(places: np.ndarray, kinds: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place, and kind, of the groups of places (sorted by kind, then place) of one kind no more than ``gap`` apart."""
    if not len(places):
        return places, places, kinds
    new = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(places) > gap)) + 1
    firsts, lasts = np.concatenate(([0], new)), np.concatenate((new, [len(places)])) - 1
    return places[firsts], places[lasts], kinds[firsts]


def _agreeing(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words in a row, from ``at`` on in the direction of ``step`` (1 or -1), equal the one ``period`` before."""
    count, reach = 0, _STEP
    while True:
        if step > 0:
            low, high = at + count, min(at + count + reach, len(words))
            same = words[low:high] == words[low - period : high - period]
        else:
            low, high = max(at - count - reach + 1, period), at - count + 1
            same = (words[low:high] == words[low - period : high - period])[::-1]
        if not len(same):
            return count
        stop = int(same.argmin())
        if not same[stop]:
            return count + stop
        count, reach = count + len(same), 2 * reach


def find_runs(words: np.ndarray, begins: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs in the concatenated documents, sorted by start, then period.

    words: a number for each word, equal only for equal words of one document,
    and behind each document a number of its own. begins: where the documents
    begin, and one more for the end. A run is a stretch, as long as can be, of
    ``least_periods`` (4 at least) periods and ``least_words`` words or more.
    """
    if least_periods < 4:
        raise ValueError("runs of fewer than four periods can lie between the positions compared")
    found: set[tuple[int, int, int]] = set()
    for q in range(1, _FIRST_SCALE):
        need = max(least_words, least_periods * q) - q
        same = np.concatenate(([False], words[q:] == words[:-q], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            # a period that is no multiple of a smaller one
            if e - s >= need and not any(q % p == 0 and words[s] == words[s + p] and (words[s : s + q - p] == words[s + p : s + q]).all() for p in range(1, q)):
                found.add((s, e + q, q))

    lengths = np.diff(begins)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words))
    half, whole = _doubled(_mixed(words.astype(np.uint64)), 1), None
    scale = _FIRST_SCALE
    whole = _doubled(half, scale // 2)
    kept = words
    while True:
        stays = lengths > least_periods * scale  # the separator counts too
        mask = stays[owner]
        owner, place, half, whole, kept = owner[mask], place[mask], half[mask], whole[mask], kept[mask]
        if len(kept) <= 2 * scale:
            break
        # fragments of a period of a third of the scale or less: that of the nearest repeat of their first half
        middle, near = scale // 2, _nearest_repeat(half, scale // 3)
        small = np.flatnonzero(near[: len(kept) - scale])
        small = small[half[small + middle - near[small]] == half[small + middle]]
        order = np.lexsort((small, near[small]))
        proposed = [(a, b + scale, d) for a, b, d in zip(*(x.tolist() for x in _streaks(small[order], near[small][order], 1)))]
        # the synchronising set
        hashes = _mixed(whole ^ np.uint64(0xD6E8FEB86659FD93))
        hashes[small] = _NONE
        least = _least_ahead(hashes, scale)
        members = np.flatnonzero((least != _NONE) & ((least == hashes[:-scale]) | (least == hashes[scale:])))
        context = _doubled(whole, scale)
        order = np.argsort(context[members], kind="stable")
        sorted_, values = members[order], context[members[order]]
        pairs = np.flatnonzero(values[1:] == values[:-1])
        apart = sorted_[pairs + 1] - sorted_[pairs]
        alive = np.unique(owner[np.concatenate((sorted_[pairs], small))])
        fits = (apart >= scale) & (apart < 2 * scale)
        firsts, periods = sorted_[pairs][fits], apart[fits]
        order = np.lexsort((firsts, periods))
        proposed += [(a, b + d + 2 * scale, d) for a, b, d in zip(*(x.tolist() for x in _streaks(firsts[order], periods[order], 2 * scale)))]
        for s, e, d in proposed:
            if not (kept[s + d : e] == kept[s : e - d]).all():
                continue  # equal hashes of different words
            e += _agreeing(kept, e, d, 1)
            s -= _agreeing(kept, s + d - 1, d, -1)
            if e - s >= max(least_words, least_periods * d):
                found.add((int(place[s]), int(place[s]) + e - s, d))
        stays = np.zeros(len(lengths), bool)
        stays[alive] = True
        mask = stays[owner]
        owner, place, kept, half, whole = owner[mask], place[mask], kept[mask], whole[mask], context[mask]
        scale *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, one behind each document included, and where the documents begin."""
    numbers: list[int] = []
    begins, base = [0], 0
    for words in texts:
        own: dict[bytes, int] = {}
        numbers += [own.setdefault(w, base + len(own)) for w in words]
        base += len(own) + 1
        numbers.append(base - 1)
        begins.append(len(numbers))
    return np.array(numbers, np.int64), np.array(begins, np.int64)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Of runs (start, length, period) the one with the most periods, exactly; then the least start, then the least period."""
    best = None
    for run in runs:
        if best is None or (more := run[1] * best[2] - best[1] * run[2]) > 0 or (more == 0 and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    starts, lengths, periods = np.array(runs, np.int64).T
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> DataFrame:
    """(id, runs array of (start, length, period), start, length, period bigint, collapsed) of every row of ``docs``.

    Words are what stands between blanks, tabs and line ends; start counts
    words from 0. runs: all maximal stretches with ``least_periods`` repeats of
    their smallest period and ``least_words`` words, by start, then period.
    start, length, period: those of the run with the most periods (ties: the
    least start, then period), null without a run. collapsed: the words that no
    run holds behind its first period, joined by one blank. Null and blank texts
    have no words: no run, collapsed ''. Whole texts are read, each in one
    task; repeated rows and null ids stay. Other columns are not read.
    """
    source = columns_of(docs, [id_col, text_col])
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_pieces(batches, text_col):
            split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
            words, begins = _numbered(split)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
            found = find_runs(words, begins, least_words, least_periods)
            for (s, e, q), doc in zip(found, np.searchsorted(begins, [r[0] for r in found], "right") - 1):
                runs[doc].append((s - int(begins[doc]), e - s, q))
            best = [strongest(r) for r in runs]
            short = [collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(split, runs)]
            listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], run_type)
            parts = [pa.array([b and b[i] for b in best], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([piece.column(id_col), listed, *parts, pa.array(short, pa.string())], names=[id_col, "runs", "start", "length", "period", "collapsed"])

    rest = T.StructType.fromDDL("runs array<struct<start: bigint, length: bigint, period: bigint>>, start bigint, length bigint, period bigint, collapsed string")
    return source.mapInArrow(search, T.StructType([source.schema[id_col], *rest.fields]))
