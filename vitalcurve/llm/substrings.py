"""Substring deduplication by sliding spans of pieces: every run of consecutive pieces that occurs again goes.

A text is cut behind every sentence, and wherever ``WINDOW`` words hold no such
end, behind the word of the least hash among them. So any run of ``WINDOW``
words has a cut that these words alone decide, and whatever stands around a
passage of 50 words, it holds a whole span. A span starts at every piece and
takes as few as hold ``min_words`` words, two at least. Spans are joined
globally by a 128-bit hash: two polynomials in the words' hashes, which prefix
sums give for all spans of a text at once. The spans are made once and pass one
shuffle; of a span that many documents of a task hold, one row or so meets the
other tasks' rows. The first occurrence (smallest document id, then place)
stays; pieces that any other occurrence covers are cut out of their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, free_name, text_pieces

#: Words that a span holds at least, so that lines of fewer words, which many documents share, stay; and the pieces it takes at least.
MIN_WORDS = 24
MIN_SENTENCES = 2
#: So many words in a row have a cut among them: 3 * WINDOW, and 2 * WINDOW + MIN_WORDS, are less than 50.
WINDOW = 12
#: Words of more characters, if any is beyond ASCII, are text without blanks: each letter counts as a word, half a one for ``min_words``.
LONG_WORD = 24
_RUN_BITS = 31
_RUN_MASK = (1 << _RUN_BITS) - 1
#: Hashes of words, and of spans, that a worker remembers before it starts afresh.
_REMEMBERED = 1_000_000
_WORDS = re.compile(r"[^\t-\r ]+[\t-\r ]*|[\t-\r ]+")


class _Hashes(dict):
    """Word as it stands, with the blanks after it, to the 64-bit hash of it without them and without ASCII case.

    The lowest bit is not the hash's: it tells that the word ends a sentence.
    """

    def __missing__(self, word: str) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        bare = word.rstrip("\t\n\v\f\r ")
        if not bare:
            return 0
        ends = "\n" in word or bare.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", "。", "！", "？")
        found = self[word] = xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass").lower()) & ~1 | ends
        return found


_HASHES = _Hashes()
_END = np.uint64(1)


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as many as were needed so far."""

    def __init__(self, base: int):
        self._bases = base, pow(base, -1, 1 << 64)
        self._kept = np.zeros((2, 0), np.uint64)

    def get(self, count: int) -> np.ndarray:
        if self._kept.shape[1] < count:
            size = 1 << max(16, (count - 1).bit_length())
            self._kept = np.array([np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in self._bases])
        return self._kept


_POWERS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _words(text: str) -> tuple[list[str], np.ndarray]:
    """Words with the blanks after them, and twice what each counts for ``min_words``; joined they are the text."""
    words = _WORDS.findall(text)
    counts = np.full(len(words), 2, np.int64)
    if words and words[0].isspace():
        counts[0] = 0
    if not text.isascii() and max(map(len, words), default=0) > LONG_WORD:
        parts = [list(w.rstrip()) if len(w) > LONG_WORD and not w.isascii() else None for w in words]
        for w, p in zip(words, parts):
            if p:
                p[-1] += w[len(w.rstrip()) :]
        counts = np.concatenate([np.ones(len(p), np.int64) if p else counts[i : i + 1] for i, p in enumerate(parts)])
        words = [x for w, p in zip(words, parts) for x in (p or [w])]
    return words, counts


def _cuts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of words before each cut, ascending, in texts that begin at ``starts`` (one more for the end); each text ends with one."""
    count = len(hashes)
    cut = np.zeros(count + 1, bool)
    sentence = (hashes & _END).astype(bool)
    cut[1:] = sentence
    if count >= WINDOW:
        ranks = np.where(sentence, 0, (hashes >> np.uint64(34)).astype(np.int64) + 1)
        least, reach = ranks << _RUN_BITS | np.arange(count), 1
        while reach < WINDOW:
            step = min(reach, WINDOW - reach)
            least, reach = np.minimum(least[:-step], least[step:]), reach + step
        inside = np.ones(count, bool)  # whether the window from a word on stays in its text
        for back in range(1, WINDOW):
            inside[np.maximum(starts[1:] - back, 0)] = False
        cut[(least[inside[: len(least)]] & _RUN_MASK) + 1] = True
    cut[starts[1:]] = True
    cut[0] = False
    return np.flatnonzero(cut)


def sentences_of(text: str) -> list[str]:
    """The text in pieces with the blanks after them; joined they are the text."""
    if not text:
        return []
    words, _ = _words(text)
    cuts = _cuts(_hashes(words), np.array([0, len(words)])).tolist()
    return ["".join(words[a:b]) for a, b in zip([0, *cuts], cuts)]


def _span_table(texts: list[str | None], min_words: int, min_sentences: int) -> tuple[np.ndarray, ...]:
    """Text, first piece, pieces and both hashes of every span, in the order of the texts."""
    words: list[str] = []
    parts, sizes = [], []
    for text in texts:
        own, counts = _words(text) if text else ([], np.zeros(0, np.int64))
        words += own
        parts.append(counts)
        sizes.append(len(own))
    starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    counts, hashes = np.concatenate([np.zeros(0, np.int64), *parts]), _hashes(words)
    cuts = _cuts(hashes, starts)
    begins = np.concatenate(([0], cuts))[: len(cuts)]
    total = np.concatenate(([0], np.cumsum(counts)))
    owner = np.searchsorted(starts, begins, "right") - 1  # the text of each piece
    head, tail = np.searchsorted(owner, np.arange(len(sizes)), "left"), np.searchsorted(owner, np.arange(len(sizes)), "right")
    filled = np.flatnonzero(total[cuts] > total[begins])  # pieces of blanks alone neither start a span nor count as one
    # after how many pieces there are enough words, and enough pieces with words
    enough = np.searchsorted(total[cuts], total[begins[filled]] + 2 * min_words, "left") + 1
    pair = np.full(len(filled), len(cuts) + 1)
    pair[: max(0, len(filled) - min_sentences + 1)] = filled[min_sentences - 1 :] + 1
    lasts = np.maximum(enough, pair)
    kept = lasts <= tail[owner[filled]]
    firsts, lasts = filled[kept], lasts[kept]
    # a text too short for a span of its own is one, if it holds enough words
    whole = np.flatnonzero(total[starts[1:]] - total[starts[:-1]] >= 2 * min_words)
    whole = np.setdiff1d(whole, owner[firsts])
    firsts, lasts = np.concatenate((firsts, head[whole])), np.concatenate((lasts, tail[whole]))
    order = np.argsort(firsts, kind="stable")
    firsts, lasts = firsts[order], lasts[order]
    text = owner[firsts]
    # blanks before the first word are a word of hash 0: they add nothing, and the place after them is the first
    at, to = begins[firsts], cuts[lasts - 1] if len(cuts) else firsts
    at = at + ((at == starts[text]) & (counts[at] == 0)) if len(at) else at
    both = []
    for powers, values in zip(_POWERS, (hashes & ~_END, _scrambled(hashes & ~_END))):
        up, down = powers.get(len(words) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(words)], dtype=np.uint64)))
        both.append(_scrambled((sums[to] - sums[at]) * down[at]))
    return text, firsts - head[text], lasts - firsts, *both


def spans_of(text: str, min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> list[tuple[int, int, bytes]]:
    """(first piece, pieces, 16-byte hash) of every span; case (A-Z) and blanks do not count.

    A text that is too short for a span of its own has one span if it holds ``min_words`` words, else none.
    """
    _, first, count, one, two = _span_table([text], min_words, min_sentences)
    digests = np.stack([one, two], 1).tobytes()
    return [(a, n, digests[16 * i : 16 * i + 16]) for i, (a, n) in enumerate(zip(first.tolist(), count.tolist()))]


class _Firsts(dict):
    """Hash of a span to the smallest id that the task has met it with; of hashes that a slice of texts holds more than once."""

    def settled(self, hashes: list[tuple[int, int]], ids: list) -> np.ndarray:
        """Whether each hash was met with a smaller id than the one now given; the others are remembered with it."""
        if len(self) > _REMEMBERED:
            self.clear()
        out = np.zeros(len(hashes), bool)
        for i, (span, own) in enumerate(zip(hashes, ids)):
            met = self.get(span)
            if met is not None and (own is None or met < own):
                out[i] = True
            elif own is not None:
                self[span] = own
        return out


def _decided(rows: np.ndarray, ranks: np.ndarray, one: np.ndarray, two: np.ndarray, ids: list, firsts: _Firsts) -> np.ndarray:
    """Which spans are known not to be the first with their hash: further down in their text, or after a smaller id that the task has met.

    ``ranks`` are those of the ids of the texts, equal for equal ids; the first
    row of each id and hash is left open, as other tasks may hold a smaller id.
    """
    rank = ranks[rows]
    order = np.lexsort((rows, rank, two, one))  # stable: equal spans of a text keep their order
    same = np.zeros(len(order), bool)
    same[1:] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    again = same.copy()
    again[1:] &= rows[order[1:]] == rows[order[:-1]]
    group = np.cumsum(~same) - 1
    heads = order[~same]
    many = np.flatnonzero(np.bincount(group, minlength=len(heads)) > 1)
    hot = heads[many]
    settled = np.zeros(len(heads), bool)
    settled[many] = firsts.settled(list(zip(one[hot].tolist(), two[hot].tolist())), [ids[r] for r in rows[hot].tolist()])
    known = np.zeros(len(order), bool)
    known[order] = again | (rank[order] > rank[heads][group]) | settled[group]
    return known


def sentence_spans(docs: DataFrame, id_col: str, text_col: str, min_words: int, min_sentences: int) -> DataFrame:
    """(_id, _key, place, h1, h2) of every span.

    _key tells rows with one id apart; place packs the first piece (from bit
    31 up) and their number. It is negative where the task itself knows that
    the span is not the first; its hash is then a number of its own, so that
    a span which every document holds is spread over the shuffle, and only
    one row or so of each task meets the others with that hash.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.hash(text_col).alias("_key"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts()
        for piece, texts in text_pieces(batches, "_text"):
            owners = piece.column("_id")
            ids = owners.to_pylist()
            once: dict = {}  # equal rows have the same spans and share their verdict
            texts = [t if once.setdefault((own, t), i) == i else None for i, (own, t) in enumerate(zip(ids, texts))]
            rows, first, count, one, two = _span_table(texts, min_words, min_sentences)
            place = first << _RUN_BITS | count
            ranks = pc.rank(owners, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False)
            known = _decided(rows, ranks, one, two, ids, firsts)
            place[known] = -place[known]
            one = np.where(known, _scrambled(one + np.arange(1, len(one) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), one)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [owners.take(at), piece.column("_key").take(at), pa.array(place), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                names=["_id", "_key", "place", "h1", "h2"],
            )

    fields = [T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_key", T.IntegerType())]
    return source.mapInArrow(run, T.StructType(fields + [T.StructField(n, T.LongType()) for n in ("place", "h1", "h2")]))


def repeated_spans(spans: DataFrame) -> DataFrame:
    """(_id, _key, place) of the spans that are not the first with their hash.

    First is the smallest document id, and the top of that document. The spans
    pass one shuffle, sorted by hash and read in that order. What a task knew
    to be a repeat comes through it under a hash of its own.
    """
    least = F.min(F.when(F.col("place") > 0, F.col("_id"))).over(Window.partitionBy("h1", "h2"))
    again = spans.withColumn("_least", least).where("place < 0 OR _id > _least OR (_id IS NULL AND _least IS NOT NULL)")
    return again.select("_id", "_key", F.abs("place").alias("place"))


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES
) -> DataFrame:
    """``docs`` with the pieces of all non-first repeated spans cut out of their texts; all rows and columns stay.

    Whole texts are read and what stays of a text is unchanged. Rows with one
    id are one document, whose repeats are cut only where the same row holds
    them twice; rows without an id come after all others. Null texts stay null,
    empty ones empty; a text can become empty. n_chars, where there is such a
    column, is the new length.
    """
    columns_of(docs, [id_col, text_col])
    spans = sentence_spans(docs, id_col, text_col, min_words, min_sentences)
    covered = repeated_spans(spans).groupBy("_id", "_key").agg(F.collect_set("place").alias("_spans"))
    id_name, key, cut = (free_name(docs, n) for n in ("_cut_id", "_cut_key", "_cut"))
    covered = covered.select(F.col("_id").alias(id_name), F.col("_key").alias(key), F.col("_spans").alias(cut))
    marked = docs.join(covered, F.col(f"`{id_col}`").eqNullSafe(F.col(id_name)) & (F.hash(text_col) == F.col(key)), "left").drop(id_name, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_pieces(batches, text_col):
            for i, spans_ in enumerate(piece.column(cut).to_pylist()):
                if spans_:
                    gone = {k for p in spans_ for k in range(p >> _RUN_BITS, (p >> _RUN_BITS) + (p & _RUN_MASK))}
                    texts[i] = "".join(s for k, s in enumerate(sentences_of(texts[i])) if k not in gone)
            new = [pa.array(texts, pa.string()) if n == text_col else c for n, c in zip(piece.schema.names, piece.columns) if n != cut]
            yield pa.RecordBatch.from_arrays(new, names=[n for n in piece.schema.names if n != cut])

    out = marked.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
