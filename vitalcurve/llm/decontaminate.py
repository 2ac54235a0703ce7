"""Benchmark decontamination: an exact set join of item windows with documents, filtered by each window's rarest word.

A window (``window`` consecutive words of an item, or all words of a shorter
one) must occur whole, so one necessary token is enough as its prefix: the
word that the fewest document words equal, counted over the whole corpus. Only
documents' words that equal a prefix word give candidates; position bounds drop
those where the window would stick out of the document; what remains is
compared word by word.

Long items are cut into parts that overlap by a window less a word, and the
parts are dealt to blocks of bounded size. Each block is broadcast and the
documents' texts are scanned once per block. With one block no document is
shuffled; with more, what the others hit is a small table, one row per text
that is hit, which joins the documents before the scan of the first block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import columns_of, filtered, free_name, text_pieces, written

#: Words of items in one broadcast block at most (about 60 bytes a word in a task).
BLOCK_WORDS = 500_000
#: Words of one part of an item at most.
PART_WORDS = 50_000
#: A word counts as one more for every so many bytes, so that blocks of long words are bounded too.
_WORD_BYTES = 16
_LANES = 200_000
#: Characters of texts in one slice; a longer text is a slice of its own.
_PIECE_CHARS = 400_000
#: Bytes hashed at a time: arrays of about fifty bytes a byte.
_PART_BYTES = 1 << 20

# ASCII letters lower-cased and digits; every byte above 0x7F belongs to a word; all else parts words.
_KEEP = np.zeros(256, np.uint8)
_KEEP[48:58] = np.arange(48, 58)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_TRANSLATE = bytes(int(b) or 32 for b in _KEEP)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))))


class _Words:
    """All words of some texts, one after another, as 64-bit hashes.

    ``begins``: which word each text begins with (one more at the end);
    ``starts``: the byte of ``data`` that each word begins at (likewise).
    A text of any length takes 16 bytes a word beside its own bytes, as bytes
    are hashed part by part; a word may go on over any number of parts.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = [len(r) + 1 for r in raw]
        self.data = b"\0".join([*raw, b""])
        sums, starts, going = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for at in range(0, len(self.data), _PART_BYTES):
            own, first, last, size = self._part(at)
            if going and len(first) and first[0] == 0:
                sums[-1][-1:] += own[:1] * np.uint64(pow(int(_BASE), going, 1 << 64))
                going = going + size if last[0] == size else 0
                own, first, last = own[1:], first[1:], last[1:]
            else:
                going = 0
            if len(first):
                sums.append(own)
                starts.append(first + at)
                going = size - int(first[-1]) if last[-1] == size else 0
        self.hashes = self._mixed(np.concatenate(sums))
        self.starts = np.concatenate((*starts, [len(self.data)]))
        self.begins = np.searchsorted(self.starts[:-1], np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))

    def _part(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Of the part at a byte: the polynomial hash, start and end of every word, and the size of the part."""
        bytes_ = _KEEP[np.frombuffer(self.data, np.uint8, min(_PART_BYTES, len(self.data) - at), at)]
        inside = np.concatenate(([False], bytes_ != 0, [False]))
        first = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        last = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        # from prefix sums: sum of byte * base**place, moved to place 0 by the inverse power
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(bytes_ * _powers(int(_BASE), _PART_BYTES)[: len(bytes_)], dtype=np.uint64)))
        return (sums[last] - sums[first]) * _powers(int(_INVERSE), _PART_BYTES)[first], first, last, len(bytes_)

    @staticmethod
    def _mixed(hashes: np.ndarray) -> np.ndarray:
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        return hashes.view(np.int64)

    def between(self, first: int, stop: int) -> list[bytes]:
        """The words first..stop - 1 themselves."""
        return self.data[self.starts[first] : self.starts[stop]].translate(_TRANSLATE).split()


class _Finder:
    """Sorted 64-bit keys with a bit table in front; finds in bulk which values are among them."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self._bits = np.zeros(1 << 22, bool)
        self._bits[self.keys & (len(self._bits) - 1)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``values`` that hold a key, and which key."""
        maybe = np.flatnonzero(self._bits[values & (len(self._bits) - 1)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, values[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == values[maybe]
        return maybe[hit], at[hit]


def _parts(items: DataFrame, window: int, part_words: int) -> DataFrame:
    """(_id, _text, _size): items in parts; each window lies whole in the part that its first word falls to.

    Items without words have no part. _size: words, or more where they are long.
    """
    step = part_words - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_pieces(batches, "_text", _PIECE_CHARS):
            words = _Words(texts)
            rows = []
            for item, begin, end in zip(piece.column("_id").to_pylist(), words.begins.tolist(), words.begins[1:].tolist()):
                for at in range(begin, max(begin + 1, end - window + 1) if end > begin else begin, step):
                    stop = min(at + part_words, end)
                    text = words.data[words.starts[at] : words.starts[stop]].rstrip(b"\0")
                    rows.append((item, text.decode("utf-8", "surrogatepass"), max(stop - at, len(text) // _WORD_BYTES)))
            if rows:
                ids, cut, sizes = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(cut, pa.string()), pa.array(sizes, pa.int64())], names=["_id", "_text", "_size"])

    return items.select("_id", "_text").mapInArrow(run, "_id string, _text string, _size bigint")


def _dealt(parts: DataFrame, block_words: int) -> DataFrame:
    """(_id, _text, _item, _block): every task fills one block after another; a part above the bound has a block of its own."""
    total = parts.agg(F.sum("_size")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            blocks = []
            for size in batch.column("_size").to_pylist():
                if held and held + size > block_words:
                    block, held = block + 1, 0
                held += size
                blocks.append(block)
            columns = [batch.column("_id"), batch.column("_text"), pa.array(blocks, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_text", "_block"])

    tasks = max(1, -(-total // block_words))
    dealt = parts.coalesce(tasks).mapInArrow(run, "_id string, _text string, _block bigint")
    return dealt.withColumn("_item", F.monotonically_increasing_id())


def _item_words(items: DataFrame) -> DataFrame:
    """(_block, _item, _pos, _hash): every word of every part of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_pieces(batches, "_text", _PIECE_CHARS):
            words = _Words(texts)
            counts = np.diff(words.begins)
            block, item = (np.repeat(piece.column(c).to_numpy(), counts) for c in ("_block", "_item"))
            pos = np.arange(len(words.hashes)) - np.repeat(words.begins[:-1], counts)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block, item, pos, words.hashes)], names=["_block", "_item", "_pos", "_hash"])

    return items.select("_block", "_item", "_text").mapInArrow(run, "_block bigint, _item bigint, _pos bigint, _hash bigint")


def _word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(_hash, _n): how many words of all documents equal each word; counted in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_pieces(batches, text_col, _PIECE_CHARS):
            keys, counts = np.unique(_Words(texts).hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["_hash", "_n"])

    return docs.select(text_col).mapInArrow(run, "_hash bigint, _n bigint")


def _prefixes(words: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(_block, _item, _at, _first, _last): the windows that start at words _first.._last have their rarest word at _at.

    Ties go to the smaller hash, then to the later place.
    """
    by_item = Window.partitionBy("_block", "_item")
    rank = F.struct(F.coalesce("_n", F.lit(0)), "_hash", -F.col("_pos")).alias("_rank")
    ranked = words.join(counts, "_hash", "left").select("_block", "_item", "_pos", rank)
    ahead = by_item.orderBy("_pos").rowsBetween(0, window - 1)
    starts = ranked.select(
        "_block", "_item", "_pos", F.min("_rank").over(ahead).alias("_least"), F.count("*").over(by_item).alias("_len")
    ).where(f"_pos = 0 OR _pos + {window} <= _len")
    at = (-F.col("_least.col3")).alias("_at")
    return starts.groupBy("_block", "_item", at).agg(F.min("_pos").alias("_first"), F.max("_pos").alias("_last"))


class _Block:
    """Items of one block with their prefix words, ready to be looked up."""

    def __init__(self, ids: list[str], texts: list[str], prefixes: np.ndarray, window: int):
        self.ids, self.window = ids, window
        self.words = _Words(texts)
        self.hashes, self.begins = self.words.hashes, self.words.begins
        self.lengths = np.diff(self.begins)
        item, at = prefixes[:, 0], prefixes[:, 1]
        keys = self.hashes[self.begins[item] + at] if len(prefixes) else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.prefixes, keys = prefixes[order], keys[order]
        self.finder = _Finder(keys)
        self.low, self.high = np.searchsorted(keys, self.finder.keys, "left"), np.searchsorted(keys, self.finder.keys, "right")

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Word counts of the texts; per text the word spans [from, to) that are hit and the ids of their items."""
        words = _Words(texts)
        hashes, begins = words.hashes, words.begins
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        found: dict[int, set[str]] = defaultdict(set)
        places, keys = self.finder.find(hashes)
        counts = self.high[keys] - self.low[keys]
        ends = np.cumsum(counts)
        cuts = [0, *np.searchsorted(ends, np.arange(_LANES, ends[-1], _LANES), "left") + 1, len(places)] if len(places) else []
        for a, b in zip(cuts, cuts[1:]):
            for doc, item, start, stop, item_start in self._verified(hashes, begins, places[a:b], keys[a:b]):
                own, other = begins[doc] + start, self.begins[item] + item_start
                if words.between(own, own + stop - start) == self.words.between(other, other + stop - start):
                    spans[doc].append((start, stop))
                    found[doc].add(self.ids[item])
        return np.diff(begins), spans, found

    def _verified(self, hashes, begins, places, keys) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, from, to, place in the item) of runs of equal words around the candidates that hold a whole window."""
        counts = self.high[keys] - self.low[keys]
        own = np.repeat(places, counts)
        rows = self.prefixes[np.repeat(self.low[keys] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())]
        item, at, first, last = rows.T
        doc = np.searchsorted(begins, own, "right") - 1
        size = np.minimum(self.window, self.lengths[item])
        # position bounds: windows that start before the document or end after it are out
        first = np.maximum(first, at - (own - begins[doc]))
        last = np.minimum(last, begins[doc + 1] - own + at - size)
        keep = first <= last
        own, item, at, first, last, doc, size = (x[keep] for x in (own, item, at, first, last, doc, size))
        if not len(own):
            return
        left, right = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        base = self.begins[item]
        for side, sign, reach in ((left, -1, at - first), (right, 1, last + size - 1 - at)):
            going = np.arange(len(own))
            for step in range(1, 2 * self.window):
                going = going[reach[going] >= step]
                if not len(going):
                    break
                going = going[hashes[own[going] + sign * step] == self.hashes[base[going] + at[going] + sign * step]]
                side[going] = step
        whole = np.flatnonzero(left + right + 1 >= size)
        start = own - left - begins[doc]
        seen = np.stack([doc, item, start, start + left + right + 1, at - left], 1)[whole]
        yield from map(tuple, np.unique(seen, axis=0).tolist())


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: int = 20,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items and contaminated.

    A word is hit if it lies in an occurrence of a window of an item: n_hit of
    n_words. items: sorted ids (as strings) of the items that occur, each once
    however often it is listed; an id that is null counts as ''. Contaminated:
    some word is hit, and at least one in ``share``. Null and empty texts have
    no words; items without words have no windows; without items nothing is
    hit. Columns of ``docs`` stay, whatever their names; of those that clash
    with a result column, the result wins.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items", "contaminated")
    columns_of(docs, [id_col, text_col])
    # distinct texts; the items that share one go by together
    listed = columns_of(items, [item_id, item_text]).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("_id"), F.col(item_text).alias("_text"))
    parts = written(_parts(listed.distinct(), window, max(2 * window, min(PART_WORDS, block_words))), "parts")
    listed = written(_dealt(parts, block_words), "items")
    words = written(_item_words(listed), "item-words")
    needed = words.select("_hash").distinct()
    counts = _word_counts(docs, text_col).join(needed, "_hash", "left_semi").groupBy("_hash").agg(F.sum("_n").alias("_n"))
    prefixes = written(_prefixes(words, counts, window), "prefixes")

    # one number per block of half a million words
    blocks = sorted(r[0] for r in listed.select("_block").distinct().collect()) or [0]
    hits = []
    for number in blocks[1:]:
        block = _block(listed, prefixes, number, window)
        hits.append(written(_hit_texts(docs, block, text_col), f"hits-{number}"))
        block.unpersist()
    first = _block(listed, prefixes, blocks[0], window)
    return (
        _judged(_with_hits(docs, hits, text_col), docs, first, text_col)
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("contaminated", F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words"))
        .select(*(f"`{c}`" for c in docs.columns), "n_words", "n_hit", "n_items", "items", "contaminated")
    )


def _block(listed: DataFrame, prefixes: DataFrame, number: int, window: int):
    """One bounded block of the index, broadcast."""
    rows = listed.where(F.col("_block") == number).orderBy("_item").collect()
    found = prefixes.where(F.col("_block") == number).select("_item", "_at", "_first", "_last").toArrow()
    table = np.stack([c.to_numpy().astype(np.int64) for c in found.columns], 1)
    table[:, 0] = np.searchsorted(np.array([r["_item"] for r in rows], np.int64), table[:, 0])
    return listed.sparkSession.sparkContext.broadcast(([r["_id"] for r in rows], [r["_text"] for r in rows], table, window))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans that do not touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _ordered(names) -> list[str]:
    return sorted(set(names), key=lambda s: s.encode())


def _hit_texts(docs: DataFrame, block, text_col: str) -> DataFrame:
    """(_digest, _spans, _names): one row per different text that the block hits; from, to, from, to... and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Block(*block.value)
        for piece, texts in text_pieces(batches, "_text", _PIECE_CHARS):
            _, spans, found = index.hits(texts)
            if spans:
                digests = piece.column("_digest").take(pa.array(list(spans)))
                flat = pa.array([[x for span in _merged(own) for x in span] for own in spans.values()], pa.list_(pa.int64()))
                names = pa.array([_ordered(found[i]) for i in spans], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([digests, flat, names], names=["_digest", "_spans", "_names"])

    text = F.col(f"`{text_col}`")
    texts = docs.where(text.isNotNull()).select(F.sha2(text, 256).alias("_digest"), text.alias("_text"))
    hit = texts.mapInArrow(run, "_digest string, _spans array<bigint>, _names array<string>")
    return hit.groupBy("_digest").agg(F.first("_spans").alias("_spans"), F.first("_names").alias("_names"))


def _with_hits(docs: DataFrame, hits: list[DataFrame], text_col: str) -> DataFrame:
    """``docs`` and, last, what the blocks of ``hits`` hit in each text: spans and items, null if nothing.

    One join for all blocks. Spark broadcasts the hits if they are small, else
    a text with very many copies is split by the adaptive skew join.
    """
    empty = [F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<string>")]
    digest, spans, names = (free_name(docs, c) for c in ("_digest", "_spans", "_names"))
    if not hits:
        return docs.withColumns(dict(zip((spans, names), empty)))
    both = reduce(DataFrame.unionByName, hits).groupBy(F.col("_digest").alias(digest))
    held = both.agg(F.flatten(F.collect_list("_spans")).alias(spans), F.flatten(F.collect_list("_names")).alias(names))
    keyed = docs.withColumn(digest, F.sha2(F.col(f"`{text_col}`"), 256))
    return keyed.join(held, digest, "left").select(*(f"`{c}`" for c in docs.columns), spans, names)


def _judged(scanned: DataFrame, docs: DataFrame, block, text_col: str) -> DataFrame:
    """``docs`` with n_words, n_hit and items: hits of the block and those that the last two columns hold."""
    bigint = T.LongType()
    new = [T.StructField("n_words", bigint), T.StructField("n_hit", bigint), T.StructField("items", T.ArrayType(T.StringType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Block(*block.value)
        for piece, texts in text_pieces(batches, text_col, _PIECE_CHARS):
            counts, spans, found = index.hits(texts)
            *own, held, held_names = piece.columns
            for i in np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False)).tolist():
                flat = held[i].as_py()
                spans[i].extend(zip(flat[::2], flat[1::2]))
                found[i].update(held_names[i].as_py())
            hit = np.zeros(len(texts), np.int64)
            names: list[list[str]] = [[] for _ in texts]
            for i, places in spans.items():
                hit[i] = sum(b - a for a, b in _merged(places))
                names[i] = _ordered(found[i])
            added = [pa.array(counts, pa.int64()), pa.array(hit), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*own, *added], names=[*piece.schema.names[:-2], "n_words", "n_hit", "items"])

    return scanned.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were (options: see ``contamination``)."""
    results = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    return filtered(docs, lambda d: contamination(d, items, **options), results, ~F.col("contaminated"))
