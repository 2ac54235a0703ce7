"""Token ids of documents in shard files: frequency-ranked, one to four bytes each, with the lengths in separate control bytes.

A folder holds ``ids-by-rank`` (unsigned 32-bit ids, the most frequent first)
and shards. A shard is a run of blocks, each of whole documents:

    uint32 documents, uint32 ids, uint32 data bytes, uint32 crc32 of what follows
    uint64 document lengths in ids, one each
    control bytes: two bits an id (bytes of its rank less one), four ids a byte, the first lowest
    data bytes: the ranks, little-endian, without their leading zero bytes

Which blocks count, and in what order, is in the index table: a task that was
lost leaves a file that no index row names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import attempt_name, columns_of, open_folder, shared_dir, text_pieces, written

#: Ids in a block, about; a document is never split.
BLOCK_IDS = 1_000_000
#: Characters encoded at a time: the more, the fewer chunks are looked up twice.
PIECE_CHARS = 4_000_000
#: Bytes of shards that a task reads back, about.
TASK_BYTES = 16 << 20
#: Distinct chunks of text that a worker remembers (some 200 bytes each) before it starts afresh.
REMEMBERED = 1_000_000
#: Line ends and tabs to blanks.
_BLANKS = bytes.maketrans(b"\t\n\r", b"   ")
#: ASCII signs between a letter (a-z or Latin-1) or digit and a blank: one token of their own kind. No apostrophe: it can begin others.
_SIGN = rb"[!-&(-/:-@\[-`{-~]"
_SIGNS = re.compile(_SIGN + rb"(?:(?<=[0-9a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))" + _SIGN + rb"*(?= |$)")
#: A word of lower-case letters a-z and Latin-1, which the steps before the merges leave as it is.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
# The characters that byte-level vocabularies write for bytes of such words that do not stand for themselves.
_BYTE_CHARACTERS = {0x9F: 0x141, 0xA0: 0x142, 0xAD: 0x143}
_DICTIONARY = "ids-by-rank"
#: Lengths of the four ids of a control byte.
_LENGTHS = np.array([[(byte >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for byte in range(256)], np.uint8)


class _Chunks(dict):
    """Chunk to ids (little-endian); a chunk that is not there yet is encoded when it is looked up."""

    def __init__(self, tokenizer, code: str):
        self.tokenizer, self.merge, self.code = tokenizer, tokenizer.model.tokenize, code

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            ids = [t.id for t in self.merge(chunk.decode())]
        elif _PLAIN.fullmatch(chunk):
            ids = [t.id for t in self.merge(chunk.decode("latin-1").translate(_BYTE_CHARACTERS))]
        else:
            ids = self.tokenizer.encode(chunk.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
        found = self[chunk] = array(self.code, ids).tobytes()
        return found


class ChunkEncoder:
    """A byte-level tokenizer file whose rules split at every blank and line end and between a letter and a sign, and ignore ASCII case.

    Texts are cut at blanks, tabs and line ends, and before signs that end such
    a chunk. Each distinct chunk is encoded by the library once, plain words by
    its merges alone. Only cuts that its own splitting makes too are made, so
    the ids are those of the whole text.

    special: the strings of the file's special tokens, as they are written
    there, become their ids, as the library has it by default; else they are
    ordinary text.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # in a chunk their strings are ordinary text: those that count are taken out before, with their case
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._known = _Chunks(self.tokenizer, self.dtype.char)
        named = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if special and t.special}
        self._special = {t: np.array([i], self.dtype).tobytes() for t, i in named.items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(named, key=len, reverse=True))) + ")") if named else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian integers of ``dtype``."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        return [self._ids(t) if t else b"" for t in texts]

    def _ids(self, text: str) -> bytes:
        if self._split and self._split.search(text):
            return b"".join(self._special.get(part) or b"".join(map(self._known.__getitem__, _chunks(part))) for part in self._split.split(text))
        return b"".join(map(self._known.__getitem__, _chunks(text)))


def _chunks(text: str) -> list[bytes]:
    lower = text.encode("utf-8", "surrogatepass").lower().translate(_BLANKS)
    return _SIGNS.sub(b" \\g<0>", lower).split(b" ")


@lru_cache(maxsize=2)
def load(path: str, special: bool = False) -> ChunkEncoder:
    return ChunkEncoder(path, special)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, width int): every whole text's ids and ``end_id``, as little-endian integers of ``width`` bytes.

    Strings of special tokens in a text become those tokens, as by the library's default settings.
    """
    source = columns_of(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer_path, special=True)
        end = np.array([end_id], encoder.dtype).tobytes()
        for piece, texts in text_pieces(batches, text_col, PIECE_CHARS):
            ids = pa.array([x + end for x in encoder.encode(texts)], pa.binary())
            width = pa.array(list(repeat(encoder.dtype.itemsize, len(texts))), pa.int32())
            yield pa.RecordBatch.from_arrays([piece.column(id_col), ids, width], names=[id_col, "ids", "width"])

    fields = [source.schema[id_col], T.StructField("ids", T.BinaryType()), T.StructField("width", T.IntegerType())]
    return source.mapInArrow(run, T.StructType(fields))


def _frequencies(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids, width in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist()):
                new = np.bincount(np.frombuffer(ids, f"<u{width}"))
                if len(new) > len(total):
                    total = np.concatenate([total, np.zeros(len(new) - len(total), np.int64)])
                total[: len(new)] += new
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = encoded.select("ids", "width").mapInArrow(run, "id bigint, n bigint")
    return counts.groupBy("id").agg(F.sum("n").alias("n"))


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of these ranks."""
    ranks = ranks.astype("<u4")
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    four = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    four[: len(codes)] = codes
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` ranks of ``pack``: lengths by table lookup, then all bytes of one place at a time."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    source = np.frombuffer(data, np.uint8)
    ranks = source[starts].astype(np.uint32) if count else np.zeros(0, np.uint32)
    for place in (1, 2, 3):
        longer = np.flatnonzero(lengths > place)
        ranks[longer] |= source[starts[longer] + place].astype(np.uint32) << np.uint32(8 * place)
    return ranks


def _block(documents: list[np.ndarray]) -> bytes:
    lengths = np.array([len(d) for d in documents], "<u8")
    control, data = pack(np.concatenate(documents))
    body = lengths.tobytes() + control + data
    return np.array([len(documents), lengths.sum(), len(data), zlib.crc32(body)], "<u4").tobytes() + body


def _documents(block: bytes, by_rank: np.ndarray) -> list[np.ndarray]:
    """The ids of each document of a block; a damaged block raises ``ValueError``."""
    count, ids, size, check = np.frombuffer(block, "<u4", 4)
    if zlib.crc32(block[16:]) != check:
        raise ValueError("block is damaged")
    lengths = np.frombuffer(block, "<u8", count, 16).astype(np.int64)
    at = 16 + 8 * int(count)
    found = by_rank[unpack(block[at : len(block) - int(size)], block[len(block) - int(size) :], int(ids))]
    return np.split(found, np.cumsum(lengths)[:-1])


_INDEX = "shard bigint, block bigint, file string, offset bigint, bytes bigint, ids_before bigint, n_ids bigint, doc_ids array<{}>"


def write_shards(encoded: DataFrame, folder: str, id_col: str = "doc_id", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the documents in ascending id order to ``folder``; returns the index, one row per block.

    Shards follow one another in ``shard`` order; ids_before counts the ids of
    a shard before the block. Null document ids come first; documents with one
    id follow one another in the order of a hash of their ids.
    """
    # as many rows as the tokenizer has ids, whatever the corpus
    counts = _frequencies(encoded).orderBy(F.desc("n"), "id").select("id").collect()
    by_rank = np.array([r["id"] for r in counts], "<u4")
    system, path = open_folder(folder)
    with system.open_output_stream(f"{path}/{_DICTIONARY}") as out:
        out.write(by_rank.tobytes())
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    shared = encoded.sparkSession.sparkContext.broadcast(rank_of)
    kind = encoded.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, path = open_folder(folder)
        shard, name = TaskContext.get().partitionId(), f"{attempt_name('shard')}.ids"
        rows: list[dict] = []
        held: list[np.ndarray] = []
        names: list = []
        offset = before = size = 0

        def flush(out) -> None:
            nonlocal offset, before, size, held, names
            block = _block(held)
            out.write(block)
            rows.append(
                {"shard": shard, "block": len(rows), "file": name, "offset": offset, "bytes": len(block), "ids_before": before, "n_ids": size, "doc_ids": names}
            )
            offset, before, size, held, names = offset + len(block), before + size, 0, [], []

        first = next(batches, None)
        if first is None:
            return
        with system.open_output_stream(f"{path}/{name}") as out:
            while first is not None:
                for doc, ids, width in zip(first.column(id_col).to_pylist(), first.column("ids").to_pylist(), first.column("width").to_pylist()):
                    held.append(shared.value[np.frombuffer(ids, f"<u{width}")])
                    names.append(doc)
                    size += len(held[-1])
                    if size >= block_ids:
                        flush(out)
                first = next(batches, None)
            if held:
                flush(out)
        yield from pa.Table.from_pylist(rows, schema).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = T.StructType.fromDDL(_INDEX.format(kind.simpleString()))
    schema = to_arrow_schema(spark_schema)
    # by a hash of the ids too: rows with one document id spread, and the sampled keys stay short
    order = [id_col, F.xxhash64("ids")]
    ordered = encoded.repartitionByRange(*order).sortWithinPartitions(*order, "ids")
    return written(ordered.mapInArrow(run, spark_schema), "token-index")


def read_shards(index: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids binary as little-endian unsigned 32-bit) of every document of the files that ``index`` names.

    start: ids of all documents before it.
    """
    totals = index.groupBy("shard").agg(F.sum("n_ids").alias("_n"))  # one row a file
    before = F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select(F.col("shard").alias("_shard"), before.alias("_base"))
    blocks = index.join(bases, F.col("shard") == F.col("_shard")).select(
        "file", "offset", "bytes", (F.col("_base") + F.col("ids_before")).alias("start"), F.col("doc_ids").alias("doc_ids")
    )
    kind = index.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        with system.open_input_file(f"{path}/{_DICTIONARY}") as file:
            by_rank = np.frombuffer(file.read(), "<u4")
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                name, offset, size, start = (row.column(c)[0].as_py() for c in ("file", "offset", "bytes", "start"))
                with system.open_input_file(f"{path}/{name}") as file:
                    documents = _documents(file.read_at(size, offset), by_rank)
                lengths = np.array([len(d) for d in documents], np.int64)
                ids = pa.array([d.astype("<u4").tobytes() for d in documents], pa.binary())
                starts = pa.array(start + np.cumsum(lengths) - lengths)
                names = row.column("doc_ids").flatten()
                yield pa.RecordBatch.from_arrays([names, starts, pa.array(lengths), ids], names=[id_col, "start", "n_tokens", "ids"])

    fields = [T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    size = index.agg(F.sum("bytes")).first()[0] or 0  # the index is small; the tasks are sized by what it points to
    return blocks.repartition(max(1, -(-size // TASK_BYTES)), "file", "offset").mapInArrow(run, T.StructType(fields))


def token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Encodes all ``docs`` into shard files (in the shared folder, unless ``folder`` is given) and reads them back.

    Null and empty texts are the end id alone. Repeated rows and null ids are
    documents like others. An empty table gives no shard and no row. Other
    columns are not read.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens"
    encoded = written(encode(docs, tokenizer_path, end_id, id_col, text_col), "encoded")
    return read_shards(write_shards(encoded, folder, id_col, block_ids), folder, id_col)
