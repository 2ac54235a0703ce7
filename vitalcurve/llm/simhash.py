"""Near duplicates by SimHash: fingerprints within a small Hamming radius, found by meeting in the middle.

Every distinct fingerprint is sent to all variants within half the radius. Two
fingerprints within the radius share at least one variant, so equality of
variants finds every pair. Fingerprints are deduplicated before, so a group of
copies of any size is one row, and at most as many rows as a ball has points
meet in one variant, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import columns_of, components, text_pieces, written

#: Bits of a fingerprint.
BITS = 64
_SEED = 42


def _shingles(text: str | None, words: int) -> list[bytes]:
    # bytes.lower() touches A-Z only, bytes.split() parts at exactly 0x20 and 0x09-0x0D
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    if words == 3:
        return [b" ".join(x) for x in zip(found, found[1:], found[2:])]
    return [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)]


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    hashes = [xxhash.xxh64_intdigest(s, _SEED) for s in _shingles(text, words)]
    if not hashes:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in parts
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint bigint) of every row; null and blank texts get 0."""
    source = columns_of(docs, [id_col, text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_pieces(batches, text_col):
            prints = pa.array([fingerprint_of(t, words) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(id_col), prints], names=[id_col, "fingerprint"])

    schema = T.StructType([source.schema[id_col], T.StructField("fingerprint", T.LongType())])
    return source.mapInArrow(run, schema)


def ball(radius: int) -> list[int]:
    """Signed 64-bit masks with up to ``radius`` bits set."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def fingerprint_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints within ``radius`` bits that connect all fingerprints so related.

    ``radius`` is even. All fingerprints of a variant lie within the radius of
    one another, so pairs with the smallest of them connect them all; the
    pairs are verified and listed once.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: half of it is the reach of a variant")
    variants = prints.select("fingerprint").distinct().select(
        "fingerprint", F.explode(F.array(*map(F.lit, ball(radius // 2)))).alias("mask")
    ).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"))
    least = F.min("fingerprint").over(Window.partitionBy("variant"))
    return (
        variants.select(least.alias("a"), F.col("fingerprint").alias("b"))
        .where("a < b AND bit_count(a ^ b) <= {}".format(radius))
        .distinct()
    )


def simhash_groups(
    docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row of ``docs``.

    Rows are linked if their fingerprints differ in ``radius`` bits or fewer;
    component_id is the smallest id that links lead to. Texts without words
    share fingerprint zero and are linked like any others. Fewer words than a
    shingle make one shingle. Repeated rows stay repeated. A null id never
    becomes a component_id unless all ids of the component are null. Other
    columns, whatever their names, are not read.
    """
    prints = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    roots = components(fingerprint_links(prints, radius))
    known = prints.groupBy("fingerprint").agg(F.min(id_col).alias("_first"))
    placed = known.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "_first", F.coalesce("root", "fingerprint").alias("_root")
    )
    ids = placed.groupBy("_root").agg(F.min("_first").alias("component_id"))
    classes = placed.join(ids, "_root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select(
        id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_dedup(
    docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns as they were.

    Rows without an id cannot be compared and stay. Rows that share an id are
    one document: all of them stay or none.
    """
    kept = simhash_groups(docs, words, radius, id_col, text_col).where(f"`{id_col}` = component_id")
    keep = kept.select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(keep, docs[id_col] == keep["_kept_id"], "left_semi").unionByName(docs.where(docs[id_col].isNull()))
