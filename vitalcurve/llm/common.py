"""What the operators share: written tables, connected components, batches of texts and files of bytes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a task works on at a time; a longer text is a piece of its own.
PIECE_CHARS = 1_000_000


def visible_to_tasks(spark: SparkSession) -> None:
    """Puts the folder that holds this library on the path of the Python workers, for sessions that were started without it.

    A cluster whose machines have the library installed elsewhere is not affected.
    """
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH")]))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, in a local temporary one.

    The latter only where driver and tasks are one process: executors of a
    cluster would each write to a disk of their own, so there the setting is
    required (``ValueError``).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.mkdtemp(prefix="vitalcurve-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, and read again after a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame, names: list[str]) -> DataFrame:
    """Only these columns; a missing one raises ``ValueError``."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(*(F.col(f"`{n}`") for n in names))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def filtered(docs: DataFrame, judge, results: list[str], keep) -> DataFrame:
    """The rows that ``keep`` holds for once ``judge`` has added ``results``; columns of those names come through unharmed."""
    clash = {c: free_name(docs, f"_own_{c}") for c in docs.columns if c.lower() in results}
    kept = judge(docs.withColumnsRenamed(clash)).where(keep).drop(*results)
    return kept.withColumnsRenamed({new: old for old, new in clash.items()})


def text_pieces(batches: Iterator[pa.RecordBatch], column: str, chars: int = PIECE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about ``chars`` characters of ``column`` each, and those texts (null stays None)."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        at = size = 0
        for i, text in enumerate(texts):
            size += len(text or "") + 1
            if size >= chars:
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the pairs (a, b): one row (node, root) per node of a pair, root its smallest node.

    Alternating large and small stars, as joins and map-side combined minima,
    until the pairs no longer change; a star of any size is only ever joined,
    never gathered. Every round is written by ``checkpoint()``, so lineage stays short.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))

    def settle(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = df.checkpoint()
        mark = df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        return df, tuple(mark)

    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs, mark = settle(pairs)
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .unionByName(low.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        before = mark
        pairs, mark = settle(small)
        if mark == before:
            break
    roots = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, made if absent; for any scheme that pyarrow knows (file, hdfs, s3, gs)."""
    system, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else Path(uri).absolute().as_uri())
    system.create_dir(path, recursive=True)
    return system, path


def attempt_name(kind: str) -> str:
    """A file name that no other attempt of any task uses: a lost or repeated attempt leaves a file that no index names."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
