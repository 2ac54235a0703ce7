"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample, by clustering in which a list that is
longer than its share costs more to join. Every vector goes to its nearest
centroid's list, and to those of other centroids nearly as near (vectors at a
boundary). A query finds the centroids near it in a graph held in memory and
searches all lists whose distance is within a ratio of the least; where those
hold fewer vectors than are asked for, the next nearest lists too, until they
are enough. Lists are dealt out in blocks of bounded size, so a list may be of
any length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, written

#: Distinct vectors that the centroids are fitted on, and centroids at most: what the driver and a task hold.
SAMPLE_VECTORS = 20_000
MAX_LISTS = 4_096
#: Distinct vectors per list that are aimed at.
LIST_VECTORS = 400
#: Vectors and queries that one task compares at a time.
BLOCK_VECTORS = 4_096
BLOCK_QUERIES = 1_024
#: Components that are multiplied at a time for exact scores.
PRODUCTS = 1 << 21
#: A vector also joins lists whose centroid is at most this many times as far as its nearest, up to REPLICAS lists.
BOUNDARY_RATIO = 1.05
REPLICAS = 4
#: A query searches the lists whose centroid is at most this many times as far as its nearest.
SEARCH_RATIO = 1.3
_EDGES = 16


def balanced_centroids(points: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit points, by rounds in which the size of a list so far is a surcharge on its distance."""
    points = points.astype(np.float32)
    rng = np.random.default_rng(0)
    centroids = points[np.sort(rng.choice(len(points), lists, replace=False))].copy()
    share, surcharge = len(points) / lists, np.zeros(lists, np.float32)
    for _ in range(rounds):
        own = np.empty(len(points), np.int64)
        for at in range(0, len(points), 4_096):
            own[at : at + 4_096] = (points[at : at + 4_096] @ centroids.T - surcharge).argmax(1)
        sizes = np.bincount(own, minlength=lists)
        surcharge += 0.02 * (sizes / share - 1).clip(-1, 2).astype(np.float32)
        order = np.argsort(own, kind="stable")
        begins = np.searchsorted(own[order], np.arange(lists))
        filled = sizes > 0
        sums = np.add.reduceat(points[order], begins[filled], axis=0)
        centroids[filled] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


class CentroidGraph:
    """Centroids, each joined to those nearest to it (both ways); searched from one of them outwards."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        count = len(centroids)
        joined: list[set[int]] = [set() for _ in range(count)]
        for at in range(0, count, 1_024):
            near = np.argsort(-(centroids[at : at + 1_024] @ centroids.T), axis=1, kind="stable")[:, : _EDGES + 1]
            for i, row in enumerate(near.tolist(), at):
                for j in row:
                    if i != j:
                        joined[i].add(j)
                        joined[j].add(i)
        # a chain through all of them keeps the graph in one piece
        for i in range(count - 1):
            joined[i].add(i + 1)
            joined[i + 1].add(i)
        self.edges = [np.array(sorted(x), np.int64) for x in joined]

    def within(self, query: np.ndarray, ratio: float, sizes: np.ndarray, least: int, breadth: int = 32) -> np.ndarray:
        """Centroids at most ``ratio`` times as far from a unit query as the nearest that the search finds.

        sizes: vectors whose nearest centroid each is. Where those found have
        fewer than ``least`` in all, the nearest of all centroids that have.
        """
        distance = {0: float(_distance(self.centroids[:1] @ query)[0])}
        heap, best = [(distance[0], 0)], [-distance[0]]
        nearest = distance[0]
        while heap:
            far, node = heapq.heappop(heap)
            # what is left lies beyond the ratio, and beyond the nearest ``breadth``
            if far > nearest * ratio and len(best) >= breadth and far > -best[0]:
                break
            new = [j for j in self.edges[node].tolist() if j not in distance]
            if not new:
                continue
            for j, d in zip(new, _distance(self.centroids[new] @ query).tolist()):
                distance[j] = d
                nearest = min(nearest, d)
                heapq.heappush(heap, (d, j))
                heapq.heappush(best, -d)
                if len(best) > breadth:
                    heapq.heappop(best)
        found = np.array(sorted(j for j, d in distance.items() if d <= nearest * ratio), np.int64)
        if sizes[found].sum() < least:
            order = np.argsort(_distance(self.centroids @ query), kind="stable")
            found = np.union1d(found, order[: np.searchsorted(np.cumsum(sizes[order]), least) + 1])
        return found


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # no square overflows or vanishes
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_vec_id, _vec) of the vectors that take part.

    Left out: null ids; vectors that are null, empty, zero, or hold null or
    non-finite components; vectors whose length is not the most common one (the
    shorter, of equally common ones).
    """
    vec = F.col("_vec")
    rows = columns_of(vectors, [id_col, vec_col]).select(F.col(id_col).cast("bigint").alias("_vec_id"), F.col(vec_col).cast("array<double>").alias("_vec"))
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = rows.where(F.col("_vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("_vec").alias("_size")).count().orderBy(F.desc("count"), "_size").limit(1).collect()
    return rows.where(F.size("_vec") == (common[0]["_size"] if common else -1))


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", list_vectors: int = LIST_VECTORS, search_ratio: float = SEARCH_RATIO
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row its ``k`` nearest rows of ``vectors``, other than its own.

    queries: rows of ``vectors``, by id. score: cosine in double precision; ties
    go to the smaller id. Equal vectors are one entry of the index with the
    k + 1 smallest of their ids (no query can be nearest to more of them), so a
    vector that a third of all rows share is one row. Rows that share an id
    count once for each vector they hold. Every query gets ``k`` rows, or all
    candidates where there are fewer. Without any usable vector: no row.
    """
    base = usable_vectors(vectors, id_col, vec_col).distinct()
    spark = base.sparkSession
    place = F.row_number().over(Window.partitionBy("_vec").orderBy("_vec_id"))
    # the limit on the place is applied in the tasks before the shuffle
    firsts = base.withColumn("_place", place).where(F.col("_place") <= k + 1)
    classes = firsts.groupBy("_vec").agg(F.sort_array(F.collect_list("_vec_id")).alias("_ids"))
    classes = written(classes.select(F.col("_ids")[0].alias("_rep"), "_ids", "_vec"), "vector-classes")
    asked = base.join(columns_of(queries, [id_col]).select(F.col(id_col).cast("bigint").alias("_vec_id")).distinct(), "_vec_id", "left_semi")
    asked = written(asked, "queries")

    count = classes.count()
    sample = classes.orderBy(F.xxhash64("_vec"), "_rep").limit(SAMPLE_VECTORS).select("_vec").toArrow().column("_vec").combine_chunks()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not count:
        return spark.createDataFrame([], schema)
    points = _unit(_matrix(sample))
    lists = int(np.clip(count // list_vectors, 1, min(MAX_LISTS, max(1, len(points) // 8))))
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(points, lists)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = graph.value.centroids
        for batch in batches:
            far = _distance(_unit(_matrix(batch.column("_vec"))).astype(np.float32) @ centroids.T)
            near = np.argsort(far, axis=1, kind="stable")[:, :REPLICAS]
            close = np.take_along_axis(far, near, 1)
            close = close <= close[:, :1] * BOUNDARY_RATIO
            rows, columns = np.nonzero(close)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near[rows, columns].astype(np.int32)), pa.array(columns == 0), *(c.take(at) for c in batch.columns)], names=["_list", "_own", *batch.schema.names]
            )

    postings = classes.select("_rep", "_vec").mapInArrow(post, "_list int, _own boolean, _rep bigint, _vec array<double>")
    # every vector is in one list as its own; a row a list, MAX_LISTS at most
    sizes = postings.groupBy("_list").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("_parts"), F.count_if("_own").alias("_held"))
    sizes = written(sizes, "list-sizes")
    held = np.zeros(lists, np.int64)
    for row in sizes.collect():
        held[row["_list"]] = row["_held"]
    postings = postings.drop("_own")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [graph.value.within(q, search_ratio, held, k + 1) for q in _unit(_matrix(batch.column("_vec"))).astype(np.float32)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int32)), *(c.take(at) for c in batch.columns)], names=["_list", *batch.schema.names])

    # equal queries search once
    distinct = asked.groupBy("_vec").agg(F.min("_vec_id").alias("_query"))
    probes = distinct.select("_query", "_vec").mapInArrow(probe, "_list int, _query bigint, _vec array<double>")

    # every block of a list's vectors meets every block of its queries once
    calls = probes.groupBy("_list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("_calls"))
    blocks = written(sizes.drop("_held").join(calls, "_list"), "list-blocks")

    def dealt(df: DataFrame, own: str, parts: str, other: str, others: str) -> DataFrame:
        df = df.join(F.broadcast(blocks), "_list").withColumn(own, F.pmod(F.xxhash64("_vec"), F.col(parts)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_parts", "_calls")

    lists_, asks = dealt(postings, "_p", "_parts", "_q", "_calls"), dealt(probes, "_q", "_calls", "_p", "_parts")
    keep = k + 1

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_query": pd.Series(dtype="int64"), "_rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        held, own = np.array(left["_vec"].tolist()), np.array(right["_vec"].tolist())
        reps = left["_rep"].to_numpy()
        order = np.argsort(reps, kind="stable")
        held, reps = held[order], reps[order]
        near = _unit(own) @ _unit(held).T
        # all that rounding could have put behind the keep-th; the exact scores decide, and the smaller id among equal ones
        width = min(keep, near.shape[1])
        least = -np.partition(-near, width - 1, axis=1)[:, width - 1 : width]
        rows, columns = np.nonzero(near >= least - 8 * (own.shape[1] + 8) * np.finfo(np.float64).eps)
        exact, step = np.empty(len(rows)), max(1, PRODUCTS // own.shape[1])
        for i in range(0, len(rows), step):
            exact[i : i + step] = cosine(own[rows[i : i + step]], held[columns[i : i + step]])
        order = np.lexsort((columns, -exact, rows))  # held is in the order of ids
        rows, columns, exact = rows[order], columns[order], exact[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < width
        rows, columns, exact = rows[first], columns[first], exact[first]
        return pd.DataFrame({"_query": right["_query"].to_numpy()[rows], "_rep": reps[columns], "score": exact})

    keys = ["_list", "_p", "_q"]
    scored = lists_.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(compare, "_query bigint, _rep bigint, score double")
    best = Window.partitionBy("_query").orderBy(F.desc("score"), "_rep")
    # replicas give a pair more than once, with the same score
    found = scored.groupBy("_query", "_rep").agg(F.max("score").alias("score")).withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= keep)
    rows = found.join(classes.select("_rep", "_ids"), "_rep").select("_query", F.explode("_ids").alias("vec_id"), "score")
    ties = Window.partitionBy("_query").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("_place", F.row_number().over(ties)).where(F.col("_place") <= keep)
    near = rows.groupBy("_query").agg(F.collect_list(F.struct("_place", "vec_id", "score")).alias("_near"))
    to_query = asked.join(distinct.select("_query", F.col("_vec").alias("_same")), F.col("_vec") == F.col("_same")).select(F.col("_vec_id").alias("query_id"), "_query")
    out = to_query.join(near, "_query").select("query_id", F.explode(F.expr("filter(array_sort(_near), x -> x.vec_id <> query_id)")).alias("_n"), F.col("_near"))
    own = F.expr("cast(array_position(transform(filter(array_sort(_near), x -> x.vec_id <> query_id), x -> x._place), _n._place) as int)")
    return out.withColumn("rank", own).where(F.col("rank") <= k).select("query_id", "rank", F.col("_n.vec_id").alias("vec_id"), F.col("_n.score").alias("score"))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of vectors along the last axis, in double precision; the same pair gives the same value wherever it is."""
    a, b = np.broadcast_arrays(a.astype(np.float64), b.astype(np.float64))
    a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))
