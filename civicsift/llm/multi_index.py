"""Approximate nearest neighbours by inner product with an inverted multi-index.

Both halves of a vector are quantised on their own; a vector lies in the cell of its two centroids. A
query walks the cells in descending order of the two half scores' sum, with a heap, until the cells it has
seen hold ``SHARE`` of all vectors, and all vectors in those cells are ranked by their exact inner product. To
this end a crowded cell counts as ``CROWD`` average ones, so that copies of one vector do not end a walk early.
Every vector is indexed; only the centroids are fitted on a bounded sample.

The vectors of a few first-half centroids make a lane; large lanes are dealt over several tasks. There they meet
the queries that walk to them, in blocks. A task returns the best rows per query, which are merged.

Defined cases: vectors that are null or zero, that hold null or non-finite components, or whose length is
not the most frequent one (of several such the shortest) take no part, neither do rows without an id. Rows that share an
id are candidates each, listed once with their best score, and share one ranking as a query. Ties go to the smaller id. With
fewer candidates than asked for all are listed. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicsift.llm.common import named
from civicsift.session import materialise

CENTROIDS = 64  # per half
LANES = 16  # tasks the first-half centroids are dealt over, before large ones are split
FIT_ROWS = 8_192  # bound on the vectors the centroids are fitted on, those with the lowest id hashes
ROUNDS = 10
SHARE = 0.45
LEAST_FOUND = 2_000
CROWD = 8
TASK_VECTORS = 4_096
TASK_QUERIES = 4_096
QUERY_ROWS = 256


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


@dataclass(frozen=True)
class MultiIndex:
    """Centroids of the two halves, and the number of vectors in every cell."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    def walk(self, query: np.ndarray) -> list[tuple[int, int]]:
        """Cells with vectors, from the largest sum of half scores on, until they hold enough."""
        half = self.first.shape[1]
        one, two = self.first @ query[:half], self.second @ query[half:]
        rows, columns = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        share = np.minimum(self.counts, max(1, math.ceil(CROWD * self.counts.sum() / max(1, (self.counts > 0).sum()))))
        wanted = max(LEAST_FOUND, SHARE * share.sum())
        heap, seen, cells, found = [(-(one[rows[0]] + two[columns[0]]), 0, 0)], {(0, 0)}, [], 0
        while heap and found < wanted:
            _, i, j = heapq.heappop(heap)
            cell = int(rows[i]), int(columns[j])
            if self.counts[cell]:
                cells.append(cell)
                found += int(share[cell])
            for step in ((i + 1, j), (i, j + 1)):
                if step[0] < rows.size and step[1] < columns.size and step not in seen:
                    seen.add(step)
                    heapq.heappush(heap, (-(one[rows[step[0]]] + two[columns[step[1]]]), *step))
        return cells


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids * centroids).sum(1) - 2.0 * points @ centroids.T, axis=1)


def _centroids(points: np.ndarray) -> np.ndarray:
    """k-means from evenly spaced distinct points."""
    distinct = np.unique(points, axis=0)
    spread = np.random.default_rng(5).permutation(len(distinct))[:CENTROIDS]
    centres = distinct[np.sort(spread)].copy()
    for _ in range(ROUNDS):
        nearest = _nearest(points, centres)
        for at in range(len(centres)):
            if (nearest == at).any():
                centres[at] = points[nearest == at].mean(0)
    return centres


def prepare(table: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """``id, vector`` of the rows that take part, and the length of their vectors."""
    rows = table.select(named(table, id_column).alias("id"), named(table, vector_column).alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    length = lengths["length"] if lengths else 0
    return rows.filter(F.size("vector") == length), length


def build(rows: DataFrame, length: int) -> tuple[DataFrame, MultiIndex]:
    """The index entries ``id, vector, lane, cell`` of all rows, and the centroids with their counts."""
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(FIT_ROWS).toPandas()
    points = np.array(sample["vector"].tolist(), np.float64)
    half = length // 2
    first, second = _centroids(points[:, :half]), _centroids(points[:, half:])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"))
            if len(vectors):
                a, b = _nearest(vectors[:, :half], first), _nearest(vectors[:, half:], second)
                placed = [pa.array(part.astype(np.int32)) for part in (a % LANES, a * len(second) + b)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *placed], ["id", "vector", "lane", "cell"])

    kind = rows.schema["vector"].dataType.simpleString()
    entries = materialise(rows.mapInArrow(assign, f"id long, vector {kind}, lane int, cell int"), "multi-index")
    counts = np.zeros((len(first), len(second)), np.int64)
    for row in entries.groupBy("cell").count().collect():  # CENTROIDS ** 2 rows at most
        counts[divmod(row["cell"], len(second))] = row["count"]
    return entries, MultiIndex(first, second, counts)


def _best(vectors: pd.DataFrame, queries: pd.DataFrame, top: int, all_cells: int) -> pd.DataFrame:
    """The ``top`` vectors of one task for each of its queries, ties kept by id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(vectors) and len(queries):
        ids, cells = vectors["id"].to_numpy(np.int64), vectors["cell"].to_numpy()
        points = np.array(vectors["vector"].tolist(), np.float64)
        for begin in range(0, len(queries), QUERY_ROWS):
            block = queries.iloc[begin:begin + QUERY_ROWS]
            wanted = np.array(block["vector"].tolist(), np.float64)
            open_cells = np.zeros((len(block), all_cells), bool)
            for row, walked in enumerate(block["walked"]):
                open_cells[row, walked] = True
            scores = np.where(open_cells[:, cells], wanted @ points.T, -np.inf)
            for row, query in enumerate(block["id"].to_numpy(np.int64)):
                scores[row, ids == query] = -np.inf
                if len(ids) > top:  # rounding in the product must not decide ties, so near ones stay
                    limit = np.partition(scores[row], -top)[-top]
                    near = np.flatnonzero((scores[row] >= limit - 1e-9 * max(1.0, abs(limit))) & (scores[row] > -np.inf)
                                          if limit > -np.inf else scores[row] > -np.inf)
                else:
                    near = np.flatnonzero(scores[row] > -np.inf)
                exact = (points[near] * wanted[row]).sum(1)
                order = np.lexsort((ids[near], -exact))[:top]
                out.append((np.full(order.size, query), ids[near][order], exact[order]))
    parts = zip(*out, strict=True) if out else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
    return pd.DataFrame({name: np.concatenate(part) for name, part in zip(("query_id", "vec_id", "score"), parts, strict=True)})


def search(entries: DataFrame, index: MultiIndex, queries: DataFrame, top: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``top`` nearest entries found for ``queries`` (``id, vector``)."""
    by_lane = [int(index.counts[lane::LANES].sum()) for lane in range(LANES)]
    deals = [max(1, math.ceil(count / TASK_VECTORS)) for count in by_lane]
    blocks = max(1, math.ceil(queries.count() / TASK_QUERIES))
    all_cells, width = index.counts.size, index.counts.shape[1]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lanes, walked = [], [], []
            for row, query in enumerate(_matrix(batch.column("vector"))):
                by_lane: dict[int, list[int]] = {}
                for a, b in index.walk(query):
                    by_lane.setdefault(a % LANES, []).append(a * width + b)
                at += [row] * len(by_lane)
                lanes += by_lane
                walked += by_lane.values()
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(lanes, pa.int32()), pa.array(walked, pa.list_(pa.int32()))],
                ["id", "vector", "lane", "walked"])

    kind = queries.schema["vector"].dataType.simpleString()
    walks = queries.mapInArrow(walk, f"id long, vector {kind}, lane int, walked array<int>")
    deal = F.element_at(F.array(*map(F.lit, deals)), F.col("lane") + 1)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = (walks.withColumn("block", block)
             .withColumn("deal", F.explode(F.sequence(F.lit(0), deal - 1))))
    held = (entries.withColumn("deal", F.pmod(F.xxhash64("id", F.lit(1)), deal).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    keys = ("lane", "deal", "block")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        lambda vectors, queries: _best(vectors, queries, top, all_cells), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, asked: Column, id_column: str = "vec_id", vector_column: str = "embedding",
            top: int = 20) -> DataFrame:
    """Nearest neighbours within ``table`` of its rows for which ``asked``, a condition on ``id``, holds."""
    rows, length = prepare(table, id_column, vector_column)
    if not length:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries, index = build(rows, length)
    return search(entries, index, entries.filter(asked).select("id", "vector"), top)
