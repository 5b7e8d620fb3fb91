"""Hard-negative mining with cover trees over norm-augmented vectors.

A candidate ``x`` gets one more component, the root of ``M^2 - |x|^2``, with ``M`` the greatest norm; an anchor gets a zero.
Inner products stay the same and candidates lie on one sphere. Each tree covers the candidates of a task: a node's
covering radius bounds the distance of all candidates below it from its centre, so the centre's inner product,
give or take the anchor's norm times that radius, bounds theirs. Trees are descended best bound first; a node
whose bounds miss every window still open, or cannot beat the rows found so far, is skipped, and leaves are scored exactly.

Candidates are dealt to tasks by the nearest of a few pivots, large pivots' candidates over several tasks, and every anchor
visits every tree. Only the best rows of a tree per anchor leave a task. The positives are found first; their scores
give the windows in which negatives are searched.

Vectors are compared by whole numbers, ``floor(256 * x)`` for every component; they saturate at 2^22 either way, so
that products of vectors of up to 4,000 components, times a hundred, fit 64 bits. Shorter vectors are filled up with zeros.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part. A row is no positive or
negative of itself, but other rows with its id are. A null id makes no anchor; as a candidate it comes last among ties.
Anchors without positives, and positives without negatives, give no rows. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicsift.llm.common import named, small_batches
from civicsift.session import materialise

SCALE = 256.0
SATURATED = 1 << 22
PIVOTS = 16
TASK_ROWS = 16_384
TASK_ANCHORS = 8_192
LEAF = 64  # rows a leaf holds without being split
SHRINK = 1.5  # by which the radius to cover shrinks from level to level
LEAST_FILL = 32  # rows a child must hold on average; a node that does not cluster stays a leaf
NO_ID = (1 << 63) - 1
LOWEST, GREATEST, PERCENT = 50, 95, 100  # the window of negative scores, in parts of the positive's


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite


def whole_numbers(vector: Column) -> Column:
    def scaled(x: Column) -> Column:
        wide = F.least(F.greatest(F.lit(SCALE) * x.cast("double"), F.lit(float(-SATURATED))), F.lit(float(SATURATED)))
        return F.floor(wide).cast("int")
    return F.transform(vector, scaled)


def products(points: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products of whole-number vectors; ``small``: no sum passes 2^53, so that doubles are exact."""
    if small:
        return (points @ query).astype(np.int64)
    return points.astype(np.int64) @ query.astype(np.int64)


@dataclass
class Node:
    centre: int
    radius: float
    rows: np.ndarray  # all rows below
    children: list[int] = field(default_factory=list)


class CoverTree:
    """A tree over the rows of ``points``, whole numbers held as doubles. Child centres are rows of their parent, the
    parent's own centre first; they are more than ``radius / SHRINK`` apart and cover the parent's rows within it."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        norms = np.einsum("ij,ij->i", points, points)
        greatest = norms.max() if len(points) else 0.0
        self.augmented = np.concatenate([points, np.sqrt(np.maximum(greatest - norms, 0.0))[:, None]], 1)
        self.size = math.sqrt(max(greatest, 0.0))
        self.nodes: list[Node] = []
        if len(points):
            every = np.arange(len(points))
            self._add(0, every, self._distances(0, every))

    def _distances(self, centre: int, rows: np.ndarray) -> np.ndarray:
        apart = self.augmented[rows] - self.augmented[centre]
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))

    def _add(self, centre: int, rows: np.ndarray, distances: np.ndarray) -> int:
        top = len(self.nodes)
        self.nodes.append(Node(centre, float(distances.max()), rows))
        waiting = [(top, distances)]
        while waiting:
            number, apart = waiting.pop()
            for child, child_apart in self._cover(self.nodes[number], apart):
                self.nodes[number].children.append(len(self.nodes))
                waiting.append((len(self.nodes), child_apart))
                self.nodes.append(child)
        return top

    def _cover(self, node: Node, apart: np.ndarray) -> list[tuple[Node, np.ndarray]]:
        if len(node.rows) <= LEAF or node.radius == 0:
            return []
        within, out = node.radius / SHRINK, []
        centre, rest, distances = node.centre, node.rows, apart
        while True:
            near = distances <= within
            out.append((Node(centre, float(distances[near].max()), rest[near]), distances[near]))
            rest = rest[~near]
            if not len(rest):
                return out
            if len(out) > max(8, len(node.rows) // LEAST_FILL):
                return []
            centre = int(rest[0])
            distances = self._distances(centre, rest)

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest inner product that rows below each node can have with ``query``."""
        middle = self.points[[node.centre for node in self.nodes]] @ query
        norm = math.sqrt(query @ query)
        slack = 1e-9 * norm * (1.0 + self.size) + 1e-6  # rounding of centres, radii and norms
        reach = norm * np.array([node.radius for node in self.nodes]) + slack
        return middle - reach, middle + reach

    def descend(self, query: np.ndarray, wants: list[Wanted], small: bool) -> None:
        """Offer the rows below all nodes that may matter to ``wants``, best bound first."""
        if not self.nodes:
            return
        low, high = self.bounds(query)
        heap = [(-high[0], 0)]
        while heap:
            _, number = heapq.heappop(heap)
            if not any(want.may_take(low[number], high[number]) for want in wants):
                continue
            node = self.nodes[number]
            for child in node.children:
                heapq.heappush(heap, (-high[child], child))
            if not node.children:
                scores = products(self.points[node.rows], query, small)
                for want in wants:
                    want.offer(node.rows, scores)


class Wanted:
    """The best rows with scores in a window, among those for which ``fits`` holds; ties by ``ids``, then by row."""

    def __init__(self, top: int, fits: np.ndarray, ids: np.ndarray, least: int | None = None, greatest: int | None = None,
                 percent: int = 1) -> None:
        self.top, self.fits, self.ids = top, fits, ids
        self.least, self.greatest, self.percent = least, greatest, percent
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def may_take(self, low: float, high: float) -> bool:
        if self.least is not None and (high * self.percent < self.least or low * self.percent > self.greatest):
            return False
        return self.rows.size < self.top or high >= self.scores[-1]

    def offer(self, rows: np.ndarray, scores: np.ndarray) -> None:
        take = self.fits[rows]
        if self.least is not None:
            take = take & (scores * self.percent >= self.least) & (scores * self.percent <= self.greatest)
        if self.rows.size == self.top:
            take = take & (scores >= self.scores[-1])
        rows, scores = np.concatenate([self.rows, rows[take]]), np.concatenate([self.scores, scores[take]])
        best = np.lexsort((rows, self.ids[rows], -scores))[:self.top]
        self.rows, self.scores = rows[best], scores[best]


def _matrix(packed: pd.Series, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.int32).reshape(-1, length).astype(np.float64)


@dataclass(frozen=True)
class Dealt:
    """Candidates ``row, id, label, vector, lane, deal`` (packed vectors of ``length`` whole numbers)."""

    rows: DataFrame
    length: int
    small: bool


def deal(table: DataFrame, id_column: str, vector_column: str, label: Column) -> Dealt | None:
    """Give every row that takes part its number, whole-number vector and task; None if there are none."""
    spark = table.sparkSession
    small_batches(spark)
    given = table.select(named(table, id_column).cast("long").alias("id"), label.alias("label"),
                         named(table, vector_column).alias("vector"))
    usable_rows = given.filter(F.col("label").isNotNull() & usable(F.col("vector"))).select(
        F.monotonically_increasing_id().alias("row"), "id", F.col("label").cast("string").alias("label"),
        whole_numbers(F.col("vector")).alias("vector"))
    numbered = materialise(usable_rows, "mining-rows")  # fixes the row numbers
    longest, greatest = numbered.agg(
        F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()
    if longest is None:
        return None
    length = max(longest, 1)
    small = length * (greatest or 0) ** 2 < 1 << 53
    sample = numbered.orderBy(F.xxhash64("row"), "row").limit(PIVOTS).select("vector").collect()
    pivots = np.zeros((len(sample), length))
    for at, row in enumerate(sample):
        pivots[at, :len(row["vector"])] = row["vector"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            points = np.zeros((len(batch), length), np.int32)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            points[np.repeat(np.arange(len(batch)), sizes), at] = vectors.flatten().to_numpy(zero_copy_only=False)
            lanes = np.argmin((pivots * pivots).sum(1) - 2.0 * points @ pivots.T, axis=1).astype(np.int32)
            packed = pa.array([point.tobytes() for point in points], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("label"), packed,
                                              pa.array(lanes)], ["row", "id", "label", "vector", "lane"])

    placed = numbered.mapInArrow(place, "row long, id long, label string, vector binary, lane int")
    stored = materialise(placed, "mining-lanes")
    deals = [1] * PIVOTS
    for row in stored.groupBy("lane").count().collect():  # PIVOTS rows at most
        deals[row["lane"]] = math.ceil(row["count"] / TASK_ROWS)
    of_lane = F.element_at(F.array(*map(F.lit, deals)), F.col("lane") + 1)
    tasks = F.pmod(F.xxhash64("row"), of_lane).cast("int") + F.element_at(
        F.array(*[F.lit(sum(deals[:lane])) for lane in range(PIVOTS)]), F.col("lane") + 1)
    dealt = stored.withColumn("task", tasks).drop("lane")
    return Dealt(dealt, length, small)


def _visit(dealt: Dealt, anchors: DataFrame, wanted, schema: str) -> DataFrame:
    """Run ``wanted(candidates, anchors)``, pandas frames, for every tree and every block of anchors."""
    tasks = [row["task"] for row in dealt.rows.select("task").distinct().collect()]  # a number per TASK_ROWS rows
    blocks = max(1, math.ceil(anchors.count() / TASK_ANCHORS))
    asked = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn(
        "task", F.explode(F.array(*map(F.lit, tasks))))
    held = dealt.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return held.groupBy("task", "block").cogroup(asked.groupBy("task", "block")).applyInPandas(wanted, schema)


def _ids(column: pd.Series) -> np.ndarray:
    return column.astype("Int64").fillna(NO_ID).to_numpy(np.int64)


def _found(parts: list[tuple], names: list[str], id_name: str) -> pd.DataFrame:
    columns = [np.concatenate(part) for part in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64) for _ in names]
    out = pd.DataFrame(dict(zip(names, columns, strict=True)))
    out[id_name] = out[id_name].astype("Int64").mask(out[id_name] == NO_ID)
    return out


def positives(dealt: Dealt, anchors: DataFrame, top: int) -> DataFrame:
    """``row, place, positive_id, positive_score``: the ``top`` best other rows of an anchor's label, from place 1 on."""
    length, small = dealt.length, dealt.small
    names = ["row", "positive_row", "positive_id", "positive_score"]

    def search(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(candidates) and len(asked):
            points, ids = _matrix(candidates["vector"], length), _ids(candidates["id"])
            rows, labels = candidates["row"].to_numpy(), candidates["label"].to_numpy(object)
            for label, group in asked.groupby("label"):
                mine = np.flatnonzero(labels == label)
                tree = CoverTree(points[mine])
                for row, query in zip(group["row"], _matrix(group["vector"], length), strict=True):
                    want = Wanted(top, rows[mine] != row, ids[mine])
                    tree.descend(query, [want], small)
                    hit = mine[want.rows]
                    parts.append((np.full(hit.size, row), rows[hit], ids[hit], want.scores))
        return _found(parts, names, "positive_id")

    found = _visit(dealt, anchors, search, ", ".join(f"{name} long" for name in names))
    place = F.row_number().over(Window.partitionBy("row").orderBy(
        F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row"))
    return found.withColumn("place", place).filter(F.col("place") <= top).select("row", "place", "positive_id", "positive_score")


def negatives(dealt: Dealt, anchors: DataFrame, top: int) -> DataFrame:
    """``row, place, rank, negative_id, negative_score`` for ``anchors`` with ``scores``, those of their positives by place."""
    length, small = dealt.length, dealt.small
    names = ["row", "place", "negative_row", "negative_id", "negative_score"]

    def search(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(candidates) and len(asked):
            points, ids = _matrix(candidates["vector"], length), _ids(candidates["id"])
            rows, labels = candidates["row"].to_numpy(), candidates["label"].to_numpy(object)
            tree = CoverTree(points)
            for label, group in asked.groupby("label"):
                other = labels != label
                for row, scores, query in zip(group["row"], group["scores"], _matrix(group["vector"], length), strict=True):
                    wants = [Wanted(top, other, ids, LOWEST * int(s), GREATEST * int(s), PERCENT) for s in scores]
                    tree.descend(query, [want for want in wants if want.least <= want.greatest], small)
                    for place, want in enumerate(wants, 1):
                        count = want.rows.size
                        parts.append((np.full(count, row), np.full(count, place), rows[want.rows], ids[want.rows], want.scores))
        return _found(parts, names, "negative_id")

    found = _visit(dealt, anchors, search, ", ".join(f"{name} long" for name in names))
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(
        F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        "row", "place", "rank", "negative_id", "negative_score")


def mine(table: DataFrame, asked: Column, label: Column, id_column: str = "vec_id", vector_column: str = "embedding",
         n_positives: int = 5, n_negatives: int = 3) -> DataFrame:
    """Hard negatives of the rows for which ``asked``, a condition on ``id``, holds. ``label`` is a column of ``table``."""
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    dealt = deal(table, id_column, vector_column, label)
    if dealt is None:
        return table.sparkSession.createDataFrame([], names)
    anchors = materialise(dealt.rows.filter(asked).select("row", "id", "label", "vector"), "mining-anchors")
    best = materialise(positives(dealt, anchors, n_positives), "mining-positives")
    by_anchor = best.groupBy("row").agg(F.transform(  # n_positives at most
        F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    found = negatives(dealt, anchors.join(by_anchor, "row"), n_negatives)
    return (found.join(best, ["row", "place"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
