"""Near-duplicates by SimHash fingerprints and a binary trie self-join.

A fingerprint is linked with every other one that differs in at most ``MOST_BITS`` bits. The distinct
fingerprints form a binary trie. Node pairs are traversed together: each step goes one bit down on both
sides, adds a differing bit to the pair's errors, and drops the pair once its errors exceed the budget. The top of the
trie is laid out over Spark: a task holds the pairs of two nodes at a depth that grows with the data, and
descends from there over sorted arrays. A task returns a spanning forest of the links it finds instead of
all of them, so a dense cluster costs one row per member; the forests are joined to components.

Defined cases: null texts and texts without words have fingerprint 0, which is linked like any other; texts
of fewer words than a shingle give their whole sequence as the only shingle. Equal fingerprints form one node
and are always linked. Repeated rows each get their own row. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicsift.llm.common import named, unpacked, whole_row
from civicsift.llm.components import components
from civicsift.llm.exact_dedup import filter_bits, mark_repeats, member_filter
from civicsift.operators.prefix import spread_lookup
from civicsift.session import materialise

WORDS = 3
SEED = 42
BITS = 64
MOST_BITS = 3
NODE_ROWS = 8_192  # fingerprints below a node where the tasks begin, about
DEEPEST_START = 24
FRONTIER_PAIRS = 500_000  # node pairs expanded at once
SMALL_NODES = 16  # node pairs with at most so many leaf pairs are compared leaf by leaf

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """SimHash of a text: unsigned, 64 bits."""
    words = (text or "").encode("utf-8").lower().split()  # on bytes, both look at ASCII only
    if not words:
        return 0
    if len(words) < WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = [*map(b" ".join, zip(*(words[at:] for at in range(WORDS)), strict=False))]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(shingle, SEED) for shingle in shingles), np.uint64, len(shingles))
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, at], minlength=256) @ _BYTE_BITS for at in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed ``bigint``."""

    @F.arrow_udf("bigint")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            prints = np.fromiter((fingerprint(value.as_py()) for value in batch), np.uint64, len(batch))
            yield pa.array(prints.view(np.int64))

    return made.asNondeterministic()(text)


def start_depth(prints: int) -> int:
    """Depth of the trie nodes that tasks begin with."""
    return min(DEEPEST_START, max(0, math.ceil(math.log2(max(prints, 1) / NODE_ROWS))))


def _masks(depth: int, most: int) -> list[int]:
    """All differences of two node numbers at ``depth`` within the error budget."""
    masks, fresh = [0], [0]
    for _ in range(min(depth, most)):
        fresh = [mask | 1 << bit for mask in fresh for bit in range(depth) if mask < 1 << bit]
        masks += fresh
    return masks


def descend(left: np.ndarray, right: np.ndarray, depth: int, errors: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within ``most`` differing bits below two nodes at ``depth``.

    ``left`` and ``right`` are the sorted unsigned fingerprints below the nodes; they may be one array, whose
    pairs then come once. Yields blocks of positions in ``left`` and ``right``.
    """
    same = left is right
    root = np.array([[0], [left.size], [0], [right.size], [errors]], np.int64)
    stack = [(depth, root)]
    while stack:
        depth, pairs = stack.pop()
        a, a_end, b, b_end, error = pairs
        small = ((a_end - a) * (b_end - b) <= SMALL_NODES) | (depth == BITS)
        if small.any():
            yield from _compare(left, right, pairs[:, small], most, same)
            pairs = pairs[:, ~small]
            a, a_end, b, b_end, error = pairs
        if not a.size:
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        above = ~(np.uint64((1 << (BITS - depth)) - 1))
        a_mid = np.clip(np.searchsorted(left, left[a] & above | bit), a, a_end)
        b_mid = np.clip(np.searchsorted(right, right[b] & above | bit), b, b_end)
        children = [
            np.stack([a, a_mid, b, b_mid, error]),
            np.stack([a_mid, a_end, b_mid, b_end, error]),
            np.stack([a, a_mid, b_mid, b_end, error + 1]),
            np.stack([a_mid, a_end, b, b_mid, error + 1])[:, (a != b) if same else slice(None)],
        ]
        grown = np.concatenate(children, axis=1)
        grown = grown[:, (grown[4] <= most) & (grown[0] < grown[1]) & (grown[2] < grown[3])]
        stack += [(depth + 1, grown[:, at:at + FRONTIER_PAIRS]) for at in range(0, grown.shape[1], FRONTIER_PAIRS)]


def _compare(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, most: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs of node pairs, compared bit by bit."""
    a, a_end, b, b_end, _ = pairs
    width = b_end - b
    counts = (a_end - a) * width
    edges = np.flatnonzero(np.diff(np.cumsum(counts) // FRONTIER_PAIRS, prepend=-1) > 0)
    for begin, end in zip(edges, [*edges[1:], counts.size], strict=True):
        number = counts[begin:end]
        owner = np.repeat(np.arange(begin, end), number)
        within = np.arange(owner.size) - np.repeat(np.cumsum(number) - number, number)
        first, second = a[owner] + within // width[owner], b[owner] + within % width[owner]
        close = np.bitwise_count(left[first] ^ right[second]) <= most
        if same:
            close &= first < second
        if close.any():
            yield first[close], second[close]


def forest(size: int, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``size`` nodes the lowest node it is linked with, directly or not."""
    label = np.arange(size)
    for first, second in blocks:
        while True:
            low, high = label[first], label[second]
            apart = low != high
            first, second, low, high = first[apart], second[apart], low[apart], high[apart]
            if not first.size:
                break
            np.minimum.at(label, np.maximum(low, high), np.minimum(low, high))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def _join_nodes(prints: pd.DataFrame, depth: int, most: int) -> pd.DataFrame:
    """Links of one node pair, as a forest: ``u`` and ``v`` fingerprints. Rows hold ``side`` 0 or 1."""
    values = prints["print"].to_numpy(np.int64).view(np.uint64)
    sides = prints["side"].to_numpy()
    left, right = np.sort(values[sides == 0]), np.sort(values[sides == 1])
    empty = pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
    if not left.size or (bool((prints["own"] == 0).all()) and not right.size):
        return empty
    if bool((prints["own"] == 1).all()):
        nodes = left
        blocks = descend(left, left, depth, 0, most)
    else:
        nodes = np.concatenate([left, right])
        shift = np.uint64(BITS - depth)
        errors = int(np.bitwise_count((left[0] ^ right[0]) >> shift)) if depth else 0
        blocks = ((a, b + left.size) for a, b in descend(left, right, depth, errors, most))
    label = forest(nodes.size, blocks)
    linked = np.flatnonzero(label != np.arange(nodes.size))
    return pd.DataFrame({"u": nodes[linked].view(np.int64), "v": nodes[label[linked]].view(np.int64)})


def links(prints: DataFrame, count: int, most: int = MOST_BITS) -> DataFrame:
    """``u, v``: links among the distinct fingerprints ``print`` that join all those within ``most`` bits."""
    depth = start_depth(count)
    node = F.shiftrightunsigned("print", BITS - depth) if depth else F.lit(0).cast("long")
    other = F.explode(F.array(*[F.lit(mask).cast("long") for mask in _masks(depth, most)])).alias("mask")
    dealt = prints.select("print", node.alias("node"), other).select(
        "print",
        F.least("node", F.col("node").bitwiseXOR(F.col("mask"))).alias("low"),
        F.greatest("node", F.col("node").bitwiseXOR(F.col("mask"))).alias("high"),
        (F.col("node") > F.col("node").bitwiseXOR(F.col("mask"))).cast("int").alias("side"),
        (F.col("mask") == 0).cast("int").alias("own"))
    return dealt.groupBy("low", "high").applyInPandas(
        lambda group: _join_nodes(group, depth, most), "u long, v long")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return docs.select(named(docs, id_column).alias("doc_id"), fingerprint_column(named(docs, text_column)).alias("print"))


def group(prints: DataFrame) -> DataFrame:
    """``doc_id, print`` rows with ``component_id``: the smallest doc_id that links lead to."""
    nodes = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "nodes")
    distinct, total = nodes.agg(F.count(F.lit(1)), F.sum("rows")).first()
    found = materialise(links(nodes.select("print"), distinct), "links")
    roots = components(found).withColumnRenamed("node", "print")
    rooted = nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    table = rooted.join(lowest, "root").select("print", "rows", "component_id")
    return spread_lookup(prints, table, "print", "rows", total or 0, how="inner", spread_on=["doc_id"])


def components_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, print, component_id``."""
    return group(materialise(fingerprints(docs, id_column, text_column), "prints"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all their columns.

    Rows that share this id all stay, and so do rows without an id. A Bloom filter of the ids that go lets the other
    rows pass without being shuffled.
    """
    grouped = components_of(docs, id_column, text_column)
    gone = materialise(grouped.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone"))
                       .distinct(), "gone")
    bits = filter_bits(gone.count())
    words = materialise(member_filter(gone, "gone", bits), "gone-filter")
    rows = docs.select(named(docs, id_column).alias("id"), whole_row(docs).alias("row"))
    marked = mark_repeats(rows, "id", words, words.count(), bits)
    checked = marked.filter("maybe_repeated").join(gone, F.col("id") == F.col("gone"), "left_anti")
    stay = marked.filter(~F.col("maybe_repeated")).select("row").unionByName(checked.select("row"))
    return stay.select(*unpacked(stay, docs.columns))
