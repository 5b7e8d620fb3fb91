"""Jaccard self-join on word shingles by T-occurrence search with DivideSkip.

Documents of similarity 0.8 share at least ``T`` shingles, so a document need be compared only with those that
share ``k`` of its ``n - T + k`` least frequent shingles; ``k`` is 1 and ``SLACK`` percent of ``n``. Frequencies are estimated for all shingles in a table of
counters of fixed size; any order common to all documents gives the same links, a better one fewer comparisons.

Documents with one set of shingles are one node. The documents of a shingle are its list; lists of the same
documents are searched once, as one unit. A search takes some documents of a unit as an index and runs every other
document of the unit as a query against it: the long inverted lists are set aside, the short ones are merged with a
heap that skips ahead, and a document found often enough is looked for in the long lists by binary search
(``Index.search``). Only pairs that no chain of links connects yet are counted, as the join gives components.

Units of any size are searched in rounds. In the first, every document goes to one of its units only, with its set, which
connects most of what belongs together. Later ones take for each unit the documents outside its largest component, at
most about ``LEADING`` a round; they are indexed in blocks, meet all others of the unit there, and leave it. A set is sent
to a block once, however many units it has in common with it. A unit ends when one component is
left in it. Large searches are dealt over tasks of ``TASK_ROWS`` documents.

Shingles are compared by 64-bit hashes. Defined cases: a null text counts as empty; a document without words has no
shingle, is linked with nothing and keeps its own id as component; fewer than five words are one shingle. Rows that
repeat, or share an id, count as documents each. A null id is no name for a component: rows with one take the
smallest id reachable, null if there is none. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicsift.llm.common import named, small_batches, text_or_empty
from civicsift.llm.components import components
from civicsift.llm.exact_dedup import filter_bits, mark_repeats, member_filter, repeat_filter
from civicsift.llm.passages import SHINGLE, shingles
from civicsift.operators.prefix import spread_lookup
from civicsift.session import materialise

PERCENT = 80  # of the union that the intersection must reach
SLACK = 5  # percent of a set: documents that share a passage only are mostly told apart by it without being compared
COUNTER_BITS = 23  # 2 ** 23 counters of four bytes, whatever the size of the table
COUNTER_PARTS = 64
SLICE_BYTES = 1 << 19
LEADERS = 32  # documents of a unit that are indexed in the first round
LEADING = 1024  # documents of a unit that meet all others of it in one later round
INDEXED = 128  # of these in one block
TASK_ROWS = 512
MU = 0.01  # weight of a heap step against a binary search, in the share of lists set aside


def least_overlap(size: int) -> int:
    """Shingles a set of ``size`` shares with any set it is linked with, at least."""
    return -(-PERCENT * size // 100)


def least_frequent(size: int) -> int:
    """How many of a set's least frequent shingles are looked up."""
    return size - least_overlap(size) + 1 + size * SLACK // 100


def pair_overlap(size: int, other: int) -> int:
    """Shingles that two linked sets share at least: 100 * overlap >= PERCENT * (size + other - overlap)."""
    return -(-PERCENT * (size + other) // (100 + PERCENT))


def _short_text(words: list[bytes]) -> np.ndarray:
    """The one shingle of a text of fewer words than a shingle has."""
    digest = hashlib.blake2b(b" ".join(words), digest_size=8, key=len(words).to_bytes(1, "little")).digest()
    return np.frombuffer(digest, np.uint64)


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of every text, a slice of texts at a time."""
    bodies: list[bytes] = []
    sizes: list[int] = []

    def flush() -> Iterator[np.ndarray]:
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        values, counts, words = shingles(raw, np.array(sizes, np.int64))
        ends = np.cumsum(counts)
        for body, begin, end, n_words in zip(bodies, ends - counts, ends, words, strict=True):
            if 0 < n_words < SHINGLE:
                yield _short_text(body.lower().split())
            else:
                yield np.unique(values[begin:end])
        bodies.clear()
        sizes.clear()

    for text in texts:
        body = (text.as_py() or "").encode()
        if bodies and sum(sizes) + len(body) > SLICE_BYTES:
            yield from flush()
        bodies.append(body)
        sizes.append(len(body))
    if bodies:
        yield from flush()


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """For every counter the number of documents' shingles that fall on it; counted in tasks, added up by part."""
    width = (1 << COUNTER_BITS) // COUNTER_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            for found in sets_of(batch.column("text")):
                np.add.at(counters, (found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        packer = zstandard.ZstdCompressor(level=1)
        packed = [packer.compress(part.tobytes()) for part in counters.reshape(COUNTER_PARTS, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_PARTS), pa.int32()), pa.array(packed, pa.binary())],
                                         ["part", "packed"])

    def add(part: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, reader = np.zeros(width, np.uint32), zstandard.ZstdDecompressor()
        for batch in batches:
            for packed in batch.column("packed"):
                total += np.frombuffer(reader.decompress(packed.as_py()), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([part[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         ["part", "total"])

    parts = texts.mapInArrow(count, "part int, packed binary").groupBy("part").applyInArrow(add, "part int, total binary")
    out = np.zeros((COUNTER_PARTS, width), np.uint32)
    for row in parts.collect():  # COUNTER_PARTS rows, 32 MB in all
        out[row["part"]] = np.frombuffer(row["total"], np.uint32)
    return out.reshape(-1)


def describe(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """``id, n, node, keys``: set size, digest of the set, and its least frequent shingles for every row of ``texts``."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for found in sets_of(batch.column("text")):
                often = shared.value[(found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                order = np.argsort(often, kind="stable")[:least_frequent(found.size)]
                sizes.append(found.size)
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(found[order].view(np.int64))
            ends = np.cumsum([0, *(k.size for k in keys)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *keys])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "n", "node", "keys"])

    return texts.mapInArrow(work, "id long, n long, node binary, keys array<long>")


class Index:
    """Inverted lists of a few sets: for every shingle the places of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = [s.size for s in sets]
        values = np.concatenate([np.zeros(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.owners = owner[order]
        self.values, self.starts, self.lengths = np.unique(values[order], return_index=True, return_counts=True)
        # one ascending row of (list, set) numbers, in which any list can be searched
        self.places = np.repeat(np.arange(self.values.size), self.lengths) * max(len(sets), 1) + self.owners

    def search(self, query: np.ndarray, wanted: list[bool]) -> list[int]:
        """Places of the ``wanted`` sets that share enough shingles with ``query``."""
        least = least_overlap(query.size)
        if not query.size or not self.values.size:
            return []
        at = np.minimum(np.searchsorted(self.values, query), self.values.size - 1)
        lists = at[self.values[at] == query]
        if lists.size < least:
            return []
        lists = lists[np.argsort(self.lengths[lists], kind="stable")]
        aside = min(least - 1, int(least / (MU * math.log2(max(2, int(self.lengths[lists[-1]]))) + 1)))
        short, long = lists[:lists.size - aside], lists[lists.size - aside:]
        out = []
        for place, count in self._merge(short, least - aside):
            need = pair_overlap(query.size, self.sizes[place])
            if wanted[place] and count + long.size >= need and count + self._probe(long, place) >= need:
                out.append(place)
        return out

    def _merge(self, short: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
        """Places on at least ``least`` of the short lists, and on how many, by a heap that skips ahead."""
        lists = [self.owners[s:s + n].tolist() for s, n in zip(self.starts[short], self.lengths[short], strict=True)]
        heap = [(places[0], number, 0) for number, places in enumerate(lists)]
        heapq.heapify(heap)
        while len(heap) >= least:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heapq.heappop(heap))
            if len(popped) >= least:
                yield top, len(popped)
                follow = top + 1
            else:  # no place before the one on top now can still be on enough lists
                while heap and len(popped) < least - 1:
                    popped.append(heapq.heappop(heap))
                follow = max(top + 1, heap[0][0]) if heap else len(self.sizes)
            for _, number, position in popped:
                position = bisect_left(lists[number], follow, position)
                if position < len(lists[number]):
                    heapq.heappush(heap, (lists[number][position], number, position))

    def _probe(self, long: np.ndarray, place: int) -> int:
        """How many of the long lists hold ``place``, by binary search."""
        codes = long * len(self.sizes) + place
        at = np.minimum(np.searchsorted(self.places, codes), self.places.size - 1)
        return int((self.places[at] == codes).sum())


def _search_unit(leaders: list[tuple], others: list[tuple]) -> Iterator[tuple]:
    """Pairs of component names to be joined. Rows are (component, set); leaders meet each other and all others."""
    names = list(dict.fromkeys([name for name, _ in leaders] + [name for name, _ in others]))
    root = {name: name for name in names}

    def find(name: object) -> object:
        while root[name] != name:
            root[name] = name = root[root[name]]
        return name

    index = Index([found for _, found in leaders])
    for number, (name, found) in enumerate(leaders + others):
        wanted = [place > number and find(name) != find(leader) if number < len(leaders) else find(name) != find(leader)
                  for place, (leader, _) in enumerate(leaders)]
        if any(wanted):
            for place in index.search(found, wanted):
                one, two = find(name), find(leaders[place][0])
                if one != two:
                    root[max(one, two)] = min(one, two)
                    yield name, leaders[place][0]


def search_rows(rows: DataFrame) -> DataFrame:
    """Links ``u, v`` between components, from ``unit, deal, leads, component, found``; a (unit, deal) is searched at once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, leaders, others, links = None, [], [], []

        def flush() -> None:
            if leaders:
                links.extend(_search_unit(leaders, others))
            leaders.clear()
            others.clear()

        for batch in batches:
            for unit, deal, leads, name, found in zip(*(batch.column(i) for i in range(5)), strict=True):
                key = (unit.as_py(), deal.as_py())
                if key != current:
                    flush()
                    current = key
                (leaders if leads.as_py() else others).append((name.as_py(), np.frombuffer(found.as_py(), np.uint64)))
            yield _links(links)
            links.clear()
        flush()
        yield _links(links)

    placed = rows.repartition("unit", "deal").sortWithinPartitions("unit", "deal", F.desc("leads"))
    return placed.mapInArrow(work, "u binary, v binary")


def _links(links: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([link[side] for link in links], pa.binary()) for side in (0, 1)], ["u", "v"])


def may_hold(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is among ``keys``, and a few others, found without shuffling ``rows``."""
    bits = filter_bits(keys.count())
    words = materialise(member_filter(keys, key, bits), "unit-filter")
    return mark_repeats(rows, key, words, words.count(), bits).filter("maybe_repeated").drop("maybe_repeated")


def distinct_sets(described: DataFrame) -> DataFrame:
    """``node, id, rows, n, keys``: a row for each set. Only rows whose set may be another row's too are shuffled."""
    held = described.filter("n > 0")
    bits = filter_bits(held.count())
    words = materialise(repeat_filter(held, "node", bits), "node-filter")
    marked = mark_repeats(held, "node", words, words.count(), bits)
    single = marked.filter("not maybe_repeated").select("node", "id", F.lit(1).cast("long").alias("rows"), "n", "keys")
    return single.unionByName(marked.filter("maybe_repeated").groupBy("node").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("keys").alias("keys")))


def candidate_units(nodes: DataFrame) -> DataFrame:
    """``unit, node, n``: the nodes of every list of two or more; lists of the same nodes are one unit.

    A node stays if it shares as many of its looked-up shingles as it shares with any node it is linked with. That one is
    no smaller than ``PERCENT`` of the node, and so are the shingles it adds to its own prefix.
    """
    entries = nodes.select(F.explode("keys").alias("key"), "node", "n")
    lists = entries.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64("node", F.lit(7))).alias("two")).filter("size > 1")
    units = materialise(lists.groupBy("size", "one", "two").agg(
        F.min("key").alias("unit"), F.count(F.lit(1)).alias("lists")).select("unit", "lists"), "units")
    of_units = may_hold(entries, "key", units.select(F.col("unit").alias("key")))
    held = materialise(of_units.join(units, of_units["key"] == units["unit"]).select("unit", "lists", "node", "n"), "unit-nodes")
    shared = held.groupBy("node", "n").agg(F.sum("lists").alias("shared")).filter(
        F.col("shared") > F.floor(F.col("n") * PERCENT * SLACK / 10_000)).select("node")
    kept = materialise(held.join(materialise(shared, "unit-shared"), "node").select("unit", "node", "n"), "unit-kept")
    several = materialise(kept.groupBy("unit").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("unit"), "unit-several")
    return materialise(kept.join(several, "unit"), "unit-nodes")


def needed_sets(texts: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """``node, found``: the sets of the candidates, from the texts of rows that may hold one."""
    spark = texts.sparkSession
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    wanted = materialise(nodes.join(candidates, "node", "left_semi").select("node", name.alias("name")), "unit-names")
    near = may_hold(texts.withColumn("name", name), "name", wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of this task; a set that several tasks give is searched as often, to the same end
        for batch in batches:
            fresh = {}
            for found in sets_of(batch.column("text")):
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if digest not in seen:
                    seen.add(digest)
                    fresh[digest] = found.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array(list(fresh.values()), pa.binary())],
                                             ["node", "found"])

    small_batches(spark)
    return materialise(near.select("text").mapInArrow(work, "node binary, found binary"), "unit-sets")


def _live(units: DataFrame, names: DataFrame, number: int, most: int) -> DataFrame:
    """The units with two components at least, and which of their nodes outside the largest one lead this round: all, or
    about ``most``."""
    now = units.join(names, "node").select("unit", "node", "n", "component")
    parts = now.groupBy("unit", "component").agg(F.count(F.lit(1)).alias("part"))
    shape = parts.groupBy("unit").agg(F.max_by("component", F.struct("part", "component")).alias("main"),
                                      F.max("part").alias("most"), F.sum("part").alias("size")).filter("size > most")
    outside = F.col("size") - F.col("most")
    chance = (F.xxhash64("node", F.lit(number)).cast("double") / 2.0 ** 64 + 0.5) * outside
    return materialise(now.join(shape, "unit").select(
        "unit", "node", "n", "component", "size",
        ((F.col("component") != F.col("main")) & ((outside <= most) | (chance < most))).alias("leads")), "unit-round")


def _sent(taking: DataFrame, sets: DataFrame) -> DataFrame:
    """Search ``unit, deal, leads, component, node``. It is written first, so that its size is known and, while it is small,
    the sets stay where they are until they go to their tasks; otherwise those that are needed move once more."""
    taking = materialise(taking.select("unit", "deal", "leads", "component", "node"), "unit-taking")
    rows = taking.join(may_hold(sets, "node", taking.select("node")), "node")
    return search_rows(rows.select("unit", "deal", "leads", "component", "found"))


def _dealt(rows: DataFrame, size: str, number: int) -> DataFrame:
    """Give leaders every ``deal`` of their unit, others one of them."""
    deals = F.ceil(F.col(size) / TASK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(number), F.lit(1)), deals).cast("int")
    return rows.withColumn("deal", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0), deals - 1)).otherwise(F.array(own))))


def first_links(live: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within units, every node being in one unit only."""
    reach = live.filter("leads").groupBy("unit").agg(F.min("n").alias("least"), F.max("n").alias("greatest"))
    useful = F.col("leads") | ((100 * F.col("n") >= PERCENT * F.col("least")) & (PERCENT * F.col("n") <= 100 * F.col("greatest")))
    return _sent(_dealt(live.join(reach, "unit").filter(useful), "size", 0), sets)


def later_links(live: DataFrame, sets: DataFrame, number: int) -> DataFrame:
    """Links between components of units whose nodes are in many of them.

    Leaders that have their largest unit in common are indexed together, up to about ``INDEXED`` in a block. A node goes once to
    every block that holds a leader of one of its units, so that what is sent grows with blocks, not with pairs.
    """
    leaders = live.filter("leads")
    homes = leaders.groupBy("node").agg(F.max_by("unit", F.struct("size", "unit")).alias("home"))
    crowds = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / INDEXED).cast("int").alias("shares"))
    blocks = materialise(homes.join(crowds, "home").select("node", F.struct(
        "home", F.pmod(F.xxhash64("node", F.lit(number)), F.col("shares")).cast("int").alias("share")).alias("block")), "unit-blocks")
    led = leaders.join(blocks, "node").select("unit", "block", "node", "n", "component")
    reach = led.groupBy("block").agg(F.min("n").alias("least"), F.max("n").alias("greatest"),
                                     F.min("component").alias("one"), F.max("component").alias("two"))
    meeting = led.select("unit", "block").distinct().join(live.select("unit", "node", "n", "component"), "unit").select(
        "block", "node", "n", "component", F.lit(False).alias("leads"))
    every = led.select("block", "node", "n", "component", F.lit(True).alias("leads")).unionByName(meeting)
    once = every.groupBy("block", "node", "n", "component").agg(F.max("leads").alias("leads")).join(reach, "block")
    useful = F.col("leads") | ((100 * F.col("n") >= PERCENT * F.col("least")) & (PERCENT * F.col("n") <= 100 * F.col("greatest"))
                               & ((F.col("one") != F.col("two")) | (F.col("component") != F.col("one"))))
    kept = materialise(once.filter(useful).select(F.col("block").alias("unit"), "node", "component", "leads"), "unit-meeting")
    sizes = kept.groupBy("unit").agg(F.count(F.lit(1)).alias("size"))
    return _sent(_dealt(kept.join(sizes, "unit"), "size", number), sets)


def linked_nodes(units: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, component`` of all nodes of ``units``; a component is named after one of its nodes."""
    names = materialise(units.select("node").distinct().withColumn("component", F.col("node")), "node-names")
    own = units.groupBy("node").agg(F.min_by("unit", F.xxhash64("unit")).alias("unit"))
    first, number = units.join(own, ["node", "unit"]), 0
    while True:
        live = _live(units, names, number, LEADING) if number else _live(first, names, number, LEADERS)
        if number and live.isEmpty():
            return names
        links = materialise(later_links(live, sets, number) if number else first_links(live, sets), "unit-links")
        if not links.isEmpty():
            roots = components(links)
            names = materialise(
                names.join(roots, names["component"] == roots["node"], "left")
                .select(names["node"], F.coalesce("root", "component").alias("component")), "node-names")
        if number:
            units = materialise(live.filter("not leads").select("unit", "node", "n"), "unit-nodes")
        number += 1


def join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(named(docs, id_column).cast("long").alias("id"), text_or_empty(named(docs, text_column)).alias("text"))
    described = materialise(describe(texts, shingle_counts(texts.select("text"))), "shingle-sets")
    nodes = materialise(distinct_sets(described), "shingle-nodes")
    units = candidate_units(nodes)
    candidates = materialise(units.select("node").distinct(), "unit-candidates")
    names = linked_nodes(units, needed_sets(texts, nodes, candidates))
    known = nodes.select("node", "id", "rows").join(names, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = known.groupBy("component").agg(F.min("id").alias("component_id"))
    named_nodes = materialise(known.join(lowest, "component").select("node", "rows", "component_id"), "node-components")
    full = described.select("id", "n", "node").filter("n > 0")
    total = named_nodes.agg(F.sum("rows")).first()[0] or 0
    linked = spread_lookup(full, named_nodes, "node", "rows", total, spread_on=["id"])
    empty = described.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.select("id", "n", "component_id").unionByName(empty).select("id", F.col("n").alias("n_shingles"), "component_id")
