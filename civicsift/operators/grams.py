"""Counting of n-grams a batch of texts at a time.

Texts of ASCII characters only are taken apart here, from their bytes; the tokens of others are made in Spark. A batch of
token lists is encoded as numbers once, an n-gram is the number of a (shorter n-gram, token) pair, and what is counted are
numbers; every distinct n-gram of a batch is written out as text once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20  # of texts and token lists sent to Python at once, about
OUT_ROWS = 100_000  # rows sent back to Spark at once
TERM_BITS = 16  # for each term that is looked for, up to 2 ** MOST_BITS in all
MOST_BITS = 28
BIT_SLICES = 16  # of the bits, each set by one task
SHORTEST = 2  # characters of a token, as in MODEL_TOKEN

# batches are counted in executors, which need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark send token lists to Python in batches of bounded size, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def batch_terms(tokens: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """``rows, numbers, counts, terms``: the distinct terms of every token list by their numbers in ``terms``, in the order
    of the lists, and how often they occur there. A missing list has no terms."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(tokens), dtype=np.int64), sizes)
    codes, words = _encoded(tokens.flatten())
    grams, names = codes, words
    owners, numbers, terms, known = [], [], [], 0
    for n in range(1, high + 1):
        if n > 1:  # pairs within one list of the n-gram before, and the token after it
            starts = np.flatnonzero(rows[:max(rows.size - n + 1, 0)] == rows[n - 1:])
            pairs, distinct = _encoded(pa.array(grams[starts] * len(words) + codes[starts + n - 1]))
            distinct = distinct.to_numpy(zero_copy_only=False)
            grams = np.full(rows.size, -1, np.int64)
            grams[starts] = pairs
            names = pc.binary_join_element_wise(
                names.take(pa.array(distinct // max(len(words), 1))), words.take(pa.array(distinct % max(len(words), 1))), " ")
        else:
            starts = np.arange(rows.size)
        if n >= low:
            owners.append(rows[starts])
            numbers.append(grams[starts] + known)
            terms.append(names)
            known += len(names)
    every = pa.concat_arrays([pa.array([], pa.string()), *terms])
    number = np.concatenate([np.zeros(0, np.int64), *numbers])
    if pc.any(pc.match_substring(words, " ")).as_py():  # then two n-grams may read alike
        again, every = _encoded(every)
        number = again[number]
    keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *owners]) * max(len(every), 1) + number, return_counts=True)
    return keys // max(len(every), 1), keys % max(len(every), 1), counts.astype(np.int64), every


def plain_tokens(texts: pa.Array, lowercase: bool) -> pa.Array:
    """The runs of ``SHORTEST`` and more ASCII letters, digits and underscores of every text, as lists; a missing text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    kept = np.zeros(256, np.uint8)  # what a byte becomes; 0 for those between tokens
    for char in b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        kept[char] = ord(chr(char).lower()) if lowercase else char
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    size = int(bounds[-1] - bounds[0])
    raw = kept[np.frombuffer(data, np.uint8, size, int(bounds[0]))] if size else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    word = raw != 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begins, ends = bounds[:-1][bounds[:-1] < size], bounds[1:][bounds[1:] > 0] - 1  # no token reaches into the next text
    first[begins], last[ends] = word[begins], word[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    for step in range(SHORTEST - 1):
        short = starts[stops - starts == step + 1]
        for at in range(step + 1):
            word[short + at] = False
    long = stops - starts >= SHORTEST
    starts, lengths = starts[long], (stops - starts)[long]
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.StringArray.from_buffers(lengths.size, pa.py_buffer(ends), pa.py_buffer(raw[word]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, bounds).astype(np.int32)), words)


def token_lists(plain: pa.Array, lists: pa.Array, lowercase: bool) -> pa.Array:
    """The tokens of every row: of its plain text, or the list where one is given."""
    if len(lists) == lists.null_count:
        return plain_tokens(plain, lowercase)
    rows = np.arange(len(lists))
    given = pc.is_valid(lists).to_numpy(zero_copy_only=False)
    both = pa.concat_arrays([plain_tokens(plain, lowercase), lists.cast(pa.list_(pa.string()))])
    return both.take(pa.array(np.where(given, rows + len(lists), rows)))


def term_list(plain: Column, tokens: Column, lowercase: bool, low: int, high: int) -> Column:
    """``(term, tf)`` of every distinct n-gram of a plain text, or of a token list where that is not null, as an array."""

    @F.arrow_udf("array<struct<term:string,tf:bigint>>")
    def count(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows, numbers, counts, terms = batch_terms(token_lists(texts, lists, lowercase), low, high)
        ends = np.searchsorted(rows, np.arange(len(lists) + 1)).astype(np.int32)
        cells = pa.StructArray.from_arrays([terms.take(pa.array(numbers)), pa.array(counts)], ["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(ends), cells)

    return count(plain, tokens)


def packed(columns: dict[str, pa.Array]) -> bytes:
    """Columns as compressed bytes, so that Spark moves them as one value."""
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(value, options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch()


def steps(numbers: np.ndarray) -> pa.Array:
    """Whole numbers that mostly rise a little, as what each is more than the one before; ``summed`` gives them back."""
    return pa.array(np.diff(numbers, prepend=0).astype(np.int32))


def summed(found: pa.Array) -> np.ndarray:
    return np.cumsum(found.to_numpy(), dtype=np.int64)


def term_numbers(terms: pa.Array) -> np.ndarray:
    """A number for every term, from its first and last eight bytes and its length."""
    terms = pc.fill_null(terms.cast(pa.string()), "")
    if not len(terms):
        return np.zeros(0, np.uint64)
    _, offsets, data = terms.buffers()
    ends = np.frombuffer(offsets, np.int32, len(terms) + 1, terms.offset * 4).astype(np.int64)
    starts, lengths = ends[:-1] - ends[0], np.diff(ends)
    raw = np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0])) if data is not None else np.zeros(0, np.uint8)
    edge = np.zeros(8, np.uint8)
    padded = np.concatenate([raw, edge])
    eights = np.ndarray((raw.size + 1,), "<u8", padded, strides=(1,))  # the eight bytes from every place on
    short = np.minimum(lengths, 8).astype(np.uint64)
    first = eights[starts] << (np.uint64(8) * (np.uint64(8) - np.maximum(short, np.uint64(1))))
    first = np.where(lengths > 0, first, np.uint64(0))
    last = np.where(lengths > 8, eights[np.maximum(starts + lengths - 8, 0)], np.uint64(0))
    mixed = first * np.uint64(0x9E3779B97F4A7C15) ^ (last + lengths.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def bucket_numbers(terms: pa.Array, buckets: int) -> np.ndarray:
    """A number below ``buckets`` for every term."""
    return (term_numbers(terms) % np.uint64(buckets)).astype(np.int64)


def bit_places(terms: pa.Array, power: int) -> list[np.ndarray]:
    """Two numbers below 2 ** ``power`` for every term."""
    numbers = term_numbers(terms)
    return [((numbers * np.uint64(odd)) >> np.uint64(64 - power)).astype(np.int64) for odd in (0x9E3779B97F4A7C15, 0xA24BAED4963EE407)]


def term_bits(table: DataFrame, terms: int) -> Broadcast:
    """Bits set at the places of every ``term`` of the table, and at few others' if it is not beyond ``MOST_BITS``."""
    spark = table.sparkSession
    power = min(max((terms * TERM_BITS).bit_length(), 10), MOST_BITS)
    size = (1 << power) // BIT_SLICES

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(bit_places(batch.column(0), power))
            yield pa.RecordBatch.from_arrays([pa.array(place // size), pa.array(place % size)], ["slice", "place"])

    def set_bits(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, bool)
        for batch in batches:
            found[batch.column("place").to_numpy()] = True
        bits = np.packbits(found, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([bits], pa.binary())], ["slice", "bits"])

    bits = np.zeros((BIT_SLICES, size // 8), np.uint8)
    rows = table.select("term").mapInArrow(places, "slice long, place long").groupBy("slice").applyInArrow(set_bits, "slice long, bits binary")
    for row in rows.collect():  # BIT_SLICES rows
        bits[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits.reshape(-1))


def may_be_set(bits: np.ndarray, terms: pa.Array) -> np.ndarray:
    """Whether the bits of every term are set."""
    places = bit_places(terms, bits.size.bit_length() + 2)
    return np.logical_and.reduce([(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1 for place in places])


def by_bucket(terms: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the terms by their buckets, and where in it each bucket begins, and the last one ends."""
    numbers = bucket_numbers(terms, buckets)
    return np.argsort(numbers, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(numbers, minlength=buckets))])


def list_counts(tokens: DataFrame, low: int, high: int, lowercase: bool = True, buckets: int = 16) -> DataFrame:
    """``(term, df)``: in how many of the token lists, the last column of ``tokens``, each n-gram occurs. A column of plain
    texts may stand before it, which counts where the list is null.

    The counts of a batch are shuffled as one packet for each of the ``buckets`` that the terms fall in, and a bucket is added up
    at once; there should be enough of them for the terms of a bucket to fit in a task.
    """
    with_texts = len(tokens.columns) > 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = token_lists(batch.column(0), batch.column(1), lowercase) if with_texts else batch.column(0)
            _, numbers, _, terms = batch_terms(lists, low, high)
            order, starts = by_bucket(terms, buckets)
            terms = terms.take(pa.array(order))
            found = pa.array(np.bincount(numbers, minlength=len(terms)).astype(np.int64)[order])
            used = np.flatnonzero(np.diff(starts))
            packets = [packed({"term": terms[starts[b]:starts[b + 1]], "df": found[starts[b]:starts[b + 1]]}) for b in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(packets, pa.binary())], ["bucket", "packet"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(packet.as_buffer()) for batch in batches for packet in batch.column("packet")]
        codes, terms = _encoded(pa.concat_arrays([part.column("term") for part in parts]))
        counts = np.concatenate([part.column("df").to_numpy() for part in parts])
        total = np.bincount(codes, counts, len(terms)).astype(np.int64)  # exact below 2 ** 53
        for at in range(0, len(terms), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([terms[at:at + OUT_ROWS], pa.array(total[at:at + OUT_ROWS])], ["term", "df"])

    return tokens.mapInArrow(count, "bucket long, packet binary").groupBy("bucket").applyInArrow(add, "term string, df long")
