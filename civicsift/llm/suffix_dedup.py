"""Exact removal of byte strings that also start in a document with a smaller id, by suffix sorting.

Every string of ``LENGTH`` bytes has a key: the least hash of the short grams in it. Equal strings have equal
keys, and neighbouring strings mostly share theirs, so documents fall into segments of one key each. Jobs:

1. keys: each group of rows (one Parquet row group) sends its keys, cut to a few bytes, to buckets, which
   send back those that other groups have too;
2. segments: only segments whose key occurs more than once go on, dealt by key to shards. Of equal segments
   in a group only those with the smallest id are sent, the others are repeated as a whole;
3. suffixes: each shard sorts the suffixes of its segments by external induced sorting
   (``induced_sort``) and finds the strings that have a smaller id in their group of equals;
4. texts: the runs found go back to the groups, whose rows are cut.

Groups read what was sent back from files of the shared folder, so no text is ever shuffled but that of
segments with repeated keys. Documents that equal one with a smaller id as a whole are
found by their digests first and take no part in 1 to 3.

Defined cases: a null text counts as empty; texts under ``LENGTH`` bytes lose nothing. A null id counts as larger
than all others. Rows with equal ids do not remove from each other. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicsift.llm.exchange import (
    MOST_COUNTED,
    codes_of,
    emit,
    known_codes,
    mixed,
    pack,
    placed,
    ranges,
    raw_rows,
    read_file,
    send_back,
    send_keys,
    shared_codes,
    slices,
    string_hashes,
    with_copies,
)
from civicsift.llm.induced_sort import groups as equal_strings
from civicsift.session import materialise, scratch_path

LENGTH = 50
GRAM = 16  # a power of two; longer grams repeat less by chance, shorter ones give longer segments
KEYS_PER_BUCKET = 1 << 20
BYTES_PER_SHARD = 5 << 19

_BASE = 0x9E3779B97F4A7C15


def segments(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of positions whose strings share a key, in texts laid end to end.

    Returns the key, the number of the text, the place in ``raw`` and the number of positions of each run.
    """
    size = raw.size - LENGTH + 1
    if size <= 0:
        return tuple(np.zeros(0, kind) for kind in (np.uint64, np.int64, np.int64, np.int64))
    hashes, width, factor = raw.astype(np.uint64) + np.uint64(1), 1, _BASE
    while width < GRAM:
        hashes = hashes[:-width] * np.uint64(factor) + hashes[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    hashes = mixed(hashes)
    window, width = LENGTH - GRAM + 1, 1
    least = hashes
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:size], least[window - width:window - width + size])
    owner = np.repeat(np.arange(lengths.size), lengths)
    ends = np.cumsum(lengths)
    inside = owner[:size] == owner[LENGTH - 1:]
    change = np.ones(size, bool)
    change[1:] = (least[1:] != least[:-1]) | (owner[1:size] != owner[:size - 1]) | ~inside[:-1]
    begin = np.flatnonzero(change & inside)
    text = owner[begin]
    stop = np.minimum(np.append(begin, size)[1:], ends[text] - LENGTH + 1)
    return least[begin], text, begin, stop - begin


_PART = np.dtype([("row", np.int32), ("start", np.int32), ("count", np.int32), ("id", np.int64), ("hash", np.uint64)])
_RUN = np.dtype([("row", np.int32), ("start", np.int32), ("count", np.int32)])


def _later(parts: np.ndarray) -> np.ndarray:
    """Whether an equal segment has a smaller id."""
    order = np.lexsort((parts["id"], parts["hash"]))
    hashes, ids = parts["hash"][order], parts["id"][order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if order.size else np.zeros(0, np.int64)
    first = np.repeat(ids[starts], np.diff(np.append(starts, order.size)))
    later = np.zeros(order.size, bool)
    later[order] = ids > first
    return later


def _runs(parts: np.ndarray) -> bytes:
    out = np.empty(parts.size, _RUN)
    for name in _RUN.names:
        out[name] = parts[name]
    return pack(out.tobytes())


def send_segments(bodies: DataFrame, folder: str, bits: int, shards: int) -> DataFrame:
    """``shard, group, sent``: packed segments with repeated keys; shard -1 holds runs that are repeated as a whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known, found, texts = None, np.zeros(0, np.uint64), [], []

        def finish() -> pa.RecordBatch:
            parts = np.concatenate([np.zeros(0, _PART), *(p for p, _ in found)])
            keys = np.concatenate([np.zeros(0, np.uint64), *(k for _, k in found)])
            text = np.concatenate([np.zeros(0, np.uint8), *texts])
            found.clear()
            texts.clear()
            sizes = parts["count"].astype(np.int64) + LENGTH - 1
            begins = np.cumsum(sizes) - sizes
            later = _later(parts)
            rows = [(-1, current, _runs(parts[later]))]
            sent = np.flatnonzero(~later)
            shard = (mixed(keys[sent]) % np.uint64(shards)).astype(np.int64)
            sent = sent[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            pack = zstandard.ZstdCompressor(level=3)
            for begin, end in zip(starts, np.append(starts, shard.size)[1:], strict=True):
                own = sent[begin:end]
                body = parts[own].tobytes() + text[ranges(begins[own], sizes[own])].tobytes()
                rows.append((int(shard[begin]), current, own.size.to_bytes(8, "little") + pack.compress(body)))
            return emit(rows, ["shard", "group", "sent"], [pa.int64(), pa.string(), pa.binary()])

        for group, number, piece in slices(batches):
            if group != current:
                if current is not None:
                    yield finish()
                current, found, texts = group, [], []
                known, _ = known_codes(folder, group)
            rows, lengths, raw = raw_rows(piece)
            key, text, begin, count = segments(raw, lengths)
            code = codes_of(key, bits)
            hit = np.zeros(code.size, bool) if not known.size else known[
                np.minimum(np.searchsorted(known, code), known.size - 1)] == code
            key, text, begin, count = key[hit], text[hit], begin[hit], count[hit]
            if not key.size:
                continue
            parts = np.empty(key.size, _PART)
            parts["row"] = number + rows[text]
            parts["start"] = begin - (np.cumsum(lengths) - lengths)[text]
            parts["count"] = count
            parts["id"] = piece.column("order_id").to_numpy()[rows[text]]
            parts["hash"] = string_hashes(raw, begin, count + LENGTH - 1)
            found.append((parts, key))
            texts.append(raw[ranges(begin, count + LENGTH - 1)])
        if current is not None:
            yield finish()

    return bodies.mapInArrow(work, "shard long, group string, sent binary")


def repeated_positions(parts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Runs of positions in segments whose string has a smaller id elsewhere; ``row`` is the segment's number.

    ``text`` holds the segments' bytes end to end.
    """
    sizes = parts["count"].astype(np.int64) + LENGTH - 1
    if not sizes.size:
        return np.zeros(0, _RUN)
    begins = np.cumsum(sizes + 1) - sizes  # every segment is followed by a mark, the first one preceded by one
    marked = np.zeros(int(begins[-1] + sizes[-1]) + 1, np.uint8)
    marked[ranges(begins, sizes)] = text + np.uint8(1)
    repeated = np.zeros(marked.size, bool)
    for places, numbers in equal_strings(marked, LENGTH):
        owner = np.searchsorted(begins, places, side="right") - 1
        whole = places - begins[owner] < parts["count"][owner]
        places, numbers, ids = places[whole], numbers[whole], parts["id"][owner[whole]]
        if not places.size:
            continue
        starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        least = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, ids.size)))
        repeated[places[ids > least]] = True
    edges = np.diff(repeated.astype(np.int8))
    start, stop = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    owner = np.searchsorted(begins, start, side="right") - 1
    runs = np.empty(start.size, _RUN)
    runs["row"], runs["start"], runs["count"] = owner, start - begins[owner], stop - start
    return runs


def _sort_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of one shard's segments that are repeated, for each group."""
    unpack = zstandard.ZstdDecompressor()
    heads, texts = [], []
    for sent in rows["sent"]:
        count = int.from_bytes(sent[:8], "little")
        body = unpack.decompress(sent[8:])
        heads.append(np.frombuffer(body, _PART, count))
        texts.append(np.frombuffer(body, np.uint8, offset=count * _PART.itemsize))
    group = np.repeat(np.arange(len(heads)), [head.size for head in heads])
    parts, text = np.concatenate(heads), np.concatenate(texts)
    del texts
    later = _later(parts)
    sizes = parts["count"].astype(np.int64) + LENGTH - 1
    sorted_parts = np.flatnonzero(~later)
    text = text[ranges((np.cumsum(sizes) - sizes)[sorted_parts], sizes[sorted_parts])]
    runs = repeated_positions(parts[sorted_parts], text)
    segment = sorted_parts[runs["row"]]
    runs["start"] += parts["start"][segment]
    runs["row"] = parts["row"][segment]
    out = []
    for number in range(len(heads)):
        out.append(_runs(parts[later & (group == number)]) + _runs(runs[group[segment] == number]))
    return pd.DataFrame({"group": rows["group"], "sent": out})


def spans_of(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Maximal byte ranges covered by the strings that start in runs of positions; rows of start and end."""
    order = np.argsort(starts, kind="stable")
    begin = starts[order].astype(np.int64)
    reach = np.maximum.accumulate(begin + counts[order] + LENGTH - 1) if begin.size else begin
    fresh = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]])) if begin.size else np.zeros(0, np.int64)
    return np.stack([begin[fresh], reach[np.append(fresh, begin.size)[1:] - 1]], axis=1) if begin.size else np.zeros((0, 2), np.int64)


def cut_texts(bodies: DataFrame, folder: str) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the removed byte ranges of each row, and its other bytes."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, runs = None, np.zeros(0, _RUN)
        for group, number, piece in slices(batches):
            if group != current:
                current = group
                runs = np.frombuffer(read_file(folder, group, "runs"), _RUN)
                runs = runs[np.argsort(runs["row"], kind="stable")]
            bounds = np.searchsorted(runs["row"], np.arange(number, number + piece.num_rows + 1))
            spans, kept = [], []
            copies = piece.column("copy").to_pylist()
            for row, body in enumerate(piece.column("body").to_pylist()):
                own = runs[bounds[row]:bounds[row + 1]]
                gone = spans_of(own["start"], own["count"]).tolist()
                if copies[row] and len(body) >= LENGTH:
                    gone = [[0, len(body)]]
                edges = [0, *(edge for pair in gone for edge in pair), len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("size"), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"])

    return bodies.mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` per row of ``docs``."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "suffixes")
    stored, size = with_copies(docs, id_column, text_column)
    bodies = placed(stored)
    bits = max(0, math.ceil(math.log2(max(1, size / 15 / KEYS_PER_BUCKET))))  # about 18 positions share a key
    shards = max(1, math.ceil(size / BYTES_PER_SHARD))

    keys = materialise(send_keys(bodies, bits, lambda raw, lengths: segments(raw, lengths)[0]), "keys")
    shared = keys.filter("bucket >= 0").groupBy("bucket").applyInPandas(
        shared_codes(MOST_COUNTED), "group string, sent binary, hot long").drop("hot")
    send_back(keys.filter("bucket < 0").select("group", "sent").unionByName(shared), folder, "keys")

    parts = materialise(send_segments(bodies, folder, bits, shards), "segments")
    sorted_runs = parts.filter("shard >= 0").groupBy("shard").applyInPandas(_sort_shard, "group string, sent binary")
    send_back(parts.filter("shard < 0").select("group", "sent").unionByName(sorted_runs), folder, "runs")
    return cut_texts(bodies, folder)
