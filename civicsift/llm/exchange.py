"""Exchange of keys among groups of rows without shuffling their texts.

A group is one Parquet row group of a table written by ``with_copies``. Groups send small packed lists to
buckets; what comes back is written to one file per group in the shared folder, under a name its
readers know. A repeated task writes the same file again, and a missing one is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicsift.llm.common import named, text_or_empty
from civicsift.llm.exact_dedup import filter_bits, mark_repeats, repeat_filter
from civicsift.operators.prefix import spread_lookup
from civicsift.session import materialise

SLICE_BYTES = 1 << 19
NO_ID = (1 << 63) - 1
HOT = np.uint64(1 << 63)  # marks codes that come back as hot
MOST_COUNTED = (1 << 16) - 1  # occurrences of a code in one group are counted up to here

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = 0xD6E8FEB86659FD93


def mixed(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(_MIX)
    return (values ^ values >> np.uint64(32)) * np.uint64(_MIX)


_KNOWN_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # a plain table: cached functions travel by name only


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _KNOWN_POWERS:
        if len(_KNOWN_POWERS) > 1:
            _KNOWN_POWERS.clear()
        _KNOWN_POWERS[size] = (np.cumprod(np.full(size, _BASE, np.uint64)), np.cumprod(np.full(size, _INVERSE, np.uint64)))
    return _KNOWN_POWERS[size]


def string_hashes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on."""
    powers, back = _powers(1 << max(raw.size - 1, 0).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:raw.size])])
    return mixed((sums[begin + size] - sums[begin]) * back[begin] + size.astype(np.uint64))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if ends.size else 0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Pieces of at most about ``SLICE_BYTES`` of one group, with the number of their first row in it."""
    group, number = None, 0
    for batch in batches:
        names = batch.column("group").to_pylist()
        sizes = batch.column("size").to_pylist()
        start = total = 0
        for at in range(len(names) + 1):
            ends = at == len(names) or names[at] != names[start]
            if at > start and (ends or total + sizes[at] > SLICE_BYTES):
                if names[start] != group:
                    group, number = names[start], 0
                yield group, number, batch.slice(start, at - start)
                number += at - start
                start, total = at, 0
            if at < len(names):
                total += sizes[at]


def raw_rows(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a piece that are no copies: their numbers, lengths, and bytes end to end."""
    rows = np.flatnonzero(~piece.column("copy").to_numpy(zero_copy_only=False))
    bodies = [piece.column("body")[int(row)].as_py() for row in rows]
    return rows, np.array([len(body) for body in bodies], np.int64), np.frombuffer(b"".join(bodies), np.uint8)


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def _file(folder: str, group: str, kind: str) -> tuple[fs.FileSystem, str]:
    store, at = store_of(folder)
    return store, f"{at}/{group}.{kind}"


def pack(data: bytes) -> bytes:
    """Compressed form of a list that is sent back; packed lists may be laid end to end."""
    body = zstandard.ZstdCompressor(level=1).compress(data)
    return len(body).to_bytes(8, "little") + body


def unpack(packed: bytes) -> bytes:
    """The lists of all packed ones, end to end."""
    out, at, reader = [], 0, zstandard.ZstdDecompressor()
    while at < len(packed):
        size = int.from_bytes(packed[at:at + 8], "little")
        out.append(reader.decompress(packed[at + 8:at + 8 + size]))
        at += 8 + size
    return b"".join(out)


def read_file(folder: str, group: str, kind: str) -> bytes:
    store, path = _file(folder, group, kind)
    with store.open_input_file(path) as file:
        return unpack(file.read())


def send_back(rows: DataFrame, folder: str, kind: str) -> None:
    """Write what ``rows`` (``group, sent``, packed) hold for each group to a file that its readers find by name."""

    def write(parts: pd.DataFrame) -> pd.DataFrame:
        group = parts["group"].iloc[0]
        store, path = _file(folder, group, kind)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        own = f"{path}-{uuid.uuid4().hex}"
        with store.open_output_stream(own, compression=None) as out:
            for sent in parts["sent"]:
                out.write(sent)
        store.move(own, path)
        return pd.DataFrame({"group": [group]})

    materialise(rows.groupBy("group").applyInPandas(write, "group string"), f"written-{kind}")


def emit(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def codes_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The leading ``bits + 32`` bits of keys: bucket and what is compared in it."""
    return keys >> np.uint64(32 - bits)


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of lists of codes and counts, and the sums of their counts."""
    codes, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *(c for c, _ in found)]), return_inverse=True)
    weights = np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
    return codes, np.bincount(inverse, weights, codes.size).astype(np.int64)


def send_keys(bodies: DataFrame, bits: int, keys_in: Callable[..., np.ndarray],
              given: Callable[[str], object] | None = None) -> DataFrame:
    """``bucket, group, sent, counts``: distinct key codes by bucket and how often each occurs in the group; bucket -1
    holds nothing and stands for the group. With ``given``, what it gives for a group goes to ``keys_in`` too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found, more = None, [], ()

        def finish() -> pa.RecordBatch:
            codes, counts = _summed(found)
            counts = np.minimum(counts, MOST_COUNTED).astype(np.uint16)
            rows = [(-1, current, b"", b"")]
            buckets = (codes >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.diff(buckets, prepend=-1))
            for begin, end in zip(starts, np.append(starts, codes.size)[1:], strict=True):
                rows.append((int(buckets[begin]), current, codes[begin:end].astype(np.uint32).tobytes(),
                             pack(counts[begin:end].tobytes())))
            return emit(rows, ["bucket", "group", "sent", "counts"], [pa.int64(), pa.string(), pa.binary(), pa.binary()])

        for group, _, piece in slices(batches):
            if group != current:
                if current is not None:
                    yield finish()
                current, found = group, []
                more = () if given is None else (given(group),)
            _, lengths, raw = raw_rows(piece)
            found.append(np.unique(codes_of(keys_in(raw, lengths, *more), bits), return_counts=True))
        if current is not None:
            yield finish()

    return bodies.mapInArrow(work, "bucket long, group string, sent binary, counts binary")


def shared_codes(hot: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For each group those of its codes of a bucket that occur more than once anywhere; the ones that occur at least
    ``hot`` times are marked with ``HOT``. ``hot`` is at most ``MOST_COUNTED``."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = np.uint64(rows["bucket"].iloc[0] << 32)
        lists = [np.frombuffer(sent, np.uint32) for sent in rows["sent"]]
        counts = [np.frombuffer(unpack(packed), np.uint16) for packed in rows["counts"]]
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        every = every[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if every.size else np.zeros(0, np.int64)
        sums = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), starts) if every.size else starts
        repeated, often = every[starts][sums > 1], sums[sums > 1] >= hot

        def shared(codes: np.ndarray) -> bytes:
            hit, at = lookup(repeated, codes)
            return pack((codes[hit].astype(np.uint64) | bucket | np.where(often[at[hit]], HOT, np.uint64(0))).tobytes())

        return pd.DataFrame({"group": rows["group"], "sent": [shared(codes) for codes in lists],
                             "hot": [int(often.sum())] * len(lists)})

    return work


def lookup(known: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code is among the sorted ``known``, and where."""
    if not known.size:
        return np.zeros(codes.size, bool), np.zeros(codes.size, np.int64)
    at = np.minimum(np.searchsorted(known, codes), known.size - 1)
    return known[at] == codes, at


def known_codes(folder: str, group: str, kind: str = "keys") -> tuple[np.ndarray, np.ndarray]:
    """The codes that came back to a group, ascending, and whether each is hot."""
    marked = np.unique(np.frombuffer(read_file(folder, group, kind), np.uint64))
    codes = marked & ~HOT
    order = np.argsort(codes, kind="stable")
    return codes[order], (marked >= HOT)[order]


def with_copies(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    """The rows with their bytes, and whether a row with a smaller id has the same; the bytes of all rows."""
    body = F.encode(text_or_empty(named(docs, text_column)), "UTF-8")
    rows = docs.select(named(docs, id_column).cast("long").alias("id"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    rows = rows.withColumn("order_id", F.coalesce("id", F.lit(NO_ID)))
    digests = materialise(rows.select("digest", "order_id", F.octet_length("body").alias("size")), "text-digests")
    total, size = digests.agg(F.count(F.lit(1)), F.sum("size")).first()
    bits = filter_bits(total)
    words = materialise(repeat_filter(digests, "digest", bits), "text-filter")
    n_words = words.count()
    firsts = (mark_repeats(digests, "digest", words, n_words, bits).filter("maybe_repeated")
              .groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min("order_id").alias("first"))
              .filter("rows > 1"))
    marked = mark_repeats(rows, "digest", words, n_words, bits)
    looked_up = spread_lookup(marked.filter("maybe_repeated").drop("maybe_repeated"), firsts, "digest", "rows", total,
                              spread_on=["id"])
    checked = looked_up.withColumn("copy", F.coalesce(F.col("order_id") > F.col("first"), F.lit(False)))
    single = marked.filter(~F.col("maybe_repeated")).drop("maybe_repeated").withColumns(
        {"copy": F.lit(False), "first": F.lit(None).cast("long")})
    out = single.unionByName(checked).select(
        "id", "order_id", "body", F.octet_length("body").cast("long").alias("size"), "copy", "first")
    return materialise(out, "bodies"), size or 0




def placed(stored: DataFrame) -> DataFrame:
    """The rows of ``with_copies`` with the ``group`` they lie in."""
    file = F.when(F.input_file_name() == "", F.raise_error(F.lit("rows do not tell which file they come from")))
    place = F.xxhash64(F.coalesce(file.cast("string"), F.input_file_name()), F.input_file_block_start())
    return stored.select(place.cast("string").alias("group"), "id", "order_id", "body", "size", "copy")
