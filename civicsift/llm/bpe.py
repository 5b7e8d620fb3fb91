"""Byte-level BPE encoding and decoding by pair occurrence indexes.

All pre-tokens of a batch that were not seen before are encoded together: an index maps every pair that
has a merge to the places where it occurs, the active merge of the lowest rank is applied to all its
places at once, and the pairs this makes or breaks update the affected lists. Known pre-tokens come from a
bounded cache. Texts and ids never leave their row, so nothing is shuffled.

Defined cases: a null text is encoded as an empty one, to no ids; null ids are decoded to an empty text.
Strings of added tokens inside a text become their ids. Ids without a token are skipped when decoding;
bytes that are no UTF-8 become U+FFFD. Repeated rows are encoded alike.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# The pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MARKS = frozenset(".,;:!?")

# These bound the memory of a Python worker.
CACHED_UNITS = 150_000
PENDING_UNITS = 100_000
SLICE_CHARS = 2_000_000
SLICE_IDS = 500_000


def byte_symbols() -> dict[str, int]:
    """Character -> byte in vocabulary files: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + number): byte for number, byte in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """Merges as sorted pair keys with ranks and results, and the bytes of every id."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    merged: np.ndarray  # by rank
    left: np.ndarray
    right: np.ndarray
    token_bytes: list[bytes | None]
    added: dict[str, int] = field(default_factory=dict)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All token bytes in one array, with the start and length of each id."""
        lengths = np.array([len(token or b"") for token in self.token_bytes], np.int64)
        flat = np.frombuffer(b"".join(token or b"" for token in self.token_bytes), np.uint8)
        return flat, np.cumsum(lengths) - lengths, lengths

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs without a merge."""
        keys = first.astype(np.int64) << 32 | second
        at = np.minimum(np.searchsorted(self.pair_keys, keys), max(self.pair_keys.size - 1, 0))
        if not self.pair_keys.size:
            return np.full(keys.shape, -1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE vocabulary file (JSON with ``model.vocab``, ``model.merges``, ``added_tokens``)."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    ids, symbols = content["model"]["vocab"], byte_symbols()
    merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in content["model"]["merges"]]
    left = np.array([ids[a] for a, _ in merges], np.int64)
    right = np.array([ids[b] for _, b in merges], np.int64)
    keys, first = np.unique(left << 32 | right, return_index=True)  # the first merge of a pair counts
    added = {token["content"]: token["id"] for token in content.get("added_tokens", [])}
    token_bytes: list[bytes | None] = [None] * (max([*ids.values(), *added.values()]) + 1)
    for token, number in ids.items():
        token_bytes[number] = bytes(symbols[char] for char in token)
    for token, number in added.items():
        token_bytes[number] = token.encode()
    return Vocabulary(
        byte_ids=np.array([ids[char] for char, _ in sorted(symbols.items(), key=lambda item: item[1])], np.int32),
        pair_keys=keys, pair_ranks=first, left=left, right=right,
        merged=np.array([ids[a + b] for a, b in merges], np.int32), token_bytes=token_bytes, added=added)


class PairIndex:
    """Symbols of many pre-tokens in one row of places, and the places of every pair that can be merged."""

    def __init__(self, vocabulary: Vocabulary, pieces: list[bytes]) -> None:
        lengths = np.array([len(piece) for piece in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        self.vocabulary = vocabulary
        self.symbols = vocabulary.byte_ids[raw]
        self.alive = np.ones(raw.size, bool)
        self.next = np.arange(1, raw.size + 1, dtype=np.int32)
        self.previous = np.arange(-1, raw.size - 1, dtype=np.int32)
        ends = np.cumsum(lengths)[lengths > 0]
        self.next[ends - 1] = -1
        self.previous[ends - lengths[lengths > 0]] = -1
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._index(np.flatnonzero(self.next >= 0))

    def _index(self, places: np.ndarray) -> None:
        """Enter the pairs that start at ``places``."""
        ranks = self.vocabulary.ranks(self.symbols[places], self.symbols[self.next[places]])
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        if not places.size:
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        for rank, group in zip(ranks[starts].tolist(), np.split(places, starts[1:]), strict=True):
            if rank in self.places:
                self.places[rank].append(group)
            else:
                self.places[rank] = [group]
                heapq.heappush(self.active, rank)

    def merge_all(self) -> None:
        """Apply active ranks in ascending order until no pair has a merge."""
        while self.active:
            rank = heapq.heappop(self.active)
            lists = self.places.pop(rank)
            self._merge(rank, lists[0] if len(lists) == 1 else _distinct(np.concatenate(lists)))

    def _merge(self, rank: int, places: np.ndarray) -> None:
        left, right = self.vocabulary.left[rank], self.vocabulary.right[rank]
        after = self.next[places]
        valid = self.alive[places] & (after >= 0) & (self.symbols[places] == left)
        places, after = places[valid], after[valid]
        valid = self.symbols[after] == right
        places, after = places[valid], after[valid]
        if left == right and places.size > 1:  # of overlapping pairs in a run every other one, from the left
            new_run = np.concatenate([[True], after[:-1] != places[1:]])
            starts = np.flatnonzero(new_run)
            offset = np.arange(places.size) - np.repeat(starts, np.diff(np.append(starts, places.size)))
            places, after = places[offset % 2 == 0], after[offset % 2 == 0]
        if not places.size:
            return
        self.symbols[places] = self.vocabulary.merged[rank]
        self.alive[after] = False
        beyond = self.next[after]
        self.next[places] = beyond
        self.previous[beyond[beyond >= 0]] = places[beyond >= 0]
        before = self.previous[places]
        touched = np.concatenate([before[before >= 0], places[beyond >= 0]])
        self._index(_distinct(touched))

    def results(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        lengths = np.array([len(piece) for piece in pieces], np.int64)
        before = np.concatenate([[0], np.cumsum(self.alive)])
        ends = np.cumsum(lengths)
        return self.symbols[self.alive], before[ends] - before[ends - lengths]


class Encoder:
    """Encodes texts with a cache of units: stretches of text that are pre-tokenised on their own.

    A space followed by no white space always opens a pre-token, so a text without other spaces is cut there.
    """

    class _Units(dict):
        def __init__(self, owner: Encoder, prefix: str) -> None:
            self.owner, self.prefix = owner, prefix

        def __missing__(self, unit: str) -> int:
            code = self.owner.known + len(self.owner.pending)
            self.owner.pending.append(self.prefix + unit)
            self[unit] = code
            return code

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.pattern = regex.compile(PRE_TOKEN)
        self.odd_space = re.compile(r" (?:\s|\Z)")
        parts = sorted(vocabulary.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, parts)) + ")") if parts else None
        self._empty()

    def _empty(self) -> None:
        self.plain, self.spaced = self._Units(self, ""), self._Units(self, " ")
        self.pending: list[str] = []
        self.known = len(self.vocabulary.added)
        ids = list(self.vocabulary.added.values())
        self.flat, self.starts, self.lengths = np.array(ids, np.int32), np.arange(len(ids)), np.ones(len(ids), np.int64)
        self.added_codes = {token: code for code, token in enumerate(self.vocabulary.added)}

    def _codes(self, text: str) -> np.ndarray:
        """The unit codes of a text."""
        if self.added is None or not self.added.search(text):
            return self._segment(text)
        parts = [np.array([self.added_codes[part]]) if part in self.added_codes else self._segment(part)
                 for part in self.added.split(text)]
        return np.concatenate(parts)

    def _segment(self, text: str) -> np.ndarray:
        if self.odd_space.search(text):
            units = self.pattern.findall(text)
            return np.fromiter(map(self.plain.__getitem__, units), np.int64, len(units))
        units = text.split(" ")
        codes = np.empty(len(units), np.int64)
        codes[1:] = np.fromiter(map(self.spaced.__getitem__, islice(units, 1, None)), np.int64, len(units) - 1)
        if not units[0]:
            return codes[1:]
        codes[0] = self.plain[units[0]]
        return codes

    def _tokens(self, unit: str) -> list[str]:
        """The pre-tokens of a unit; the pattern is only needed beyond a word and one mark after it."""
        word = unit[1:] if unit[0] == " " else unit
        if word.isalpha():
            return [unit]
        if word[-1:] in _MARKS and word[:-1].isalpha():
            return [unit[:-1], unit[-1]]
        return self.pattern.findall(unit)

    def _settle(self) -> None:
        """Encode the units that are pending."""
        if not self.pending:
            return
        tokens = [self._tokens(unit) for unit in self.pending]
        pieces = [token.encode() for unit in tokens for token in unit]
        index = PairIndex(self.vocabulary, pieces)
        index.merge_all()
        ids, counts = index.results(pieces)
        owners = np.repeat(np.arange(len(tokens)), [len(unit) for unit in tokens])
        lengths = np.bincount(owners, weights=counts, minlength=len(tokens)).astype(np.int64)
        self.starts = np.concatenate([self.starts, self.flat.size + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])
        self.known += len(self.pending)
        self.pending = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where the ids of each text end."""
        if self.known > CACHED_UNITS:
            self._empty()
        codes, sizes = [], []
        for text in texts:
            found = self._codes(text or "")
            codes.append(found)
            sizes.append(found.size)
            if len(self.pending) >= PENDING_UNITS:
                self._settle()
        self._settle()
        units = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        lengths = self.lengths[units]
        ends = np.cumsum(lengths)
        ids = self.flat[_ranges(self.starts[units], lengths)]
        unit_ends = np.cumsum(np.array(sizes, np.int64))
        return ids, np.concatenate([[0], ends])[unit_ends]


def _distinct(places: np.ndarray) -> np.ndarray:
    """The places in order, each once."""
    places = np.sort(places)
    return places[np.concatenate([[True], places[1:] != places[:-1]])] if places.size else places


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start .. start + length`` of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if ends.size else 0)


def _slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to about ``limit`` at most, one row at least."""
    start = total = 0
    for at, size in enumerate(sizes):
        if at > start and total + size > limit:
            yield start, at
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def encode(text: Column, vocabulary: Vocabulary) -> Column:
    """The ids of a text as an ``array<int>`` column."""

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_pylist()
            yield _lists([encoder.encode(batch.slice(a, b - a).to_pylist()) for a, b in _slices(sizes, SLICE_CHARS)])

    return encoded.asNondeterministic()(text)


def round_trip(text: Column, vocabulary: Vocabulary) -> Column:
    """``struct<ids: array<int>, text: string>``: the ids of a text and what they decode to, by one Python worker."""

    @F.arrow_udf("struct<ids:array<int>,text:string>")
    def there_and_back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_pylist()
            ids = _lists([encoder.encode(batch.slice(a, b - a).to_pylist()) for a, b in _slices(sizes, SLICE_CHARS)])
            yield pa.StructArray.from_arrays([ids, decode_lists(vocabulary, ids)], ["ids", "text"])

    return there_and_back.asNondeterministic()(text)


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ids = np.concatenate([ids for ids, _ in parts]) if parts else np.zeros(0, np.int32)
    offsets, shift = [np.zeros(1, np.int64)], 0
    for part, ends in parts:
        offsets.append(ends + shift)
        shift += part.size
    return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(ids, pa.int32()))


def decode_lists(vocabulary: Vocabulary, lists: pa.Array) -> pa.Array:
    """The texts of lists of ids."""
    flat, starts, lengths = vocabulary.table
    out: list[pa.Array] = []
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for begin, end in _slices(counts.tolist(), SLICE_IDS):
        ids = lists.slice(begin, end - begin).flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        inner = np.cumsum(counts[begin:end])
        known = (ids >= 0) & (ids < lengths.size)
        size = np.where(known, lengths[np.where(known, ids, 0)], 0)
        raw = flat[_ranges(starts[np.where(known, ids, 0)], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], inner])]
        texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        out.append(pa.array(texts, pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of an ``array<int>`` column of ids."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield decode_lists(vocabulary, batch)

    return decoded.asNondeterministic()(ids)
