"""Groups of positions with equal strings of a fixed length, found by external induced sorting.

The text of a shard is sorted by what follows each position, up to ``depth`` bytes. Suffixes whose byte is smaller
than the one before and not larger than the one after are sorted first, by their leading bytes, with the lengths
of their common prefixes; all others are induced. Priority queues, one run of (position, common prefix) tuples per
leading byte, give out the smallest byte first (then the largest, in the second scan) and take in what each tuple
induces for the position before it; the common prefix is carried along as one more than the least
value since the last tuple that went into the same run. Runs beyond a memory bound go to a temporary file that
has no name and vanishes with the process. As suffixes are told apart by ``depth`` bytes only, the
recursion that sorts the first kind needs no more than ``depth`` bytes of each.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

RUN_BYTES = 64 << 20  # of all runs of a queue together that stay in memory
HIGHEST = 246  # bytes of UTF-8 end at 244; 0 is the mark between strings, so bytes are stored plus 1


class RunQueue:
    """A priority queue of (position, common prefix) tuples by leading byte, first in first out within a byte."""

    def __init__(self, descending: bool = False, memory: int = RUN_BYTES) -> None:
        self.sign = -1 if descending else 1
        self.memory = memory
        self.held = 0
        self.active: list[int] = []
        self.runs: dict[int, list[tuple[np.ndarray, np.ndarray] | tuple[int, int]]] = {}
        self.file = None

    def push(self, byte: int, places: np.ndarray, common: np.ndarray) -> None:
        if byte not in self.runs:
            self.runs[byte] = []
            heapq.heappush(self.active, self.sign * byte)
        if self.held + places.nbytes + common.nbytes > self.memory:
            self.runs[byte].append(self._spill(places, common))
        else:
            self.held += places.nbytes + common.nbytes
            self.runs[byte].append((places, common))

    def _spill(self, places: np.ndarray, common: np.ndarray) -> tuple[int, int]:
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(places.astype(np.int32).tobytes())
        self.file.write(common.astype(np.int8).tobytes())
        return at, places.size

    def lowest(self) -> int | None:
        """The byte whose run is next, if any."""
        return self.sign * self.active[0] if self.active else None

    def pop(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The next byte and all tuples its run holds now."""
        byte = self.sign * heapq.heappop(self.active)
        parts = []
        for part in self.runs.pop(byte):
            if isinstance(part[0], int):
                self.file.seek(part[0])
                places = np.frombuffer(self.file.read(4 * part[1]), np.int32)
                part = places, np.frombuffer(self.file.read(part[1]), np.int8)
            else:
                self.held -= part[0].nbytes + part[1].nbytes
            parts.append(part)
        return byte, np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])


class _Carried:
    """The least common prefix since the last tuple that went to each byte's run."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.least = np.full(256, -1, np.int8)

    def induce(self, queue: RunQueue, places: np.ndarray, common: np.ndarray, bytes_before: np.ndarray,
               wanted: np.ndarray) -> None:
        """Push the positions before ``places`` that are ``wanted``, with their common prefixes."""
        order = np.flatnonzero(wanted)
        order = order[np.argsort(bytes_before[order], kind="stable")]
        sorted_bytes = bytes_before[order].astype(np.int16)
        starts = np.flatnonzero(np.diff(sorted_bytes, prepend=-1))
        untouched = np.minimum(self.least, common.min()) if common.size else self.least
        for begin, end in zip(starts, np.append(starts, order.size)[1:], strict=True):
            byte, at = int(sorted_bytes[begin]), order[begin:end]
            cuts = np.concatenate([[0], at + 1])
            rest = self.depth
            if cuts[-1] == common.size:
                cuts = cuts[:-1]
                least = np.minimum.reduceat(common, cuts)
            else:
                least = np.minimum.reduceat(common, cuts)
                least, rest = least[:-1], least[-1]
            least[0] = min(least[0], self.least[byte])
            queue.push(byte, places[at] - 1, np.minimum(least + 1, self.depth).astype(np.int8))
            untouched[byte] = rest
        self.least = untouched


def _rising(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than the one after it."""
    step = np.zeros(text.size, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    changes = np.flatnonzero(step)
    return np.repeat(step[changes], np.diff(changes, prepend=-1)) > 0


def _same_byte_run(text: np.ndarray, depth: int) -> np.ndarray:
    """How often the byte at each position repeats from there on, ``depth`` at most."""
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), text.size - 1)
    lengths = np.diff(ends, prepend=-1)
    left = np.repeat(ends, lengths) - np.arange(text.size) + 1
    return np.minimum(left, depth).astype(np.int8)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, the first byte highest."""
    word = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        word[:-width] = word[:-width] << np.uint64(8 * width) | word[width:]
    return word[:text.size]


def _sort_leading(text: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``places`` sorted by their first ``depth`` bytes, and their common prefixes with the one before.

    Rounds of eight bytes; only suffixes that are still equal to a neighbour go on to the next round.
    """
    common = np.full(places.size, depth, np.int8)
    if not places.size:
        return places, common
    words = _words(text)
    marks = np.flatnonzero(text == 0)
    order = places.copy()
    left = (marks[np.searchsorted(marks, places)] - places).astype(np.int32)  # bytes up to the mark
    upper = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], np.uint64)
    tied = np.arange(places.size)  # where in ``order`` the suffixes lie that are equal so far
    group = np.zeros(places.size, np.int64)
    for offset in range(0, depth, 8):
        at, rest = order[tied], left[tied]
        word = words[np.minimum(at + offset, text.size - 1)] & upper[np.clip(rest - offset, 0, 8)]
        by_word = np.argsort(word)
        sorted_words = word[by_word]
        rank = np.empty(word.size, np.int64)
        rank[by_word] = np.cumsum(np.concatenate([[False], sorted_words[1:] != sorted_words[:-1]]))
        turn = np.argsort(group << 32 | rank)
        order[tied], left[tied] = at[turn], rest[turn]
        word = word[turn]
        same_group = group[1:] == group[:-1]
        differ = word[1:] ^ word[:-1]
        fresh = np.flatnonzero(same_group & (differ != 0))
        equal_bytes = sum((differ[fresh] < np.uint64(1 << (64 - 8 * k))).astype(np.int8) for k in range(1, 8))
        common[tied[fresh + 1]] = np.minimum(offset + equal_bytes, depth)
        equal = same_group & (differ == 0)
        group = np.cumsum(np.concatenate([[False], ~equal]))
        go_on = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
        tied, group = tied[go_on], group[go_on]
        if not tied.size:
            break
    common[0] = 0
    return order, common


def sorted_suffixes(text: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All positions of ``text`` but its marks, largest suffix first, with their common prefix with the one before.

    ``text`` holds bytes plus 1, begins and ends with the mark 0, and has one between strings. Suffixes that
    agree in ``depth`` bytes, or up to their mark, come in any order with a common prefix of ``depth``.
    """
    rising = _rising(text)
    same = _same_byte_run(text, depth)
    valley = (np.flatnonzero(rising[1:] & ~rising[:-1]) + 1).astype(np.int32)  # a shard is far below 2 GB
    ordered, shared = _sort_leading(text, valley[text[valley] > 0], depth)
    bounds = np.searchsorted(text[ordered], np.arange(HIGHEST + 1))
    marks = np.flatnonzero(text == 0).astype(np.int32)

    queue, carried = RunQueue(), _Carried(depth)
    found = RunQueue(descending=True)  # falling suffixes by byte, as the second scan wants them

    def scan_up(places: np.ndarray, common: np.ndarray) -> None:
        before = text[places - 1]
        carried.induce(queue, places, common, before, (before > 0) & ~rising[places - 1])

    scan_up(marks[1:], np.zeros(marks.size - 1, np.int8))
    for byte in range(1, HIGHEST):
        last = None
        while queue.lowest() == byte:
            _, places, common = queue.pop()
            if last is None:
                common = common.copy()
                common[0] = 0
            found.push(byte, places, common)
            last = places[-1]
            scan_up(places, common)
        begin, end = bounds[byte], bounds[byte + 1]
        if begin < end:
            common = shared[begin:end].copy()
            common[0] = 0 if last is None else min(same[last], same[ordered[begin]])
            scan_up(ordered[begin:end], common)

    queue, carried = RunQueue(descending=True), _Carried(depth)

    def scan_down(places: np.ndarray, common: np.ndarray) -> None:
        before = text[places - 1]
        carried.induce(queue, places, common, before, (before > 0) & rising[places - 1])

    for byte in range(HIGHEST - 1, 0, -1):
        last = None
        while queue.lowest() == byte:
            _, places, common = queue.pop()
            if last is None:
                common = common.copy()
                common[0] = 0
            scan_down(places, common)
            last = places[-1]
            yield places, common
        if found.lowest() == byte:
            _, places, common = found.pop()
            places, above = places[::-1], common[::-1]
            first = 0 if last is None else min(same[last], same[places[0]])
            common = np.concatenate([[first], above[:-1]]).astype(np.int8)
            scan_down(places, common)
            yield places, common


def groups(text: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in suffix order and the number of their group of equal ``depth`` bytes, whole groups at a time."""
    held: list[np.ndarray] = []  # the last group, which may go on
    number = 0
    for places, common in sorted_suffixes(text, depth):
        starts = np.flatnonzero(common < depth)
        if not starts.size:
            held.append(places)
            continue
        whole = np.concatenate([*held, places[:starts[-1]]])
        cut = np.concatenate([[0] if held else [], starts[:-1] + sum(map(len, held))]).astype(np.int64)
        if whole.size:
            yield whole, np.repeat(np.arange(number, number + cut.size), np.diff(np.append(cut, whole.size)))
            number += cut.size
        held = [places[starts[-1]:]]
    if held:
        last = np.concatenate(held)
        yield last, np.full(last.size, number)
