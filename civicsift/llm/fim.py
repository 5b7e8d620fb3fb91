"""Fill-in-middle transformation by displacement scatter.

A text is cut into prefix, middle and suffix, which are written in another order behind marks. All texts of a batch
lie end to end as bytes. Where a part begins, a difference array holds by how much the displacement changes; its
running sum is the displacement of every byte, by which the bytes are scattered into the output. To restore, the marks of an
output are looked up, the same displacements follow from the lengths between them, and the bytes are gathered back.
Bytes are handled in windows, so that a very long text needs little more than itself and its output.

Cuts are drawn from a digest of the id, so that a repeated task cuts alike.

Defined cases: a null text counts as empty and stays plain, as do texts that hold a mark. A null id is hashed as if it
had no digits. Rows that repeat are transformed alike. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicsift.llm.common import named, small_batches, text_or_empty, whole_row

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # marks, of MARK bytes each
MARK = 3
PLAIN_FROM = 90  # of 100: the share of texts that are transformed
SPM_BELOW = 20  # of 100: the share of the transformed ones with the suffix first
WINDOW = 1 << 18  # bytes displaced at a time


def plan(text: Column, key: Column) -> dict[str, Column]:
    """``n, form, first, last``: code points of ``text``, its form, and the code points before its two cuts."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * at + 1, 8), 16, 10).cast("long") for at in range(4)]
    n = F.char_length(text).cast("long")
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = (F.when((n == 0) | marked | (h[2] % 100 >= PLAIN_FROM), F.lit("plain"))
            .when(h[3] % 100 < SPM_BELOW, F.lit("spm")).otherwise(F.lit("psm")))
    return {"n": n, "form": form, "first": F.least(one, two), "last": F.greatest(one, two)}


def raw_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins; the end of the last comes last."""
    large = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if large else np.int32
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    begins = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[begins[0]:begins[-1]]
    return raw, begins - begins[0]


def as_texts(raw: np.ndarray, begins: np.ndarray) -> pa.Array:
    kind, number = (pa.large_string(), np.int64) if begins[-1] >= 1 << 31 else (pa.string(), np.int32)
    made = pa.Array.from_buffers(kind, begins.size - 1, [None, pa.py_buffer(begins.astype(number)), pa.py_buffer(raw)])
    return made if kind == pa.string() else made.cast(pa.string())


def byte_places(raw: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Where the code points with these ascending numbers begin; the end for a number that is not reached."""
    out = np.full(numbers.size, raw.size, np.int64)
    seen = done = 0
    for begin in range(0, raw.size, WINDOW):
        leads = np.flatnonzero((raw[begin:begin + WINDOW] & 0xC0) != 0x80)
        stop = int(np.searchsorted(numbers, seen + leads.size))
        out[done:stop] = begin + leads[numbers[done:stop] - seen]
        seen, done = seen + leads.size, stop
    return out


@dataclass(frozen=True)
class Layout:
    """Where the parts of all texts of a batch go. Parts are given by their lengths in bytes."""

    places: np.ndarray  # ascending places of the texts' bytes at which the displacement changes
    changes: np.ndarray  # by how much
    marks: tuple[np.ndarray, np.ndarray, np.ndarray]  # places of the three marks in the output
    begins: np.ndarray  # of the outputs
    size: int  # bytes of all texts

    @staticmethod
    def of(prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray, plain: np.ndarray, spm: np.ndarray) -> Layout:
        sizes = prefix + middle + suffix
        starts = np.cumsum(sizes) - sizes
        out_sizes = sizes + np.where(plain, 0, 3 * MARK)
        begins = np.concatenate([[0], np.cumsum(out_sizes)]).astype(np.int64)
        at = begins[:-1]
        prefix_to = np.where(plain, at, at + MARK + np.where(spm, suffix + MARK, 0))
        suffix_to = np.where(plain, at + prefix + middle, at + MARK + np.where(spm, 0, prefix + MARK))
        middle_to = np.where(plain, at + prefix, at + 3 * MARK + prefix + suffix)
        moves = np.stack([prefix_to - starts, middle_to - (starts + prefix), suffix_to - (starts + prefix + middle)], 1)
        places = np.stack([starts, starts + prefix, starts + prefix + middle], 1).reshape(-1)
        changes = np.diff(moves.reshape(-1), prepend=0)
        marked = ~plain
        marks = ((prefix_to - MARK)[marked], (suffix_to - MARK)[marked], (middle_to - MARK)[marked])
        return Layout(places, changes, marks, begins, int(sizes.sum()))

    def windows(self):
        """``begin, end, target``: for bytes of the texts, a window at a time, their places in the output."""
        shift = done = 0
        for begin in range(0, self.size, WINDOW):
            end = min(begin + WINDOW, self.size)
            stop = int(np.searchsorted(self.places, end))
            steps = np.zeros(end - begin, np.int64)
            np.add.at(steps, self.places[done:stop] - begin, self.changes[done:stop])  # empty parts share a place
            steps[0] += shift
            moved = np.cumsum(steps)
            shift, done = int(moved[-1]), stop
            yield begin, end, moved + np.arange(begin, end)


def scatter(texts: pa.Array, n: np.ndarray, first: np.ndarray, last: np.ndarray, form: np.ndarray) -> pa.Array:
    """The outputs of texts with ``n`` code points, cut after ``first`` and ``last`` of them."""
    raw, begins = raw_texts(texts)
    before = np.cumsum(n) - n
    cuts = byte_places(raw, np.stack([before + first, before + last], 1).reshape(-1)).reshape(-1, 2)
    layout = Layout.of(cuts[:, 0] - begins[:-1], cuts[:, 1] - cuts[:, 0], begins[1:] - cuts[:, 1],
                       form == "plain", form == "spm")
    out = np.zeros(layout.begins[-1], np.uint8)
    for begin, end, target in layout.windows():
        out[target] = raw[begin:end]
    for places, mark in zip(layout.marks, (PREFIX, SUFFIX, MIDDLE), strict=True):
        for at, byte in enumerate(mark.encode()):
            out[places + at] = byte
    return as_texts(out, layout.begins)


def mark_places(raw: np.ndarray) -> np.ndarray:
    found = []
    for begin in range(0, max(raw.size - MARK + 1, 0), WINDOW):
        piece = raw[begin:begin + WINDOW + MARK - 1]
        letter = piece[1:-1]
        hit = (piece[:-2] == ord("<")) & (piece[2:] == ord(">")) & (
            (letter == ord("P")) | (letter == ord("S")) | (letter == ord("M")))
        found.append(begin + np.flatnonzero(hit))
    return np.concatenate([np.zeros(0, np.int64), *found])


def gather(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts that outputs of these forms were made from. Parts hold no mark, so an output has just its own three."""
    raw, begins = raw_texts(outputs)
    plain, spm = form == "plain", form == "spm"
    marks = mark_places(raw)
    owner = np.searchsorted(begins, marks, side="right") - 1
    inside = ~plain[owner] & (marks + MARK <= begins[owner + 1])
    if not np.array_equal(owner[inside], np.repeat(np.flatnonzero(~plain), 3)):
        raise ValueError("an output does not hold three marks")
    at = marks[inside].reshape(-1, 3)
    if (at[:, 0] != begins[:-1][~plain]).any():
        raise ValueError("an output does not begin with a mark")
    sizes = np.diff(begins)
    parts = {name: np.zeros(sizes.size, np.int64) for name in ("one", "two", "middle")}
    parts["one"][~plain] = at[:, 1] - at[:, 0] - MARK
    parts["two"][~plain] = at[:, 2] - at[:, 1] - MARK
    parts["middle"][~plain] = begins[1:][~plain] - at[:, 2] - MARK
    prefix = np.where(plain, sizes, np.where(spm, parts["two"], parts["one"]))
    suffix = np.where(plain, 0, np.where(spm, parts["one"], parts["two"]))
    layout = Layout.of(prefix, parts["middle"], suffix, plain, spm)
    text = np.zeros(layout.size, np.uint8)
    for begin, end, target in layout.windows():
        text[begin:end] = raw[target]
    text_sizes = prefix + parts["middle"] + suffix
    return as_texts(text, np.concatenate([[0], np.cumsum(text_sizes)]).astype(np.int64))


def _forms(form: pa.Array) -> np.ndarray:
    return np.array(form.to_pylist(), object)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def transformed(text: Column, planned: dict[str, Column]) -> Column:
    """The output of a text, a string column."""

    @F.arrow_udf("string")
    def move(texts: pa.Array, n: pa.Array, first: pa.Array, last: pa.Array, form: pa.Array) -> pa.Array:
        return scatter(texts, _numbers(n), _numbers(first), _numbers(last), _forms(form))

    return move(text, planned["n"], planned["first"], planned["last"], planned["form"])


def restored(output: Column, form: Column) -> Column:
    """The text an output of this form was made from, a string column."""

    @F.arrow_udf("string")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return gather(outputs, _forms(forms))

    return back(output, form)


def round_trip(text: Column, planned: dict[str, Column]) -> Column:
    """``struct<output, restored>``: both columns by one Python worker; the second is made from the first and the form."""

    @F.arrow_udf("struct<output:string,restored:string>")
    def both(texts: pa.Array, n: pa.Array, first: pa.Array, last: pa.Array, form: pa.Array) -> pa.Array:
        outputs = scatter(texts, _numbers(n), _numbers(first), _numbers(last), _forms(form))
        return pa.StructArray.from_arrays([outputs, gather(outputs, _forms(form))], ["output", "restored"])

    return both.asNondeterministic()(text, planned["n"], planned["first"], planned["last"], planned["form"])


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``row, n, form, prefix_chars, middle_chars, output, restored`` of every document; ``row`` is the document."""
    small_batches(docs.sparkSession)
    text = text_or_empty(named(docs, text_column))
    cut = docs.select(whole_row(docs).alias("row"), text.alias("text"),
                      *[column.alias(name) for name, column in plan(text, named(docs, id_column)).items()])
    both = round_trip(F.col("text"), {name: F.col(name) for name in ("n", "first", "last", "form")})
    moved = cut.withColumn("both", both)
    in_parts = F.col("form") != "plain"
    return moved.select("row", "n", "form", F.when(in_parts, F.col("first")).alias("prefix_chars"),
                        F.when(in_parts, F.col("last") - F.col("first")).alias("middle_chars"),
                        F.col("both.output").alias("output"), F.col("both.restored").alias("restored"))
