import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civicsift.llm import fim


def brute_force(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * at:8 * at + 8], 16) for at in range(4)]
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if n == 0 or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", first, last - first, f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", first, last - first, f"<P>{prefix}<S>{suffix}<M>{middle}", text


def rows_of(df):
    out = fim.fill_in_middle(df).select(F.col("row.doc_id"), *[n for n in (
        "n", "form", "prefix_chars", "middle_chars", "output", "restored")])
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_messy_rows_equal_brute_force(messy):
    given = messy.select("doc_id", "text").collect()
    assert rows_of(messy) == sorted((brute_force(r["doc_id"], r["text"]) for r in given), key=repr)


def test_marks_and_their_parts(spark):
    texts = ["<P>", "a<S>b", "<M", "<", ">", "<P", "S>", "<<<P", "P>>>", "<S<S<S", "M>M>M>", "é<ü>😀<", "<P <S <M > >"] * 12
    rows = [(number, text) for number, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(frame)
    assert got == sorted((brute_force(*row) for row in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_keeps_columns(nothing):
    out = fim.fill_in_middle(nothing)
    assert out.count() == 0 and out.schema["row"].dataType.names == nothing.columns


@pytest.mark.parametrize("window", [1, 2, 7, 1 << 18])
def test_windows_and_slices(monkeypatch, window):
    monkeypatch.setattr(fim, "WINDOW", window)
    texts = ["", "héllo wörld", "", "😀😀", "abc", "", "<x>", "ü"] * 3
    rng = np.random.default_rng(2)
    n = np.array([len(t) for t in texts])
    cuts = np.sort(rng.integers(0, n[:, None] + 1, (len(texts), 2)), axis=1)
    form = np.array(["plain" if not t else rng.choice(["psm", "spm", "plain"]) for t in texts], object)
    every = pa.array(["before", *texts, "after"], pa.string()).slice(1, len(texts))
    outputs = fim.scatter(every, n, cuts[:, 0], cuts[:, 1], form)
    expected = []
    for text, (a, b), kind in zip(texts, cuts, form, strict=True):
        p, m, s = text[:a], text[a:b], text[b:]
        expected.append({"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[kind])
    assert outputs.to_pylist() == expected
    assert fim.gather(outputs, form).to_pylist() == texts
    large = every.cast(pa.large_string())
    assert fim.scatter(large, n, cuts[:, 0], cuts[:, 1], form).to_pylist() == expected


def test_broken_outputs_are_refused():
    with pytest.raises(ValueError):
        fim.gather(pa.array(["<P>a<S>b"]), np.array(["psm"], object))
    with pytest.raises(ValueError):
        fim.gather(pa.array(["x<P>a<S>b<M>c"]), np.array(["psm"], object))


def test_columns_for_other_frames(spark):
    frame = spark.createDataFrame([(5, "some text to cut"), (6, "more of it")], "k long, body string")
    planned = fim.plan(F.col("body"), F.col("k"))
    made = frame.select("k", "body", planned["form"].alias("form"), fim.transformed(F.col("body"), planned).alias("out"))
    back = made.withColumn("back", fim.restored(F.col("out"), F.col("form"))).collect()
    assert all(r["back"] == r["body"] and r["out"] == brute_force(r["k"], r["body"])[5] for r in back)
