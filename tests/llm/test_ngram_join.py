import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicsift.llm import ngram_join


def shingle_set(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    """(id, size of the set, smallest id reachable) of rows (id, text), in order."""
    sets = [shingle_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(at):
        while root[at] != at:
            at = root[at]
        return at

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if one and sets[j] and 100 * both >= 80 * (len(one) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for at, (doc_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if find(k) == find(at) and rows[k][0] is not None]
        out.append((doc_id, len(sets[at]), min(ids) if ids else None))
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def joined(df):
    return sorted((tuple(r) for r in ngram_join.join(df).collect()), key=key)


def test_messy_rows_equal_brute_force(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    assert joined(messy) == sorted(brute_force(rows), key=key)


def test_empty_table(nothing):
    assert joined(nothing) == []


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        action = rng.randrange(3)
        if action == 0:
            words[at] = f"w{rng.randrange(10 ** 6)}"
        elif action == 1:
            words.insert(at, f"w{rng.randrange(10 ** 6)}")
        else:
            del words[at]
    return " ".join(words)


@pytest.fixture(scope="module")
def families():
    """Near copies around the threshold, a family larger than the documents indexed in a round, a shared line, chains."""
    rng = random.Random(3)
    line = " ".join(f"l{i}" for i in range(12))
    texts = []
    base = [f"b{rng.randrange(10 ** 6)}" for _ in range(90)]
    texts += [edited(rng, base, rng.randrange(0, 7)) for _ in range(150)]
    for _ in range(30):
        own = [f"f{rng.randrange(10 ** 6)}" for _ in range(rng.choice([6, 20, 60, 200]))]
        texts += [edited(rng, own, rng.randrange(0, 6)) for _ in range(4)]
    texts += [line + " " + " ".join(f"x{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(1, 30))) for _ in range(80)]
    texts += [line + " " + " ".join(f"x{rng.randrange(10 ** 6)}" for _ in range(2)) for _ in range(20)]
    chain = [f"c{i}" for i in range(120)]
    texts += [" ".join(chain[i:i + 60]) for i in range(0, 60, 3)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_families_equal_brute_force(spark, families):
    frame = spark.createDataFrame(families, "doc_id long, text string").repartition(5)
    expected = sorted(brute_force(families), key=key)
    assert len({r[2] for r in expected}) < len(expected) - 100
    assert joined(frame) == expected


def test_crowded_counters_give_the_same_links(spark, families, monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTER_BITS", 8)
    monkeypatch.setattr(ngram_join, "LEADERS", 4)
    monkeypatch.setattr(ngram_join, "LEADING", 6)
    monkeypatch.setattr(ngram_join, "INDEXED", 3)
    monkeypatch.setattr(ngram_join, "TASK_ROWS", 16)
    rows = families[:100]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert joined(frame) == sorted(brute_force(rows), key=key)


def test_search_equals_counting():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 300, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) < share], rng.integers(0, 5000, 20).astype(np.uint64)]))
            for share in rng.choice([0.2, 0.8, 0.95, 1.0], 40)]
    index = ngram_join.Index(sets)
    for query in sets:
        found = index.search(query, [True] * len(sets))
        overlaps = [np.intersect1d(query, other).size for other in sets]
        assert found == [at for at, other in enumerate(sets)
                         if 100 * overlaps[at] >= 80 * (query.size + other.size - overlaps[at])]


def test_a_set_is_sent_to_few_units(spark, families):
    """Lists of the same documents are one unit."""
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e f g h i j"] * 2 + ["a b c d e f g h i k"])],
                                  "id long, text string")
    described = ngram_join.describe(frame, np.zeros(1 << ngram_join.COUNTER_BITS, np.uint32))
    nodes = described.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    units = ngram_join.candidate_units(nodes).collect()
    assert len({r["unit"] for r in units}) <= 1


def test_only_rows_that_may_repeat_are_shuffled(spark):
    rows = [(n, 5, bytes([n % 40]) * 16, [n % 40]) for n in range(60)] + [(None, 5, b"\0" * 16, [0]), (90, 0, b"x" * 16, [])]
    frame = spark.createDataFrame(rows, "id long, n long, node binary, keys array<long>").repartition(4)
    held = {bytes(r["node"]): (r["id"], r["rows"], r["n"], r["keys"]) for r in ngram_join.distinct_sets(frame).collect()}
    assert held == {bytes([n]) * 16: (n, 1 + (n < 20) + (n == 0), 5, [n]) for n in range(40)}
    entries = spark.range(5000).select(F.col("id").alias("key"))
    found = ngram_join.may_hold(entries, "key", entries.filter("key % 500 = 0"))
    assert {r["key"] for r in found.collect()} >= set(range(0, 5000, 500)) and found.count() < 100
    assert "Exchange hashpartitioning(key" not in found._jdf.queryExecution().toString()
