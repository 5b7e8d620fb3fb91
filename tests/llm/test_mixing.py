import random
import re
from collections import Counter

import pytest

from civicsift.llm import mixing


def expected_targets(sizes):
    """Water filling in rounds, sources in order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1.0, 2.0, 3.0)[n % 3] for n, s in enumerate(order)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in order}
        more = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not more:
            return target
        capped |= more


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_sizes_targets_and_copies_of_messy_rows(messy, nothing):
    rows = messy.collect()
    sizes = Counter()
    for row in rows:
        sizes[row.source] += size_of(row.text)
    target = expected_targets(sizes)
    got = mixing.mix(messy).collect()
    source = {}
    for row in rows:
        source.setdefault((row.doc_id, size_of(row.text)), set()).add(row.source)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, size_of(r.text)) for r in rows)
    for r in got:
        assert 0 <= r.copies <= 3 and any(
            r.source_size == sizes[s] and r.target == pytest.approx(target[s]) for s in source[r.doc_id, r.size])
    assert mixing.mix(nothing).collect() == []


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = [(n, " ".join(["w"] * rng.choice([1, 5, 30, 200])), rng.choice(["a", "a", "a", "b", "c", None])) for n in range(3000)]
    return spark.createDataFrame([*rows, (9000, "one two", "z")], "doc_id long, text string, source string")


def test_words_taken_meet_targets_with_many_leaves(corpus, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 5)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    taken, target, limit = Counter(), {}, Counter()
    for r in mixing.mix(corpus).collect():
        key = r.source_size
        taken[key] += r.copies * r.size
        target[key] = r.target
        limit[key] = max(limit[key], r.size)
        times = r.target / r.source_size
        assert int(times + 1e-9) <= r.copies <= -int(-times - 1e-9 // 1) + 1
    for key, words in taken.items():
        assert abs(words - target[key]) <= limit[key]


def test_reruns_and_other_partitions_agree(corpus):
    first = sorted(map(tuple, mixing.mix(corpus).collect()))
    assert sorted(map(tuple, mixing.mix(corpus.repartition(7, "text")).collect())) == first


def test_each_document_keeps_its_probability(spark):
    docs = spark.createDataFrame([(n, "w " * (1 + n % 4), s) for n in range(40) for s in "ab"], "doc_id long, text string, source string")
    copies, runs = Counter(), 4
    for seed in range(runs):
        rows = mixing.mix(docs, seed=seed).collect()
        for r in rows:
            copies[r.target / r.source_size] += r.copies
    for times, count in copies.items():
        assert count / (40 * runs) == pytest.approx(times, abs=0.15)


def test_pair_step_is_fair_and_settles_one():
    rng = random.Random(1)
    for _ in range(200):
        a, b, first, second = rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99), rng.randrange(1, 50), rng.randrange(1, 50)
        ends = {mixing.pair_up(a, b, first, second, draw) for draw in (0.0, 1.0 - 1e-12)}
        up, down = min((1 - a) * first, b * second), min(a * first, (1 - b) * second)
        for x, y in ends:
            assert x * first + y * second == pytest.approx(a * first + b * second)
            assert min(abs(x), abs(x - 1), abs(y), abs(y - 1)) < 1e-9
        mean = sum(chance * x for chance, x in ((down / (up + down), a + up / first), (up / (up + down), a - down / first)))
        assert mean == pytest.approx(a)


def test_rows_are_repeated_whole(messy, nothing):
    mixed = mixing.repeat_rows(messy)
    assert mixed.columns == messy.columns and set(mixed.collect()) <= set(messy.collect())
    unique = messy.filter("doc_id is not null and doc_id not in (3, 7)")
    want = {r.doc_id: r.copies for r in mixing.mix(unique).collect() if r.copies}
    assert Counter(r.doc_id for r in mixing.repeat_rows(unique).collect()) == Counter(want)
    assert mixing.repeat_rows(nothing).collect() == []


def test_rows_that_repeat_share_the_copies_of_all(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE_ROWS", 7)
    rows = [(1, "one two", "a")] * 300 + [(None, "one two", "a")] * 40 + [(n, "three words here", "b") for n in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mixing.repeat_rows(docs).collect())
    assert 0 < want[1] < 300 and got == +want
