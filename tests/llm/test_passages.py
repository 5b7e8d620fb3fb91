import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from civicsift.llm import exchange, passages


def brute_pairs(rows):
    """Pairs of ids with equal passages of 50 words, and all pairs of near ones aligned anywhere."""
    lists = {}
    for row in rows:
        words = (row.text or "").encode().lower().split()
        lists.setdefault(row.doc_id, []).append([tuple(words[at:at + 5]) for at in range(len(words) - 4)])
    equal, near = set(), set()
    ids = sorted(lists, key=lambda n: (n is None, n or 0))
    sets = {n: [frozenset(s[at:at + 46]) for s in lists[n] for at in range(len(s) - 45)] for n in ids}
    for i, one in enumerate(ids):
        for two in ids[:i]:
            if set(sets[one]) & set(sets[two]):
                equal.add((two, one))
            words = {w for s in sets[one] for w in s} & {w for s in sets[two] for w in s}
            if len(words) >= 30 and any(len(a & b) >= 0.8 * len(a | b) for a in sets[one] for b in sets[two]):
                near.add((two, one))
    return equal, near


def test_classes_of_messy_rows(messy, nothing, monkeypatch):
    small = messy.filter("text is null or length(text) < 5000")
    equal, near = brute_pairs(small.collect())
    monkeypatch.setattr(exchange, "SLICE_BYTES", 600)
    rows = passages.near_passages(small).collect()
    assert len(rows) == small.count()
    of = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    assert equal and all(of[a] == of[b] for a, b in equal if b is not None)
    linked = {n for pair in near for n in pair}
    times = Counter(r.doc_id for r in rows)
    for r in rows:
        assert (r.n_links > 0) == bool(r.spans) and (r.n_links == 0 or r.doc_id in linked or r.doc_id is None)
        assert all(0 <= s.start and s.end - s.start >= 50 for s in r.spans)
        assert times[r.doc_id] > 1 or all(s.end <= r.n_words for s in r.spans)
    assert passages.near_passages(nothing).collect() == []


def test_near_passages_are_found_and_others_left_alone(spark, make_words):
    rng = random.Random(5)
    rows, groups = [], []
    for group in range(30):
        passage = make_words(rng, 90).split()
        ids = []
        for _ in range(3):
            words = list(passage)
            words[rng.randrange(90)] = "changed"
            ids.append(len(rows))
            rows.append((len(rows), make_words(rng, rng.randrange(40)) + " " + " ".join(words) + " " + make_words(rng, rng.randrange(40))))
        groups.append(ids)
    alone = range(len(rows), len(rows) + 40)
    rows += [(n, make_words(rng, 120)) for n in alone]
    got = {r.doc_id: r for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for ids in groups:
        assert {got[n].class_id for n in ids} == {ids[0]}
    assert all(got[n].class_id == n and got[n].n_links == 0 for n in alone)


def linked_documents(rows):
    equal, near = brute_pairs(rows)
    assert equal == near
    partners = {row.doc_id: set() for row in rows}
    for one, two in near:
        partners[one].add(two)
        partners[two].add(one)
    return partners


def classes_of(partners):
    of = {}
    for start in sorted(partners):
        todo = [start]
        while todo:
            if (one := todo.pop()) not in of:
                of[one] = start
                todo += partners[one]
    return of


@pytest.mark.parametrize("hot", [(3, 3), (1000, 1000), (16, 8)])
def test_links_are_those_of_brute_force_between_documents_of_common_lines(spark, make_words, monkeypatch, hot):
    """A line in most documents, passages around it that few share, others stand between those in order of ids."""
    monkeypatch.setattr(passages, "HOT_CELLS", hot[0])
    monkeypatch.setattr(passages, "HOT_SHINGLES", hot[1])
    monkeypatch.setattr(passages, "KINDS_PER_BLOCK", 8)
    rng = random.Random(11)
    line, common = make_words(rng, 24), [make_words(rng, 64), make_words(rng, 75)]
    around = [(make_words(rng, 40), make_words(rng, 40)) for _ in range(4)]
    texts = []
    for number in range(32):
        one, two = around[number % 4] if number % 3 else (make_words(rng, 40), make_words(rng, 40))
        texts.append(" ".join([one, line, two, make_words(rng, 10)]))
    for number in range(24):
        middle = [common[0]] * (number % 2 == 0) + [common[1]] * (number % 3 == 0) + [line] * (number % 5 == 0)
        rng.shuffle(middle)
        texts.append(" ".join([make_words(rng, rng.randrange(20, 60)), *(m + " " + make_words(rng, rng.randrange(12, 20)) for m in middle)]))
    order = rng.sample(range(len(texts)), len(texts))
    docs = spark.createDataFrame(list(zip(order, texts, strict=True)), "doc_id long, text string").repartition(3)
    partners = linked_documents(docs.collect())
    want = classes_of(partners)
    got = {r.doc_id: r for r in passages.near_passages(docs).collect()}
    assert max(map(len, partners.values())) > 11
    assert {n: r.n_links for n, r in got.items()} == {n: len(others) for n, others in partners.items()}
    assert {n: r.class_id for n, r in got.items()} == want
    for n, r in got.items():
        assert {s.partner for s in r.spans} <= partners[n] and bool(r.spans) == bool(partners[n])
        assert not partners[n] or min(s.partner for s in r.spans) == min(partners[n])


def test_all_cells_of_a_key_meet():
    parts = np.zeros(7, passages._CELL)
    parts["key"], parts["id"] = [5, 5, 5, 5, 5, 8, 8], [1, 2, 2, 3, 4, 1, 1]
    parts["first"] = range(7)
    one, two = passages.join_cells(parts)
    got = sorted(zip(two["first"].tolist(), one["first"].tolist(), strict=True))
    assert got == [(a, b) for a in range(5) for b in range(a + 1, 5) if (a, b) != (1, 2)]


def test_codes_of_hot_keys_are_marked():
    codes, counts = [[1, 4, 7], [4, 9], [4, 7]], [[1, 2, 1], [1, 3], [1, 1]]
    rows = pd.DataFrame({"bucket": [2] * 3, "group": list("abc"),
                         "sent": [np.array(c, np.uint32).tobytes() for c in codes],
                         "counts": [exchange.pack(np.array(n, np.uint16).tobytes()) for n in counts]})
    got = [np.frombuffer(exchange.unpack(sent), np.uint64).tolist() for sent in exchange.shared_codes(3)(rows)["sent"]]
    hot, four, seven, nine = int(exchange.HOT), (2 << 32) + 4, (2 << 32) + 7, (2 << 32) + 9
    assert got == [[four + hot, seven], [four + hot, nine + hot], [four + hot, seven]]


def test_cells_group_all_passages_by_their_signatures():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 45, 46, 200, 130])
    values = rng.integers(0, 60, sizes.sum()).astype(np.uint64)
    key, text, first, last, centre = passages.cells(values, sizes)
    begins = np.cumsum(sizes) - sizes
    per_start, signature_of = {}, {}
    for at in range(key.size):
        for start in range(first[at], last[at] + 1):
            per_start[text[at], start] = per_start.get((text[at], start), 0) + 1
            assert start <= centre[at] < start + passages.WIDTH
            window = frozenset(values[begins[text[at]] + start:begins[text[at]] + start + passages.WIDTH].tolist())
            signature_of.setdefault(window, set()).add(int(key[at]))
    assert per_start == {(t, s): passages.PAIRS for t in range(5) for s in range(max(0, sizes[t] - passages.WIDTH + 1))}
    assert all(len(keys) == passages.PAIRS for keys in signature_of.values())


def test_ranges_are_joined_and_cut():
    asks = np.zeros(4, passages._ASK)
    for at, (row, start, count, shift) in enumerate([(1, 0, 30, 5), (1, 20, 40, 5), (1, 20, 4, 6), (2, 0, 1, 5)]):
        asks[at] = (row, start, count, 9, 9, 9, start + shift)
    got = [(a["row"], a["start"], a["count"], a["other_start"]) for a in passages._joined(asks)]
    assert got == [(1, 0, 46, 5), (1, 46, 14, 51), (1, 20, 4, 26), (2, 0, 1, 5)]


def test_words_end_at_blanks_and_texts():
    texts = ["", " a B\tc\x0bd\x0ce ", "F", "g\x1ch é\r\nÉ i j k", "  ", "l m n o p q"]
    raw = [text.encode() for text in texts]
    joined = np.frombuffer(b"".join(raw), np.uint8)
    values, sizes, counts = passages.shingles(joined, np.array([len(b) for b in raw]))
    words = [b.lower().split() for b in raw]
    assert counts.tolist() == [len(w) for w in words] and sizes.tolist() == [max(len(w) - 4, 0) for w in words]
    alone = [passages.shingles(np.frombuffer(b" ".join(w[at:at + 5]), np.uint8), np.array([len(b" ".join(w[at:at + 5]))]))[0]
             for w in words for at in range(len(w) - 4)]
    assert values.tolist() == np.concatenate(alone).tolist() and len(set(values.tolist())) == values.size


def test_types_are_compared_where_their_leading_shingles_are(spark, monkeypatch):
    """Neighbouring windows of one passage: pairs equal brute force, and no pair is shuffled with its shingles."""
    rng = random.Random(11)
    types, base = {}, [rng.randrange(-2 ** 62, 2 ** 62) for _ in range(90)]
    for _ in range(4):
        passage = [rng.randrange(-2 ** 62, 2 ** 62) if rng.random() < 0.03 else code for code in base]
        for at in range(0, 44, 2):
            held = sorted(set(passage[at:at + rng.choice([30, 38, 46])]))
            types[tuple(held)] = len(held) + rng.randrange(4)
    rows = [(n, words, list(held)) for n, (held, words) in enumerate(types.items())]
    frame = spark.createDataFrame(rows, "type long, words int, shingles array<long>").repartition(3)
    expected = {(a, b) for a, one, x in rows for b, two, y in rows
                if a == b and 9 * len(x) >= 8 * one or a != b and 9 * len(set(x) & set(y)) >= 4 * (one + two)}
    assert len(expected) > 2 * len(rows)
    for most in (1 << 12, 2):
        monkeypatch.setattr(passages, "TYPES_PER_PART", most, raising=False)
        near = passages.similar_types(frame)
        assert "array_intersect" not in near._jdf.queryExecution().optimizedPlan().toString()
        found = [tuple(row) for row in near.collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_maps_of_few_documents_are_small(spark):
    """A type of a few documents takes two bytes for each, a type of most of them a bit map."""
    places = {1: [3], 2: [0, 32767, 5], 3: list(range(0, 32768, 2))}
    rows = spark.createDataFrame([(n, 0, p) for n, p in places.items()], "type long, number long, places array<int>")
    found = {r["type"]: bytes(r["bits"]) for r in passages._packed_maps(rows).collect()}
    assert {n: len(bits) for n, bits in found.items()} == {1: 2, 2: 6, 3: 4096}
    assert {n: sorted(passages._places(bits).tolist()) for n, bits in found.items()} == {n: sorted(p) for n, p in places.items()}
