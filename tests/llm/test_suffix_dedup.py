import random
from collections import defaultdict

import numpy as np
import pytest

from civicsift.llm import exchange, induced_sort, suffix_dedup


def marked(strings):
    return np.frombuffer(b"\0" + b"".join(bytes(c + 1 for c in s) + b"\0" for s in strings), np.uint8)


@pytest.mark.parametrize("memory", [64 << 20, 40])
def test_suffix_order_and_groups_equal_brute_force(memory, monkeypatch):
    monkeypatch.setattr(induced_sort.RunQueue.__init__, "__defaults__", (False, memory))
    rng = random.Random(1)
    for _ in range(120):
        depth, letters = rng.choice([3, 8, 9, 20, 50]), rng.choice([1, 2, 3, 200])
        strings = [bytes(rng.randrange(letters) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 12))]
        strings += [s[rng.randrange(len(s)):] + strings[0] for s in strings if rng.random() < 0.5]
        text = marked(strings)
        raw = text.tobytes()

        def head(place, raw=raw, depth=depth):
            return raw[place:raw.index(0, place)][:depth]

        order = [(int(p), int(c)) for places, common in induced_sort.sorted_suffixes(text, depth) for p, c in zip(places, common, strict=True)]
        heads = [head(place) for place, _ in order]
        assert sorted(p for p, _ in order) == [i for i, c in enumerate(raw) if c] and heads == sorted(heads, reverse=True)
        for (_, common), one, two in zip(order[1:], heads, heads[1:], strict=False):
            same = next((n for n, (a, b) in enumerate(zip(one, two, strict=False)) if a != b), min(len(one), len(two)))
            assert common == same or one == two and common == depth
        found, want = defaultdict(set), defaultdict(set)
        for places, numbers in induced_sort.groups(text, depth):
            for place, number in zip(places, numbers, strict=True):
                if len(head(place)) == depth:
                    found[int(number)].add(int(place))
        for place in range(len(raw)):
            if raw[place] and len(head(place)) == depth:
                want[head(place)].add(place)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def brute(rows):
    first = {}
    for row in rows:
        body, order = (row.text or "").encode(), exchange.NO_ID if row.doc_id is None else row.doc_id
        for at in range(len(body) - 49):
            first[body[at:at + 50]] = min(order, first.get(body[at:at + 50], order))
    out = []
    for row in rows:
        body, order = (row.text or "").encode(), exchange.NO_ID if row.doc_id is None else row.doc_id
        gone = bytearray(len(body))
        for at in range(len(body) - 49):
            if first[body[at:at + 50]] < order:
                gone[at:at + 50] = b"\1" * 50
        out.append((str(row.doc_id), len(body), (b"\0" + bytes(gone)).count(b"\0\1"), bytes(c for c, g in zip(body, gone, strict=True) if not g)))
    return sorted(out)


def cut(docs):
    return sorted((str(r.doc_id), r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())


def test_messy_rows_equal_brute_force(messy, nothing, monkeypatch):
    want = brute(messy.collect())
    monkeypatch.setattr(exchange, "SLICE_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "KEYS_PER_BUCKET", 200)
    monkeypatch.setattr(suffix_dedup, "BYTES_PER_SHARD", 20_000)
    assert cut(messy) == want
    assert cut(nothing) == []


def test_overlaps_periods_and_shared_pieces(spark):
    rng = random.Random(9)
    pieces = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(20, 120))) for _ in range(12)] + ["z" * 90, "ab" * 45]
    rows = [(n, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 6)))) for n in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert cut(docs) == brute(docs.collect())
