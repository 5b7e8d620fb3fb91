import re

import numpy as np
import xxhash

from civicsift.llm import components, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[at:at + 3]) for at in range(len(words) - 2)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """Smallest id reachable, for (id, fingerprint) rows."""
    label = list(range(len(pairs)))

    def root(at):
        while label[at] != at:
            at = label[at]
        return at

    for i, (_, one) in enumerate(pairs):
        for j, (_, two) in enumerate(pairs[:i]):
            if (one ^ two).bit_count() <= 3:
                label[max(root(i), root(j))] = min(root(i), root(j))
    lowest = {}
    for at, (number, _) in enumerate(pairs):
        if number is not None:
            lowest[root(at)] = min(number, lowest.get(root(at), number))
    return [(str(number), value, lowest.get(root(at))) for at, (number, value) in enumerate(pairs)]


def test_messy_rows_equal_brute_force(messy, nothing):
    rows = messy.collect()
    want = brute_components([(r.doc_id, brute_print(r.text)) for r in rows])
    got = simhash.components_of(messy).collect()
    assert sorted((str(r.doc_id), r["print"] % 2**64, r.component_id) for r in got if r.component_id is not None) == sorted(
        w for w in want if w[2] is not None)
    assert simhash.components_of(nothing).collect() == []
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(n for n, _, low in want if n == "None" or n == str(low))
    assert simhash.keep_one(nothing).collect() == []


def planted():
    rng = np.random.default_rng(1)
    out = set()
    for base in rng.integers(0, 2**64, 250, dtype=np.uint64):
        for _ in range(4):
            value = int(base)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                value ^= 1 << int(bit)
            out.add(value)
    return np.array(sorted(out), np.uint64)


def test_descent_finds_every_pair(monkeypatch):
    prints = planted()
    want = {(i, j) for i in range(prints.size) for j in range(i + 1, prints.size) if int(prints[i] ^ prints[j]).bit_count() <= 3}
    for small, pairs in ((1, 500_000), (16, 50)):
        monkeypatch.setattr(simhash, "SMALL_NODES", small)
        monkeypatch.setattr(simhash, "FRONTIER_PAIRS", pairs)
        got = [(int(i), int(j)) for a, b in simhash.descend(prints, prints, 0, 0, 3) for i, j in zip(a, b, strict=True)]
        assert len(got) == len(want) and set(got) == want


def test_node_pairs_over_tasks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 8)
    prints = planted().view(np.int64).tolist()
    frame = spark.createDataFrame([(n, p) for n, p in enumerate(prints)], "doc_id long, print long")
    got = {(r.doc_id, r.component_id) for r in simhash.group(frame).collect()}
    assert got == {(int(n), low) for n, _, low in brute_components([(n, p % 2**64) for n, p in enumerate(prints)])}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(n, n + 1) for n in range(0, 60)] + [(100, n) for n in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []
