import hashlib
import re
from collections import defaultdict

from civicsift.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        text = row.text or ""
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text).encode()).hexdigest()].append(row)
    out = []
    for digest, members in groups.items():
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        kept = False
        for row in members:
            stays = not kept and row.doc_id == best.doc_id and len(row.text or "") == len(best.text or "")
            kept |= stays
            out.append((str(row.doc_id), str(best.doc_id), len(members), stays, digest))
    return sorted(out)


def test_decisions_equal_brute_force(messy, nothing):
    got = exact_dedup.decide(messy).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == expected(messy.collect())
    assert exact_dedup.decide(nothing).collect() == []


def test_kept_rows_are_whole(messy, nothing):
    kept = exact_dedup.deduplicate(messy)
    assert kept.columns == messy.columns
    stay = sorted(e[1] for e in set((e[4], e[1]) for e in expected(messy.collect())))
    rows = kept.collect()
    assert len(rows) == len(stay) and sorted(str(r.doc_id) for r in rows) == stay
    assert set(rows) <= set(messy.collect())
    assert exact_dedup.deduplicate(nothing).collect() == []


def test_large_filters_are_joined_by_shuffling(messy, monkeypatch):
    before = sorted(map(str, exact_dedup.decide(messy).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", 0)
    assert sorted(map(str, exact_dedup.decide(messy).collect())) == before


def test_filter_lets_unique_rows_pass_and_misses_no_repeat(spark):
    rows = spark.range(20_000).selectExpr("sha2(cast(id as string), 256) AS digest", "id")
    rows = rows.unionByName(rows.filter("id < 50"))
    bits = exact_dedup.filter_bits(rows.count())
    words = exact_dedup.repeat_filter(rows, "digest", bits)
    marked = exact_dedup.mark_repeats(rows, "digest", words, words.count(), bits).filter("maybe_repeated")
    assert marked.filter("id < 50").count() == 100
    assert marked.count() < 100 + 0.03 * 20_000


def test_no_python_in_the_plan(messy):
    plan = exact_dedup.decide(messy.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
