import random
import re

import pytest
from pyspark.sql import functions as F

from civicsift.functions.regex import java_literal, java_tree, parse
from civicsift.operators import hits
from civicsift.operators.order import number_rows


def test_positions_with_mixed_directions_nulls_and_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), number) for number in range(500)] + [(2, "a", 7)] * 40
    frame = spark.createDataFrame(rows, "score int, name string, n int").repartition(6)
    got = number_rows(frame, [F.desc_nulls_last("score"), F.asc_nulls_first("name"), F.desc("n")]).collect()
    assert sorted(r["position"] for r in got) == list(range(1, len(rows) + 1))
    expected = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", -r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["position"])] == expected
    assert number_rows(frame.limit(0), [F.col("n")]).count() == 0


def test_columns_of_all_kinds_are_numbered(spark):
    frame = spark.sql("SELECT id, map('k', id) AS m, struct(id, map(1, 2)) AS s, array(id) AS `a.b` FROM range(20)")
    got = number_rows(frame, [F.desc("id")], "at", start=0).collect()
    assert sorted((r["id"], r["at"]) for r in got) == [(n, 19 - n) for n in range(20)]


def test_a_frequent_key_is_spread_over_ranges(spark):
    before = {name: spark.conf.get(name, None) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = spark.range(8000).select(F.lit("same").alias("key"))
        got = number_rows(frame, [F.col("key")])
        placed = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert max(r["count"] for r in placed) < 4000 and got.agg(F.max("position")).first()[0] == 8000
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize(("pattern", "factors"), [
    (r"\bidiots?\b", ["idiot"]), (r"(?:loser|clown)s?", ["clown", "loser"]), (r"[0-9]+", []), (r"Ab\b cd", ["ab cd"]),
    (r"x(?:ab|[cd])y", ["x"]), (r"(?:abc){2,}", ["abc"]), (r"(?:abc)*de", ["de"]), (r"é?abc", ["abc"]), (r"(?=zz)abc", ["abc"]),
    (r"a|bc", ["a", "bc"]), (r"a|[bc]", []),
])
def test_required_factors(pattern, factors):
    parse(pattern)
    assert hits.required_factors(pattern) == factors


def test_hits_equal_python(spark):
    rng = random.Random(5)
    words = ["trash", "Trash", "TRASHY", "idiot", "idiots", "ſtupid", "STUPİD", "Kind", "loser", "clowns", "12", "x", "é", "ab  cd"]
    texts = [(f"k{n}", rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randrange(0, 25)))) for n in range(120)]
    texts += [("none", None), ("empty", ""), ("long", "idiot " * 3000)]
    regexes = [r"\btrash\b", r"idiots?", r"(?:loser|clown)s?", r"[0-9]+", r"stupid", r"kind\W+x", r"ab\s+cd", r"é", r"x|[é1]", r"nowhere",
               r"idiot\s+idiot", r"\btrash\b"] + [rf"\bword{n}\b" for n in range(300)]
    patterns = spark.createDataFrame(list(enumerate(regexes)), "number long, pattern string")
    frame = spark.createDataFrame(texts, "k string, body string")
    expected = []
    for key, text in texts:
        for number, regex in enumerate(regexes):
            found = [m.group(0) for m in re.finditer(regex, text or "", re.IGNORECASE)]
            if found:
                expected.append((key, number, found))
    got = [tuple(r) for r in hits.pattern_hits(frame, patterns, "k").collect()]
    assert sorted(got) == sorted(expected)


@pytest.mark.parametrize(("pattern", "reach"), [
    (r"\bab cd\b", 5), (r"ab{2,3}", 4), (r"(?:ab|cde)f?", 4), (r"ab\s+cd", 0), (r"^abc", 0), (r"abc(?=d)", 0), (r"x(?:ab$|c)", 0), (r"(?:(?:abc)\B){2}", 6),
])
def test_reach(pattern, reach):
    assert hits.reach(pattern) == reach


def test_hits_at_the_ends_of_the_part_a_match_can_be_in(spark):
    texts = [(n, text) for n, text in enumerate([
        "hot dog", "xhot dog", "hot dogx hot dog", "İé hot dog, hot dog\U0001f600hot dog", "hot dogs hot dog", "a hot doghot dog", "hot dog hot dog hot dog.",
        "dog hot", "Hot Dog" + " zz" * 400 + " HOT DOG"])]
    regexes = [r"\bhot dog\b", r"hot dog\B", r"(?:hot )?dog", r".hot dog", r"hot dog.{0,5}", r"hot (?:dog|cat)s?"]
    patterns = spark.createDataFrame(list(enumerate(regexes)), "number long, pattern string")
    got = hits.pattern_hits(spark.createDataFrame(texts, "k long, body string"), patterns, "k").collect()
    found = [(k, n, [m.group(0) for m in re.finditer(regex, text, re.IGNORECASE)]) for k, text in texts for n, regex in enumerate(regexes)]
    assert sorted(tuple(r) for r in got) == sorted(row for row in found if row[2])


def test_hits_of_nothing(spark):
    frame = spark.createDataFrame([("a", "trash")], "k string, body string")
    patterns = spark.createDataFrame([(1, "trash")], "number long, pattern string")
    assert hits.pattern_hits(frame.limit(0), patterns, "k").count() == 0
    assert hits.pattern_hits(frame, patterns.limit(0), "k").count() == 0


def test_only_texts_that_hold_a_whole_factor_are_candidates(spark, monkeypatch):
    written, write = {}, hits.materialise
    monkeypatch.setattr(hits, "materialise", lambda df, name: written.setdefault(name, write(df, name)))
    whole = "alpha beta gamma"
    shreds = [whole[at:at + 9] + " zz " + whole[at + 1:at + 10] for at in range(len(whole) - 8)]
    texts = [(n, " ".join(shreds[n % 3:])) for n in range(20)] + [(20, f"x {whole}x, {whole}"), (21, f"un{whole}")]
    patterns = spark.createDataFrame([(0, rf"\b{whole}\b"), (1, r"\bbeta delta\b")], "number long, pattern string")
    got = hits.pattern_hits(spark.createDataFrame(texts, "k long, body string"), patterns, "k").collect()
    assert [tuple(row) for row in got] == [(20, 0, [whole])]
    assert written["pattern-index"].select("rows").collect() == [(1,)]  # pieces of a factor alone, and words that go on, are looked at no further


def test_matches_far_apart_in_long_texts_and_under_one_key(spark):
    filler = "lorem ipsum é " * 300
    texts = [(1, f"hot dog {filler}Hot dog, hot dog{filler} hot dogs {filler}hot dog"), (1, f"a hot dog {filler}"), (1, f"a hot dog {filler}"), (2, filler),
             (3, f"{filler}hot {filler} dog")]
    regexes = [r"\bhot dog\b", r"hot dogs?", r"hot (?:dog|cat)", r"dog[^d]{90}", r"hot(?s:.)+dog", r"ipsum \xe9 lorem ipsum \xe9 lorem ipsum", "o" + "[^x]" * 80]
    patterns = spark.createDataFrame(list(enumerate(regexes)), "number long, pattern string")
    got = hits.pattern_hits(spark.createDataFrame(texts, "k long, body string"), patterns, "k").collect()
    found = [(k, n, [m.group(0) for m in re.finditer(regex, text, re.IGNORECASE)]) for k, text in texts for n, regex in enumerate(regexes)]
    assert sorted(tuple(row) for row in got) == sorted(row for row in found if row[2])


def test_plain_words_are_translated_as_the_parser_does():
    for pattern in [r"\bab cd\b", "ab", r"\b1", r"x  y\b", "Ab9"]:
        regex, text, edges = java_literal(pattern)
        assert regex == java_tree(parse(pattern)) and hits.described(pattern)[:3] == (
            regex, hits.required_factors(pattern), hits.reach(pattern)) and edges == pattern.startswith(r"\b") + 2 * pattern.endswith(r"\b")
    assert not any(map(java_literal, [r"\b ab", "ab ", "a.b", "", "a_b", "é", r"ab\b\n", "ab\n"]))
