import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civicsift.functions import text as tx
from civicsift.functions.regex import java_pattern, parse, prefilters

SAMPLES = [
    None, "", "  ", " x ", "A\r\nB\t c", "HTTP://a.b c", " https://x", "http nothing", "Don't STOP½ now_1!",
    "\x1cédge\x85", "İstanbul ΣΑΣ", "a", "a b", "a b c d", "日本 語 text",
]


def column(spark, expression, rows=SAMPLES):
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    return [r[1] for r in sorted(frame.select("i", expression.alias("v")).collect())]


def python_key(t):
    t = (t or "").strip().lower()
    return "" if t.startswith(("http://", "https://")) else re.sub(r"\s+", " ", t)


def test_whitespace_and_key_match_python(spark):
    assert column(spark, tx.strip(F.coalesce("t", F.lit("")))) == [(s or "").strip() for s in SAMPLES]
    assert column(spark, tx.clean_text(F.col("t"))) == [" ".join((s or "").split()) for s in SAMPLES]
    assert column(spark, tx.dedupe_key(F.col("t"))) == [python_key(s) for s in SAMPLES]


def test_tokens_match_python(spark):
    rows = [s for s in SAMPLES if s is not None]
    assert column(spark, tx.rule_tokens(F.col("t")), rows) == [
        re.findall(r"\w+|[^\w\s]", s.lower()) for s in rows]
    assert column(spark, tx.model_tokens(F.col("t")), rows) == [
        re.findall(r"(?u)\b\w\w+\b", s.lower()) for s in rows]
    custom = tx.model_tokens(F.col("t"), pattern=r"(?u)\b\w+\b", lowercase=False, stop_words=["a"])
    assert column(spark, custom, rows) == [[w for w in re.findall(r"\b\w+\b", s) if w != "a"] for s in rows]


def test_bad_token_pattern_falls_back(spark):
    with pytest.warns(UserWarning):
        tokens = tx.model_tokens(F.col("t"), pattern="(oops")
    assert column(spark, tokens, ["one two"]) == [["one", "two"]]


@pytest.mark.parametrize("low,high", [(1, 1), (1, 2), (2, 3), (1, 4), (0, 0), (3, 2)])
def test_ngrams_match_python(spark, low, high):
    rows = ["", "aa", "aa bb", "aa bb cc", "aa bb cc dd ee"]
    expected = []
    for row in rows:
        words = row.split()
        expected.append([" ".join(words[i:i + n]) for n in range(max(low, 1), high + 1)
                         for i in range(len(words) - n + 1)])
    assert column(spark, tx.ngrams(tx.model_tokens(F.col("t")), low, high), rows) == expected


PATTERNS = [
    r"\bidiots?\b", r"\b(?:foo|bar)s?\b", r"i[\W_]*d[\W_]*i", r"\bs+t[u\\u00fa]p", r"a{2,}b", r"\b[a@4]ss\b",
    r"(?<=x)y", r"(a)(b)\1", r"end$", r"^start", r"\Bmid", r"[^\w\s]{2}", r"wörter?", r"a.c", r"\d+%", r"[^\Wx]+z",
    r"x{,2}q", r"(?P<n>t)o(?P=n)", r"(?s:a.c)", r"[]\[&]+k", r"#hash tag",
]
TEXTS = [
    "idiot Idiots idiotic", "foo bars", "i-d_i", "sstup stúp \\tup u0p", "aaab", "@ss 4SS pass", "xy", "aba", "the end",
    "the end\n", "start", "amid mid", "hey!! ?!", "WÖRTE wörter", "a\nc a\rc abc", "٣% 5%", "abcz xz", "q xq xxxq",
    "tot", "][&k", "#HASH TAG", "",
]


def test_regexes_mean_what_python_means(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    found = frame.select("i", *[
        F.regexp_extract_all("t", F.lit(java_pattern(p)), F.lit(0)).alias(f"p{n}") for n, p in enumerate(PATTERNS)
    ]).collect()
    for row in found:
        for n, p in enumerate(PATTERNS):
            expected = [m.group(0) for m in re.finditer(p, TEXTS[row["i"]], re.I)]
            assert row[f"p{n}"] == expected, (p, TEXTS[row["i"]])


def test_prefilter_finds_exactly_the_texts_with_a_match(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for chosen in (PATTERNS, PATTERNS[:6], PATTERNS[7:8]):
        any_match = F.lit(False)
        for regex in prefilters(chosen):
            any_match = any_match | F.col("t").rlike(regex)
        for row in frame.select("i", any_match.alias("hit")).collect():
            text = TEXTS[row["i"]]
            assert row["hit"] == any(re.search(p, text, re.I) for p in chosen), text


def test_zero_width_and_broken_patterns_are_refused():
    for bad in (r"a*", r"(?=x)", r"\b", ""):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(re.error):
        parse("(")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nabAB.!_é½'", max_size=30), min_size=1, max_size=20))
def test_normalisation_is_idempotent(spark, rows):
    once = column(spark, tx.clean_text(F.col("t")), rows)
    assert once == [" ".join(r.split()) for r in rows]
    assert column(spark, tx.clean_text(F.col("t")), once) == once
