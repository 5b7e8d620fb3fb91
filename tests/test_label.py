import random
import re

import pytest
from pyspark.sql import functions as F

from civicsift.constants import LABELS, NEGATORS
from civicsift.functions.rules import PatternSpec
from civicsift.operators.label import label_comments
from civicsift.operators import stats

SPECS = [
    PatternSpec("toxic", r"\btrash\b", 1.0),
    PatternSpec("insult", r"\bidiots?\b", 1.0),
    PatternSpec("insult", r"\bidiot\b", 0.8),
    PatternSpec("insult", r"\s+clown", 1.2),
    PatternSpec("obscene", r"sc[\W_]*um", 2.0),
    PatternSpec("threat", r"\bgo\s+away\b", 3.0),
    PatternSpec("racism", r"\bweak\b", 0.1),
]


def brute_force(text, threshold=0.5):
    """Independent check: token positions by walking over the lower-cased text."""
    text = (text or "").strip()
    scores = dict.fromkeys(LABELS, 0.0)
    if text and not text.lower().startswith("http"):
        tokens = [(m.group(0), m.start()) for m in re.finditer(r"\w+|[^\w\s]", text.lower())]
        for label in LABELS:
            count, weight = 0, 0.0
            for spec in SPECS:
                if spec.label != label:
                    continue
                for match in re.finditer(spec.pattern, text, re.I):
                    at = max([i for i, (_, start) in enumerate(tokens) if start <= match.start()], default=0)
                    if not {word for word, _ in tokens[max(0, at - 3):at]} & set(NEGATORS):
                        count += 1
                        weight += spec.intensity
            scores[label] = min(1.0, 0.5 * count + 0.15 * weight)
        scores["toxic"] = max(scores.values())
    flags = [label for label in LABELS if scores[label] >= threshold]
    return [round(scores[label], 4) for label in LABELS], "|".join(flags)


def run(spark, texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    rows = sorted(label_comments(frame, SPECS, **options).collect(), key=lambda r: r["i"])
    return [([r[f"{label}_score"] for label in LABELS], r["labels"]) for r in rows]


CASES = [
    None, "", "   ", "HTTP idiot", "http://x idiot", "idiot", "an Idiot!", "not an idiot", "not a b idiot",
    "not a b c idiot", "not , . idiot", "don't be an idiot", "dont be an idiot", "idiot idiot not idiot",
    "you clown", "  not clown", "no  clown", "clown", "éidiot idioté idiot", "sc-um scum not sc um",
    "go   away", "never go away", "weak", "trash idiots scum go away", "İ not İ idiot", "İdiot İ İ İ idiot",
    "x" * 300 + " not idiot", "not " + "y" * 300 + " idiot", "not " + "y " * 150 + "idiot",
    "not" + " " * 400 + "idiot", "a " * 200 + "not an idiot and trash",
]


def test_cases_match_brute_force(spark):
    assert run(spark, CASES) == [brute_force(t) for t in CASES]


def test_random_texts_match_brute_force(spark):
    rng = random.Random(7)
    words = ["idiot", "idiots", "Trash", "clown", "not", "never", "dont", "don't", "a", "the", ",", "!", "sc_um", "go",
             "away", "weak", "ünder", "\n", "  ", "without"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert run(spark, texts) == [brute_force(t) for t in texts]


def test_threshold_is_inclusive_and_scores_stay_in_range(spark):
    frame = spark.createDataFrame([("weak",), ("idiot",)], "body string")
    score = 0.5 + 0.15 * 0.1
    rows = label_comments(frame, SPECS, threshold=score).collect()
    assert [r["racism_bin"] for r in rows] == [1, 0]
    for row in rows:
        assert all(0 <= row[f"{label}_score"] <= 1 for label in LABELS)
        assert all(row["toxic_score"] >= row[f"{label}_score"] for label in LABELS)


def test_custom_negators_and_window(spark):
    frame = spark.createDataFrame([("the big idiot",)], "body string")
    flag = lambda **o: label_comments(frame, SPECS, **o).first()["insult_bin"]
    assert flag() == 1
    assert flag(negators=["the"]) == 0
    assert flag(negators=["the"], window=1) == 1
    assert flag(negators=[]) == 1


def test_missing_body_and_unknown_label_raise(spark):
    with pytest.raises(ValueError):
        label_comments(spark.range(1), SPECS)
    with pytest.raises(ValueError):
        label_comments(spark.createDataFrame([("x",)], "body string"), [PatternSpec("other", "x")])


def test_statistics(spark):
    rows = [("a", "idiot"), ("a", "fine"), ("b", "trash"), ("b", "ok"), ("b", "ok2")]
    labeled = label_comments(spark.createDataFrame(rows, "source_subreddit string, body string"), SPECS)
    counts = {r["label"]: r["positives"] for r in stats.label_counts(labeled).collect()}
    assert counts["toxic"] == 2 and counts["insult"] == 1 and counts["threat"] == 0
    overall = stats.overall_toxicity(labeled).first()
    assert (overall["total_rows"], overall["toxic_rows"], overall["toxic_percent"]) == (5, 2, 40.0)
    sources = [tuple(r) for r in stats.source_toxicity(labeled).collect()]
    assert sources[0] == ("a", 2, 1, 1, 50.0) and sources[1][:4] == ("b", 3, 1, 2)
    assert [tuple(r) for r in stats.source_labels(labeled).collect()] == [("a", "insult", 1)]
    empty = stats.overall_toxicity(labeled.filter(F.lit(False))).first()
    assert (empty["total_rows"], empty["toxic_percent"], empty["clean_percent"]) == (0, 0.0, 100.0)
    assert stats.source_toxicity(labeled.drop("source_subreddit")) is None


def test_filters_do_not_repeat_the_matching(spark):
    frame = spark.createDataFrame([("an idiot",), ("fine",)], "body string")
    toxic = label_comments(frame, SPECS).filter("toxic_bin = 1 and insult_score > 0.1")
    assert toxic.count() == 1
    plan = toxic._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and all("RLIKE" not in line and "regexp" not in line for line in filters)
