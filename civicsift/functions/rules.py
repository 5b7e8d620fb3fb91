"""Rule matching inside a row: un-negated matches per pattern, as native expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicsift.constants import COUNT_WEIGHT, INTENSITY_WEIGHT, SCORE_CAP
from civicsift.functions.regex import java_pattern, prefilters
from civicsift.functions.text import RULE_TOKEN, bind

# Characters looked at first when the tokens left of a match are needed; the whole
# prefix is tokenised only where these hold too few tokens.
_NEAR = 200


@dataclass(frozen=True)
class PatternSpec:
    """One row of a pattern table: Python-flavoured regex and its weight."""

    label: str
    pattern: str
    intensity: float = 1.0


def finds_any(text: Column, specs: Sequence[PatternSpec]) -> Column:
    """True if at least one pattern occurs in ``text``."""
    found = F.lit(False)
    for regex in prefilters(spec.pattern for spec in specs):
        found = found | text.rlike(regex)
    return found


def matching_patterns(text: Column, specs: Sequence[PatternSpec], labels: Sequence[str]) -> Column:
    """Patterns found in ``text``, in table order: array of (label, weight, matches, gaps).

    ``matches`` are the matched texts and ``gaps`` the texts between them. They are taken here, where the
    regex is a literal that is compiled once, and only for patterns that occur.
    """
    none = F.array().cast("array<struct<label:string,weight:double,matches:array<string>,gaps:array<string>>>")
    parts = []
    for label in labels:
        own = [spec for spec in specs if spec.label == label]
        if not own:
            continue
        rows = []
        for spec in own:
            regex = java_pattern(spec.pattern)
            row = F.struct(
                F.lit(label).alias("label"),
                F.lit(float(spec.intensity)).alias("weight"),
                F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("matches"),
                F.split(text, regex, -1).alias("gaps"),
            )
            rows.append(F.when(text.rlike(regex), row))
        found = F.filter(F.array(*rows), lambda row: row.isNotNull())
        parts.append(F.when(finds_any(text, own), found).otherwise(none))
    return F.concat(*parts) if parts else none


def negated(lowered: Column, start: Column, negators: Sequence[str], window: int) -> Column:
    """True if a negator is among the ``window`` tokens before the token at ``start`` (0-based)."""
    token = F.lit(RULE_TOKEN)
    length = start + 1
    # one token more than needed, because the first one may be cut in half
    near = F.regexp_extract_all(
        F.substring(lowered, F.greatest(F.lit(1), length - (_NEAR - 1)), F.lit(_NEAR)), token, F.lit(0)
    )
    near = F.when(length <= _NEAR, F.regexp_extract_all(F.substring(lowered, F.lit(1), length), token, F.lit(0))) \
        .when(F.size(near) > window + 1, near) \
        .otherwise(F.regexp_extract_all(F.substring(lowered, F.lit(1), length), token, F.lit(0)))
    words = F.array(*[F.lit(word) for word in sorted(set(negators))])

    def before_last(tokens: Column) -> Column:
        n = F.size(tokens)
        left = F.slice(tokens, F.greatest(F.lit(1), n - window), F.greatest(F.lit(0), F.least(F.lit(window), n - 1)))
        return F.arrays_overlap(left, words)

    return bind(near, before_last)


def kept_matches(lowered: Column, matches: Column, gaps: Column, negators: Sequence[str], window: int) -> Column:
    """Number of ``matches``, parted by ``gaps``, that no negator in the ``lowered`` text suppresses."""
    steps = F.zip_with(
        gaps, matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("match"))
    )

    def step(state: Column, piece: Column) -> Column:
        start = state["position"] + piece["gap"]
        if negators and window > 0:
            keep = F.when(negated(lowered, start, negators, window), F.lit(0)).otherwise(F.lit(1))
        else:
            keep = F.lit(1)
        counted = F.struct(
            (start + piece["match"]).alias("position"),
            (state["kept"] + keep).alias("kept"),
        )
        return F.when(piece["match"].isNull(), state).otherwise(counted)

    zero = F.struct(F.lit(0).alias("position"), F.lit(0).alias("kept"))
    return F.aggregate(steps, zero, step, lambda state: state["kept"])


def severities(hits: Column, labels: Sequence[str]) -> Column:
    """Per label ``min(1, 0.5 * matches + 0.15 * summed weight)``, aligned with ``labels``."""

    def score(label: Column) -> Column:
        own = F.filter(hits, lambda hit: (hit["label"] == label) & (hit["kept"] > 0))
        # one addend per match, in pattern order, so that sums of doubles are reproducible
        weights = F.flatten(F.transform(own, lambda hit: F.array_repeat(hit["weight"], hit["kept"])))
        intensity = F.aggregate(weights, F.lit(0.0), lambda total, weight: total + weight)
        raw = F.size(weights) * F.lit(COUNT_WEIGHT) + intensity * F.lit(INTENSITY_WEIGHT)
        return F.least(F.lit(SCORE_CAP), raw)

    return F.transform(F.array(*[F.lit(label) for label in labels]), score)
