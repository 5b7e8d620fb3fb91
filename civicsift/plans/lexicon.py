"""A small mild word list for the registered queries; real pattern tables come from the user."""

from __future__ import annotations

from civicsift.constants import NEGATORS
from civicsift.functions.rules import PatternSpec

# (label, regex, weight, the token sequences the regex stands for)
ENTRIES = [
    ("toxic", r"\btrash\b", 1.0, [["trash"]]),
    ("toxic", r"\bdisgusting\b", 1.2, [["disgusting"]]),
    ("toxic", r"\bpathetic\b", 0.9, [["pathetic"]]),
    ("severe_toxic", r"\bworthless\b", 2.0, [["worthless"]]),
    ("obscene", r"\bscum\b", 1.1, [["scum"]]),
    ("threat", r"\bpathetic\s+(?:loser|clown)s?\b", 2.5,
     [["pathetic", "loser"], ["pathetic", "losers"], ["pathetic", "clown"], ["pathetic", "clowns"]]),
    ("insult", r"\bidiots?\b", 1.0, [["idiot"], ["idiots"]]),
    ("insult", r"\bclowns?\b", 0.8, [["clown"], ["clowns"]]),
    ("insult", r"\bmorons?\b", 1.3, [["moron"], ["morons"]]),
    ("insult", r"\blosers?\b", 1.0, [["loser"], ["losers"]]),
    ("insult", r"\bstupid\b", 1.0, [["stupid"]]),
    ("identity_hate", r"\bstupid\s+(?:idiot|moron)s?\b", 3.0,
     [["stupid", "idiot"], ["stupid", "idiots"], ["stupid", "moron"], ["stupid", "morons"]]),
    ("racism", r"\b(?:worthless|disgusting)\s+scum\b", 2.2, [["worthless", "scum"], ["disgusting", "scum"]]),
]

PATTERNS = [PatternSpec(label, regex, weight) for label, regex, weight, _ in ENTRIES]

# frequent function words, so that suppression happens on the test tables too
QUERY_NEGATORS = sorted({*NEGATORS, "of", "les", "der", "los"})
