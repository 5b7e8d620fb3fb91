"""Text quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Tokens are words and runs of punctuation. The hashed features are single words, pairs of words and pairs
of word shapes (case, digits, punctuation, same word again). Training keeps one step size per feature
and drops features whose evidence stays below the L1 penalty; scoring is a sparse dot product.

Defined cases: null and empty texts have no features and get the score of the bias. Labelled rows
without a label are left out; without any labelled row every score is 0.5. A doc_id that repeats in
``docs`` is learned from once, one that repeats in ``labels`` once per label row. Whole texts are
read, however long.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from civicsift.llm.common import named

FIT_ROWS = 6_000  # bound on the labelled rows used to fit, those with the lowest id hashes
EPOCHS = 4
WORD_SLOTS = 1 << 20
SHAPE_SLOTS = 128
BIAS = WORD_SLOTS + SHAPE_SLOTS
ALPHA, BETA, L1, L2 = 0.5, 0.1, 0.02, 0.02
CACHED_TOKENS = 150_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _shape(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return 0 if len(token) == 1 else 1
    if token.islower():
        return 2
    if token.isupper():
        return 4 if len(token) > 1 else 3
    if token.isdigit():
        return 5
    return 3 if token[1:].islower() else 6


class _TokenCodes(dict):
    """Token -> hash of its lower-case form and its shape; emptied when full."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED_TOKENS:
            self.clear()
        code = zlib.crc32(token.lower().encode()) << 3 | _shape(token)
        self[token] = code
        return code


_codes = _TokenCodes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots, ascending, and values of a text: roots of n-gram shares, then shares of shape pairs."""
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    codes = np.fromiter(map(_codes.__getitem__, tokens), np.uint64, len(tokens))
    words, shapes = codes >> np.uint64(3), (codes & np.uint64(7)).astype(np.int64)
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    mixed = np.concatenate([words, pairs]) * np.uint64(0xD6E8FEB86659FD93)
    slots, counts = np.unique((mixed >> np.uint64(44)).astype(np.int64), return_counts=True)
    values = np.sqrt(counts / mixed.size)
    if not pairs.size:
        return slots, values
    kinds = (shapes[:-1] * 8 + shapes[1:]) * 2 % SHAPE_SLOTS + (words[:-1] == words[1:])
    share = np.bincount(kinds, minlength=SHAPE_SLOTS) / kinds.size
    used = np.flatnonzero(share)
    return np.concatenate([slots, used + WORD_SLOTS]), np.concatenate([values, share[used]])


class FollowTheLeader:
    """FTRL-proximal logistic regression with one learning rate per slot."""

    def __init__(self) -> None:
        self.z = np.zeros(BIAS + 1)
        self.n = np.zeros(BIAS + 1)

    def weights(self, slots: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        shrunk = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, shrunk)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        gradient = (_sigmoid(float(w @ values)) - label) * values
        n = self.n[slots]
        grown = n + gradient * gradient
        self.z[slots] += gradient - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = grown


def _sigmoid(margin: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -60.0, 60.0)))


@dataclass(frozen=True)
class QualityModel:
    """The slots with a weight other than zero, at most ``BIAS + 1``, ascending."""

    slots: np.ndarray
    weights: np.ndarray

    def scorer(self) -> Callable[[str | None], float]:
        dense = np.zeros(BIAS + 1)
        dense[self.slots] = self.weights

        def score(text: str | None) -> float:
            slots, values = features(text)
            return float(_sigmoid(float(dense[slots] @ values) + dense[BIAS]))

        return score


def fit(docs: DataFrame, labels: DataFrame, label_column: str, id_column: str = "doc_id",
        text_column: str = "text", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Train on at most ``fit_rows`` rows of ``labels``. Texts become features where they lie; the
    leader follows one stream of these bounded rows, and only weights reach the driver."""
    truth = (labels.select(named(labels, id_column).alias("id"), named(labels, label_column).alias("label"))
             .filter("label is not null and id is not null")
             .orderBy(F.xxhash64("id"), "id", "label").limit(fit_rows))
    texts = docs.select(named(docs, id_column).alias("id"), named(docs, text_column).alias("text"))
    chosen = (texts.join(F.broadcast(truth.select("id").distinct()), "id")  # at most fit_rows ids
              .groupBy("id").agg(F.max_by("text", F.xxhash64("text")).alias("text")))

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features(text) for text in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "slots": [s for s, _ in made], "values": [v for _, v in made]})

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(np.append(slots, BIAS), np.append(values, 1.0), int(label))
                for batch in batches
                for slots, values, label in zip(batch["slots"], batch["values"], batch["label"], strict=True)]
        leader, order = FollowTheLeader(), np.random.default_rng(17)
        for _ in range(EPOCHS):
            for at in order.permutation(len(rows)):
                leader.learn(*rows[at])
        weights = leader.weights(slice(None))
        used = np.flatnonzero(weights)
        yield pd.DataFrame({"slot": used, "weight": weights[used]})

    prepared = chosen.mapInPandas(prepare, "id long, slots array<long>, values array<double>")
    rows = prepared.join(F.broadcast(truth), "id").repartition(1).sortWithinPartitions("id", "label")
    found = rows.mapInPandas(follow, "slot long, weight double").toPandas()
    return QualityModel(found["slot"].to_numpy(np.int64), found["weight"].to_numpy(np.float64))


def score(text: Column, model: QualityModel) -> Column:
    """Probability that the label is 1, as a column."""

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for batch in batches:
            yield pd.Series([of(text) for text in batch], dtype="float64")

    return scored.asNondeterministic()(text)  # evaluated once, not again for a filter on it
