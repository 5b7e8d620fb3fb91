"""URL verdicts: listed rules first, else a logistic regression on hashed character n-grams.

Hosts and paths are taken apart, matched and scored with SQL functions and spark.ml only. The
regression is trained from a small labelled URL table: ``label_by_rules`` draws one of bounded size
from the urls the rules decide.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is
judged by the model. Rules of equal length are tried in text order. Without any labelled url, or
with one verdict only among them, that verdict (``allow`` if none) is given to all urls no rule
fits. Repeated rows are each judged; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicsift.llm.common import named, unpacked, whole_row
from civicsift.session import materialise

GRAM = 3
SLOTS = 1 << 15
LABELLED_PER_VERDICT = 4_000  # bound on the labelled table: so many urls of either verdict, lowest hashes first


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^([^/?#]*)([^?#]*)", 2)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: Mapping[str, str]) -> Column:
    """The longest rule that fits, or null. A rule is a host, then a path from its first slash on."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: (len(rule), [-ord(c) for c in rule])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path with their ends marked; equal grams of either stay apart."""

    def of(text: Column, mark: str) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (GRAM - 1), F.lit(1)))
        return F.transform(starts, lambda at: F.concat(F.lit(mark), F.substring(padded, at, F.lit(GRAM))))

    return F.concat(of(host, "h"), of(path, "p"))


def label_by_rules(judged: DataFrame, verdicts: Mapping[str, str]) -> DataFrame:
    """A labelled table ``host, path, verdict`` of at most ``LABELLED_PER_VERDICT`` urls per verdict."""
    ruled = judged.filter(F.col("rule").isNotNull())
    verdict = F.lit(None).cast("string")
    for rule, decision in verdicts.items():
        verdict = F.when(F.col("rule") == rule, F.lit(decision)).otherwise(verdict)
    # written, since both verdicts and then every step of the fit read it
    distinct = materialise(ruled.select("host", "path", verdict.alias("verdict")).distinct(), "ruled-urls")
    parts = [distinct.filter(F.col("verdict") == decision).orderBy(F.xxhash64("host", "path"), "host", "path")
             .limit(LABELLED_PER_VERDICT) for decision in ("allow", "block")]
    return materialise(parts[0].unionByName(parts[1]), "labelled-urls")


@dataclass(frozen=True)
class UrlModel:
    """A fitted regression, or the one verdict there was to learn."""

    regression: LogisticRegressionModel | None
    constant: str = "allow"


def _hashing() -> HashingTF:
    return HashingTF(numFeatures=SLOTS, inputCol="grams", outputCol="features", binary=True)


def train(labelled: DataFrame) -> UrlModel:
    """Fit on ``host, path, verdict``; the table must be small, see ``label_by_rules``. Both verdicts weigh the same,
    however many urls they have."""
    seen = {row["verdict"]: row["count"] for row in labelled.groupBy("verdict").count().collect()}  # allow and block at most
    if len(seen) < 2:
        return UrlModel(None, next(iter(seen), "allow"))
    block = F.col("verdict") == "block"
    total = sum(seen.values())
    weight = F.when(block, F.lit(total / (2 * seen["block"]))).otherwise(F.lit(total / (2 * seen["allow"])))
    rows = labelled.select(F.when(block, 1.0).otherwise(0.0).alias("label"), weight.alias("weight"),
                           grams(F.col("host"), F.col("path")).alias("grams"))
    learner = LogisticRegression(maxIter=30, regParam=0.001, standardization=False, weightCol="weight")
    return UrlModel(learner.fit(_hashing().transform(rows)))


def held_out_accuracy(labelled: DataFrame) -> dict[str, float]:
    """By verdict, the share judged right of a fifth of the labelled urls, drawn by hash, by a model fitted on the others."""
    held = F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0
    model = train(labelled.filter(~held))
    asked = labelled.filter(held).select("host", "path", F.lit(None).cast("string").alias("rule"), F.col("verdict").alias("truth"))
    judged = judge(asked, {}, model)
    shares = judged.groupBy("truth").agg(F.avg((F.col("truth") == F.col("verdict")).cast("double")).alias("right"))
    return {row["truth"]: row["right"] for row in shares.collect()}


def split_urls(pages: DataFrame, rules: Mapping[str, str], url_column: str = "url") -> DataFrame:
    """``row`` (the whole input row), ``host``, ``path`` and the fitting ``rule``."""
    url = F.coalesce(named(pages, url_column), F.lit(""))
    parts = pages.select(whole_row(pages).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    return parts.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))


def judge(parts: DataFrame, rules: Mapping[str, str], model: UrlModel) -> DataFrame:
    """Add ``score`` (probability of block by the model) and ``verdict`` to ``split_urls`` rows."""
    if model.regression is None:
        scored = parts.withColumn("score", F.lit(1.0 if model.constant == "block" else 0.0))
    else:
        features = _hashing().transform(parts.withColumn("grams", grams(F.col("host"), F.col("path"))))
        scored = model.regression.transform(features).withColumn("score", vector_to_array("probability")[1])
    verdict = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    for rule, decision in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(decision)).otherwise(verdict)
    return scored.select(*parts.columns, "score", verdict.alias("verdict"))


def filter_urls(pages: DataFrame, rules: Mapping[str, str], model: UrlModel, url_column: str = "url") -> DataFrame:
    """The rows of ``pages`` whose url is allowed, with their columns unchanged."""
    allowed = judge(split_urls(pages, rules, url_column), rules, model).filter(F.col("verdict") == "allow")
    return allowed.select(*unpacked(allowed, pages.columns))
