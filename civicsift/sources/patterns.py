"""Pattern tables: one ``<label>.tsv`` of regex and weight per label."""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicsift.constants import LABELS
from civicsift.functions.regex import parse
from civicsift.functions.rules import PatternSpec
from civicsift.functions.text import is_number, strip
from civicsift.operators.order import number_rows
from civicsift.sources.files import require_file
from civicsift.sources.lines import decoded_path, numbered_lines

FILES = r"([^/]+)\.tsv$"  # where a path holds its label
SHOWN = 20  # problems an error message lists

# the check of regexes runs in executors, which need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[parse.__module__])


def _regex_problem(pattern: Column) -> Column:
    @F.pandas_udf("string")
    def problem(patterns: pd.Series) -> pd.Series:
        def check(text: str) -> str | None:
            try:
                parse(text)
            except (re.error, ValueError, OverflowError, RecursionError) as found:
                return f"invalid regex: {found}"
            return None
        return patterns.map(check)

    return problem(pattern)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Turn ``raw`` of pattern lines into ``pattern, weight, problem``; comments and blank lines are left out."""
    stripped = lines.withColumn("raw", strip(F.col("raw")))
    stripped = stripped.filter((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    tab = F.lit("\t")
    # a written-out \t separates only in lines without a real tab
    raw = F.when(F.contains(F.col("raw"), tab), F.col("raw")).otherwise(F.replace(F.col("raw"), F.lit("\\t"), tab))
    cells = F.split(raw, "\t")
    text = F.when(F.size(cells) > 1, F.nullif(cells[1], F.lit("")))
    number = F.when(is_number(text), F.trim(text).try_cast("double"))
    out = stripped.withColumns({"pattern": cells[0], "weight": F.when(text.isNull(), F.lit(1.0)).otherwise(number)})
    no_number = F.when(text.isNotNull() & ~is_number(text), F.concat(F.lit("no number: "), text))
    return out.withColumn("problem", F.coalesce(no_number, _regex_problem(F.col("pattern")))).drop("raw")


def pattern_folder(spark: SparkSession, folder: str, allow_missing: bool = False, name: str = "*.tsv",
                   label: str = FILES) -> DataFrame:
    """``label, file, line, pattern, weight, problem`` of all pattern files in ``folder``, of any size.

    ``label`` is a regex whose first group is the label in the path of a file. Files of other labels are not looked
    at. Unless ``allow_missing``, every label must have a file, which may be empty.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", name).load(require_file(spark, folder))
    own = F.regexp_extract(decoded_path(F.col("path")), label, 1)
    if not allow_missing:
        wanted = spark.createDataFrame([(text,) for text in LABELS], "label string")
        missing = wanted.join(listed.select(own.alias("label")).distinct(), "label", "left_anti").collect()  # labels only
        if missing:
            names = sorted((row["label"] for row in missing), key=LABELS.index)
            raise FileNotFoundError(f"pattern file missing in {folder} for {', '.join(names)}")
    lines = numbered_lines(spark, folder, name).withColumn("label", F.regexp_extract("file", label, 1))
    return parsed_lines(lines.filter(F.col("label").isin(LABELS))).select(
        "label", "file", "line", "pattern", "weight", "problem")


def pattern_files(spark: SparkSession, folder: str, extra: str | None = None, **options: str) -> DataFrame:
    """The patterns of ``folder`` and then those of ``extra`` for every label, numbered in that order (``number``).

    ``origin`` is 0 for the base folder and 1 for the extra one, which may lack labels; repeats are kept.
    """
    table = pattern_folder(spark, folder, **options).withColumn("origin", F.lit(0))
    if extra:
        table = table.unionByName(pattern_folder(spark, extra, True, **options).withColumn("origin", F.lit(1)))
    place = F.array_position(F.array(*[F.lit(text) for text in LABELS]), F.col("label"))
    return number_rows(table, [place, F.col("origin"), F.col("file"), F.col("line")], "number")


def require_valid(table: DataFrame) -> DataFrame:
    """The table without ``problem``; raises with file and line if a row has one."""
    wrong = table.filter(F.col("problem").isNotNull())
    shown = wrong.orderBy("number").limit(SHOWN).collect()
    if shown:
        more = wrong.count() - len(shown)
        told = "; ".join(f"{row['file']}:{row['line']}: {row['problem']}" for row in shown)
        raise ValueError(told + (f"; and {more} more" if more else ""))
    return table.drop("problem")


def as_specs(table: DataFrame) -> list[PatternSpec]:
    """The patterns on the driver, for expressions with a literal per pattern; see ``operators.hits`` for large tables."""
    rows = require_valid(table).orderBy("number").collect()
    return [PatternSpec(row["label"], row["pattern"], row["weight"]) for row in rows]


def load_pattern_file(spark: SparkSession, path: str, label: str) -> list[PatternSpec]:
    """Checked patterns of one file."""
    lines = numbered_lines(spark, require_file(spark, path)).withColumn("label", F.lit(label))
    return as_specs(parsed_lines(lines).withColumn("number", F.col("line")))


def load_pattern_dir(spark: SparkSession, folder: str, allow_missing: bool = False) -> list[PatternSpec]:
    """Patterns of ``folder/<label>.tsv`` for all labels, in label and line order."""
    table = pattern_folder(spark, folder, allow_missing)
    place = F.array_position(F.array(*[F.lit(text) for text in LABELS]), F.col("label"))
    return as_specs(table.withColumn("number", F.struct(place.alias("place"), "line")))


def extend_patterns(base: Sequence[PatternSpec], extra: Sequence[PatternSpec]) -> list[PatternSpec]:
    """Per label the base rows, then the extra rows; repeats are kept."""
    merged = []
    for label in LABELS:
        merged += [spec for spec in [*base, *extra] if spec.label == label]
    return merged
