"""Text documents as numbered lines: written in order and read in blocks by many tasks, whatever their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicsift.operators.prefix import running_totals
from civicsift.session import materialise, scratch_path
from civicsift.sources.files import assemble

# every line break Python's splitlines knows
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85  ]"


def decoded_path(path: Column) -> Column:
    """Spark reports file paths percent-encoded; a plus sign is only a plus sign there."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def numbered_lines(spark: SparkSession, path: str, name: str = "*", line_break: str = LINE_BREAK) -> DataFrame:
    """``file, line, raw`` of the text files called ``name`` (a glob) at ``path``, lines counted from 1 in each file.

    Files are read in blocks by many tasks; a line's number is its place in its block plus the lines of the blocks
    before. ``line_break`` says where a line of Spark's reader, which takes CR and LF only, ends too.
    """
    read = spark.read.option("pathGlobFilter", name).text(path).select(
        decoded_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.split("value", line_break).alias("parts"))
    sized = materialise(read.withColumn("pieces", F.size("parts")), "lines")  # fixes the row numbers
    placed = running_totals(sized, ["file"], F.col("block"), [F.col("row")], ["pieces"])
    return placed.select("file", "pieces_before", F.posexplode("parts").alias("at", "raw")).select(
        "file", (F.col("pieces_before") + F.col("at") + 1).alias("line"), "raw")


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    return row[0] if row else ""


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ``value`` in order of ``place`` as one document at ``path``.

    The lines are sorted and written in parts by many tasks; the parts are then put end to end.
    """
    spark = lines.sparkSession
    folder = scratch_path(spark, "document")
    lines.orderBy("place").select("value").write.option("lineSep", "\n").text(folder)
    assemble(spark, folder, path)
