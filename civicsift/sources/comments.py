"""Comment tables: CSV discovery, reading, tagging, concatenation and writing."""

from __future__ import annotations

import csv
import posixpath
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicsift.operators.order import number_rows
from civicsift.operators.prefix import spread_lookup
from civicsift.session import materialise
from civicsift.sources import versions
from civicsift.sources.files import beside, exists, is_file, qualified, require_file, swap_into
from civicsift.sources.lines import decoded_path

SOURCE = "source_subreddit"
POSITION = "_position"
_CSV = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def header_of(line: str) -> list[str]:
    return next(csv.reader([line]), [])


def read_csv(spark: SparkSession, paths: Sequence[str] | str, header: Sequence[str] | None = None,
             multi_line: bool = True) -> DataFrame:
    """All columns as strings, blanks kept as "".

    ``multi_line=False`` lets Spark split large files; use it when no cell holds a line break. Of a dataset with versions
    the latest is read.
    """
    paths = [versions.folder_of(spark, path) for path in ([paths] if isinstance(paths, str) else paths)]
    if header is None:
        header = _directory_header(spark, paths)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    frame = spark.read.options(**_CSV).option("multiLine", multi_line).schema(schema).csv(paths)
    return frame.na.fill("")


def safe_read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Like ``read_csv``; an unreadable path gives a warning and an empty frame."""
    try:
        frame = read_csv(spark, path)
        frame.isEmpty()  # reads the first row, since errors of the read itself come up only then
        return frame
    except (PySparkException, FileNotFoundError, OSError, ValueError) as problem:
        warnings.warn(f"failed to read {path}: {problem}", stacklevel=2)
        return spark.createDataFrame([], T.StructType([]))


def load_comments(spark: SparkSession, path: str) -> DataFrame:
    """``safe_read_csv`` that insists on rows."""
    frame = safe_read_csv(spark, path)
    if not frame.columns or frame.isEmpty():
        raise ValueError(f"no rows found in {path}")
    return frame


def file_table(spark: SparkSession, root: str, name: str = "comments.csv", **options: bool) -> DataFrame:
    """``path, lines, header, file`` of every file called ``name`` (a glob) below ``root``, numbered by path from 0.

    Spark lists the files and reads them as lines, so that no file is opened by the driver. ``lines`` is an upper
    bound of the records, as cells may hold line breaks. Files without any line have no header and are left out.
    """
    require_file(spark, root)
    lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter=name, **options).text(root).select(
        "value", decoded_path(F.col("_metadata.file_path")).alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    files = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.min_by("value", "at").alias("header"))
    return number_rows(files.withColumn("header", F.ltrim("header", F.lit("\ufeff"))), [F.col("path")], "file", start=0)


def column_names(header: Sequence[str]) -> list[str]:
    """Names of columns; blank and repeated names are told apart as pandas does it."""
    out: list[str] = []
    for at, name in enumerate(header):
        name = name or f"Unnamed: {at}"
        fresh, number = name, 0
        while fresh in out:
            number += 1
            fresh = f"{name}.{number}"
        out.append(fresh)
    return out


def merge_comments(spark: SparkSession, root: str, multi_line: bool = True, position: bool = False,
                   name: str = "comments.csv") -> DataFrame:
    """Every file called ``name`` (a glob) below ``root`` as one frame, tagged with its community.

    All files are read by one scan into numbered cells; each row then takes its names from the header of its own file,
    which is looked up by path. Cells of columns a file lacks are blank. ``position=True`` keeps the input order
    (file, row in file) in ``_position``. A file is read by one task, whatever its size, because cells
    may hold line breaks; ``multi_line=False`` promises that none do, and lets files be split.
    """
    return _merge(spark, root, materialise(file_table(spark, root, name), "files"), name, multi_line, position)


def _merge(spark: SparkSession, root: str, files: DataFrame, name: str, multi_line: bool, position: bool,
           **options: bool) -> DataFrame:
    """The rows of ``files``. With ``options``, also ``_path``, the cells of the row's own header and of the widest one
    (``_own``, ``_width``), the text of a record with another number of cells than that (``_record``), and the cells (``_text``)."""
    # the distinct headers are the schema of the result and must be known to the driver; files and rows need not
    found = files.groupBy("header").agg(F.min("file").alias("first"), F.min_by("path", "file").alias("path"),
                                        F.sum("lines").alias("lines")).orderBy("first").collect()
    if not found:
        raise ValueError(f"no {name} files found under {root}")
    headers = [column_names(header_of(row["header"])) for row in found]
    fold = (lambda text: text) if spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    places: dict[str, dict[int, int]] = {}  # by folded name: the cell of each header that has the column
    spelled: dict[str, str] = {}
    for number, (names, row) in enumerate(zip(headers, found, strict=True)):
        for cell, column in enumerate(names):
            if fold(column) == fold(SOURCE):
                raise ValueError(f"column {SOURCE} already exists in {row['path']}")
            spelled.setdefault(fold(column), column)
            places.setdefault(fold(column), {}).setdefault(number, cell)
    known = spark.createDataFrame([(row["header"], number, len(headers[number])) for number, row in enumerate(found)],
                                  "header string, kind int, own int")
    kinds = files.join(F.broadcast(known), "header").select("path", "lines", "file", "kind", "own")
    width = max(map(len, headers))
    schema = T.StructType([T.StructField(f"_c{cell}", T.StringType()) for cell in range(width)])
    if options:
        schema = schema.add("_record", T.StringType())
        options["columnNameOfCorruptRecord"] = "_record"
    # Spark takes the first line of every file for its header and goes by the cells' places
    cells = (spark.read.options(**_CSV, **options).option("multiLine", multi_line).option("recursiveFileLookup", True)
             .option("pathGlobFilter", name).schema(schema).csv(root))
    raw = cells.select("*", decoded_path(F.col("_metadata.file_path")).alias("path"),
                       F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    rows = spread_lookup(raw, kinds, "path", "lines", sum(row["lines"] for row in found), "inner", spread_on=["_block", "_row"])

    def column(own: dict[int, int]) -> Column:
        # headers that have the column in the same cell share a branch
        out = F.lit(None).cast("string")
        for cell in sorted(set(own.values())):
            having = [kind for kind, at in own.items() if at == cell]
            out = F.when(F.col("kind").isin(having), F.col(f"_c{cell}")).otherwise(out)
        return F.coalesce(out, F.lit(""))

    base = qualified(spark, root).rstrip("/")
    where = [F.struct("file", F.col("_block").alias("block"), F.col("_row").alias("row")).alias(POSITION)] if position else []
    if options:
        where += [F.col("path").alias("_path"), F.col("own").alias("_own"), F.lit(width).alias("_width"), F.col("_record"),
                  F.concat_ws(",", *[F.coalesce(F.col(f"_c{cell}"), F.lit("")) for cell in range(width)]).alias("_text")]
    return rows.select(source_tag(F.col("path"), base).alias(SOURCE),
                       *[column(own).alias(spelled[key]) for key, own in places.items()], *where)


def read_tolerant(spark: SparkSession, root: str, required: Sequence[str] = ("body",), multi_line: bool = True,
                  name: str = "comments.csv") -> tuple[DataFrame, DataFrame]:
    """What can be read of the files called ``name`` below ``root``, and a table of what cannot.

    The first frame is that of ``merge_comments`` without the rows that hold more cells than their header. The second has
    ``path, problem, record``: one row for a file that cannot be read or lacks a required column, and one for every
    such row, with its text. A file that breaks off in the middle gives the rows before the break. Empty files are none to Spark.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(
        require_file(spark, root)).select(decoded_path(F.col("path")).alias("path"))
    files = materialise(file_table(spark, root, name, ignoreCorruptFiles=True), "files")
    known = files.select("path", header_cells(F.col("header")).alias("cells"))
    missing = F.array_except(F.array(*map(F.lit, required)), "cells")
    problem = (F.when(F.col("cells").isNull(), "file cannot be read")
               .when(F.size(missing) > 0, F.concat(F.lit("no column "), F.array_join(missing, ", "))))
    broken = listed.join(known, "path", "left").select("path", problem.alias("problem"), F.lit("").alias("record"))
    broken = materialise(broken.filter(F.col("problem").isNotNull()), "broken-files")
    sound = materialise(files.join(broken, "path", "left_anti"), "sound-files")
    merged = _merge(spark, root, sound, name, multi_line, True, ignoreCorruptFiles=True)
    # Spark gives the text of records whose number of cells is not that of the widest header
    plain = F.regexp_replace(F.rtrim(F.col("_record"), F.lit("\r\n")), '"(?:[^"]|"")*"', "")
    cells = F.when(F.col("_record").isNull(), F.col("_width")).otherwise(F.length(F.regexp_replace(plain, "[^,]", "")) + 1)
    checked = materialise(merged.withColumn("_cells", cells), "checked-rows")  # Spark parses such texts for one use only
    wide = checked.filter(F.col("_cells") > F.col("_own")).select(
        F.col("_path").alias("path"), F.format_string("%d cells for %d columns", "_cells", "_own").alias("problem"),
        F.coalesce(F.rtrim("_record", F.lit("\r\n")), "_text").alias("record"))
    rows = checked.filter(F.col("_cells") <= F.col("_own")).drop("_cells", "_own", "_width", "_record", "_text", "_path", POSITION)
    return rows, broken.unionByName(wide)


def header_cells(header: Column) -> Column:
    """Names in a header line, without the quotes around them."""
    return F.transform(F.regexp_extract_all(header, F.lit(r'(?:"(?:[^"]|"")*"|[^,])+'), F.lit(0)),
                       lambda cell: F.regexp_replace(F.regexp_replace(cell, '^"|"$', ""), '""', '"'))


def merge_counts(merged: DataFrame) -> DataFrame:
    """Files and rows of a frame read with ``position=True``."""
    return merged.agg(
        F.count_distinct(F.col(f"{POSITION}.file")).alias("files"),
        F.count(F.lit(1)).alias("rows"),
    )


def source_tag(path: Column, root: str) -> Column:
    """First folder below ``root``; the root's own name for files directly in it."""
    base = root.rstrip("/")
    bare = base.split(":", 1)[-1].lstrip("/")
    rest = F.regexp_extract(path, f"/\\Q{bare}\\E/+(.*)$", 1)
    return F.when(rest.contains("/"), F.substring_index(rest, "/", 1)).otherwise(F.lit(posixpath.basename(base)))


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; cells of columns a frame lacks are blank."""
    if not frames:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).na.fill("")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header and minimal quoting; blanks at cell ends are kept."""
    (df.write.mode(mode).options(**_CSV)
     .option("emptyValue", "").option("nullValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def suffixed(path: str, suffix: str) -> str:
    """Default output name: ``x.csv`` with ``_labeled`` becomes ``x_labeled.csv``."""
    stem, extension = posixpath.splitext(path.rstrip("/"))
    return f"{stem}{suffix}{extension}"


def write_output(df: DataFrame, source: str, suffix: str, output: str | None = None, inplace: bool = False) -> str:
    """Write to ``output``, to the suffixed source name, or over the source itself.

    What exists is not touched: the rows become its next version (see ``versions``), so they may come from what they
    replace, and a failure leaves that as it was. Only a single plain file, which can have no versions, is replaced
    by the finished rows.
    """
    spark = df.sparkSession
    target = source if inplace else output or suffixed(source, suffix)
    if not exists(spark, target):
        write_csv(df, target)
        return target
    if not inplace:
        warnings.warn(f"replacing {target}", stacklevel=2)
    if is_file(spark, target):
        fresh = beside(target)
        write_csv(df, fresh)
        swap_into(spark, fresh, target)
    else:
        versions.overwrite(df, target, write_csv)
    return target


def _directory_header(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    return spark.read.options(**_CSV).option("inferSchema", False).csv(list(paths)).columns
