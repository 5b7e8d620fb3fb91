"""Model artifacts: tables for Spark jobs and the JSON bundle other clients read."""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicsift.constants import VOCABULARY_SHARD
from civicsift.functions.text import strip
from civicsift.operators.model import CLASSIFIER, TextModel
from civicsift.operators.tfidf import VectorizerSettings
from civicsift.session import materialise, scratch_path
from civicsift.sources import versions
from civicsift.sources.files import exists, publish, require_file, write_document
from civicsift.sources.lines import decoded_path, first_line, numbered_lines, write_lines

# fixed values: file names of the JSON bundle
METADATA = "metadata.json"
THRESHOLDS = "thresholds.json"
LABEL_LINES = "labels.txt"
COEFFICIENTS = "classifier_coefficients.json"
INTERCEPTS = "classifier_intercepts.json"
COMBINED = "vocabulary_combined.json"

# fixed values: the ends of the lines before which entries stand a line each
_IDF, _END = '"idf": [', "]}}"
_ROW_STARTS = ("[[", "],[")

_NUMBERS = ["BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"]


def save_model(model: TextModel, folder: str) -> None:
    """Parquet vocabulary with weights, and one small JSON document for everything else."""
    spark = model.vocabulary.sparkSession
    document = {
        "labels": model.labels, "thresholds": model.thresholds, "intercepts": model.intercepts,
        "terms": model.terms, "settings": asdict(model.settings), "classifier": model.classifier,
    }

    def write(path: str) -> None:
        model.vocabulary.write.parquet(f"{path}/vocabulary")
        _write_json(spark, document, f"{path}/model.json")

    versions.commit(spark, folder, write)


def load_model(spark: SparkSession, folder: str) -> TextModel:
    """The latest version saved in ``folder``."""
    folder = versions.folder_of(spark, require_file(spark, folder))
    text = read_text(spark, f"{folder}/model.json")
    document = json.loads(text)
    settings = dict(document["settings"])
    settings["ngram_range"] = tuple(settings["ngram_range"])
    return TextModel(
        VectorizerSettings(**settings), document["labels"], document["thresholds"], document["intercepts"],
        spark.read.parquet(require_file(spark, f"{folder}/vocabulary")), document["terms"],
        document.get("classifier", dict(CLASSIFIER)),
    )


def export_json(model: TextModel, folder: str, shard: int = VOCABULARY_SHARD, combined: bool = True) -> None:
    """Write the JSON bundle. Its long documents hold an entry a line, so that many tasks write and read them."""
    spark = model.vocabulary.sparkSession
    names = export_vocabulary(model.vocabulary, folder, shard)
    if combined:
        _export_combined(model.vocabulary, f"{folder}/{COMBINED}")
    export_classifier(model, folder)
    _write_json(spark, model.thresholds, f"{folder}/{THRESHOLDS}")
    write_document(_one_row(spark, "\n".join(model.labels)), f"{folder}/{LABEL_LINES}")
    settings = asdict(model.settings)
    stop_words = sorted(settings.pop("stop_words")) if settings["stop_words"] else settings.pop("stop_words")
    head = {
        "labels": model.labels, "thresholds": model.thresholds,
        "classifier": {
            "coefficients_file": COEFFICIENTS, "intercepts_file": INTERCEPTS, **model.classifier,
            "n_classes": len(model.labels), "n_features": model.terms,
        },
        "vectorizer": {
            **settings, "ngram_range": list(settings["ngram_range"]), "stop_words": stop_words,
            "vocabulary_size": model.terms, "vocabulary_files": names,
            "combined_vocabulary": COMBINED if combined else None,
        },
    }
    entries = model.vocabulary.select(_place(0), _after_first(F.col("idf").cast("string")))
    write_lines(_between(entries, json.dumps(head)[:-2] + ", " + _IDF, _END), f"{folder}/{METADATA}")


def _place(section: int | Column) -> Column:
    return F.struct(F.lit(section).cast("int").alias("section"), F.col("idx").cast("long").alias("idx")).alias("place")


def _after_first(entry: Column) -> Column:
    """An entry of a list, with the comma before it; indices count from 0."""
    return F.concat(F.when(F.col("idx") == 0, F.lit("")).otherwise(F.lit(",")), entry).alias("value")


def _between(entries: DataFrame, start: str, end: str, last: int = 0) -> DataFrame:
    """``place, value`` with a line before all entries and one after them; ``last`` is their greatest section."""
    edges = entries.sparkSession.createDataFrame([(-1, 0, start), (last + 1, 0, end)], "section int, idx long, value string")
    return entries.unionByName(edges.select(F.struct("section", "idx").alias("place"), "value"))


def export_vocabulary(vocabulary: DataFrame, folder: str, shard: int = VOCABULARY_SHARD) -> list[str]:
    """``vocabulary_001.json`` and so on, ``shard`` terms each in index order; returns the names."""
    spark = vocabulary.sparkSession
    shards = _shard_rows(vocabulary, shard).select("shard", F.concat(F.lit("{"), F.col("cells"), F.lit("}")).alias(
        "value"))
    scratch = scratch_path(spark, "shards")
    shards.write.partitionBy("shard").text(scratch)
    numbers = sorted(row["shard"] for row in spark.read.text(scratch).select("shard").distinct().collect())
    names = []
    for number in numbers:
        name = f"vocabulary_{number:03d}.json"
        publish(spark, f"{scratch}/shard={number}", f"{folder}/{name}")
        names.append(name)
    return names


def export_classifier(model: TextModel, folder: str) -> None:
    """Coefficient matrix (one row of the document per label) and intercepts."""
    spark = model.vocabulary.sparkSession
    labels = len(model.labels)
    cells = model.vocabulary.select("idx", F.posexplode("coef").alias("label", "coef"))
    entries = cells.select(_place(F.col("label")), _after_first(F.col("coef").cast("string")))
    starts = spark.createDataFrame([(label, -1, _ROW_STARTS[1]) for label in range(1, labels)], "section int, idx long, value string")
    rows = entries.unionByName(starts.select(F.struct("section", "idx").alias("place"), "value"))
    write_lines(_between(rows, _ROW_STARTS[0], "]]", labels), f"{folder}/{COEFFICIENTS}")
    _write_json(spark, model.intercepts, f"{folder}/{INTERCEPTS}")


def load_json(spark: SparkSession, folder: str) -> TextModel:
    """Read a JSON bundle, with the defaults, fallbacks and shape checks its other readers use."""
    metadata = _metadata(spark, f"{folder}/{METADATA}")
    vectorizer = metadata["vectorizer"]
    if vectorizer is None:
        raise ValueError("vectorizer metadata missing")
    thresholds = _map(spark, f"{folder}/{THRESHOLDS}")
    if thresholds is None:
        thresholds = metadata["thresholds"] or {}
    labels = read_lines(spark, f"{folder}/{LABEL_LINES}") or list(metadata["labels"] or []) or list(thresholds)
    if not labels:
        raise ValueError("no labels found in artifacts")
    intercepts = _document(spark, f"{folder}/{INTERCEPTS}", "array<double>").first()[0]
    cells, rows = _matrix(spark, f"{folder}/{COEFFICIENTS}")
    if rows != len(labels) or len(intercepts) != len(labels):
        raise ValueError("classifier shapes do not match the number of labels")
    vocabulary = load_vocabulary(spark, folder, vectorizer["vocabulary_files"] or [])
    idf = _idf(spark, f"{folder}/{METADATA}")
    by_label = [F.max(F.when(F.col("label") == i, F.col("coef"))) for i in range(len(labels))]
    coefficients = cells.groupBy("idx").agg(F.array(*by_label).alias("coef"))
    zeros = F.array(*[F.lit(0.0) for _ in labels])
    table = vocabulary.join(idf, "idx", "left").join(coefficients, "idx", "left").select(
        "term", "idx", "idf", F.coalesce("coef", zeros).alias("coef"))
    fitted = metadata["classifier"].asDict() if metadata["classifier"] else {}
    classifier = {name: value if fitted.get(name) is None else fitted[name] for name, value in CLASSIFIER.items()}
    table = materialise(table, "bundle")  # else every use of the model would read the documents again
    return TextModel(_settings(vectorizer), labels, thresholds, intercepts, table, table.count(), classifier)


def _idf(spark: SparkSession, path: str) -> DataFrame:
    """``idx, idf``; from lines, or from a document of another writer as a whole."""
    if not first_line(spark, path).endswith(_IDF):
        return spark.read.schema(_METADATA).json(path, multiLine=True).select(F.posexplode("vectorizer.idf").alias("idx", "idf"))
    lines = numbered_lines(spark, path, line_break="\n").filter((F.col("line") > 1) & (F.col("raw") != _END))
    return lines.select((F.col("line") - 2).alias("idx"), F.ltrim("raw", F.lit(",")).cast("double").alias("idf"))


def _matrix(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``label, idx, coef`` and the number of labels; from lines, or from a document of another writer as a whole."""
    if first_line(spark, require_file(spark, path)) != _ROW_STARTS[0]:
        matrix = _document(spark, path, "array<array<double>>")
        cells = matrix.select(F.posexplode("value").alias("label", "row")).select("label", F.posexplode("row").alias("idx", "coef"))
        return cells, matrix.select(F.size("value")).first()[0]
    lines = numbered_lines(spark, path, line_break="\n")
    # a line per label
    starts = sorted(row["line"] for row in lines.filter(F.col("raw").isin(*_ROW_STARTS)).select("line").collect())
    before = F.filter(F.array(*[F.lit(start) for start in starts]), lambda start: start < F.col("line"))
    cells = lines.filter(~F.col("raw").isin(*_ROW_STARTS, "]]")).select(
        (F.size(before) - 1).alias("label"), (F.col("line") - F.element_at(before, -1) - 1).alias("idx"),
        F.ltrim("raw", F.lit(",")).cast("double").alias("coef"))
    return cells, len(starts)


def load_vocabulary(spark: SparkSession, folder: str, names: Sequence[str] = ()) -> DataFrame:
    """``(term, idx)`` of all shards; the combined file serves where no shards are listed.

    Entries whose index is not a number are skipped, missing shards give a warning, later
    shards win for repeated terms, and nothing at all is an error.
    """
    present = []
    for name in names or [COMBINED]:
        if exists(spark, f"{folder}/{name}"):
            present.append(name)
        else:
            warnings.warn(f"vocabulary file {name} is missing", stacklevel=2)
    if present:
        order = F.array_position(F.array(*map(F.lit, present)), F.element_at(F.split("file", "/"), -1))
        cells = _object_cells(spark, [f"{folder}/{name}" for name in present])
        numeric = F.schema_of_variant("cell")
        cells = cells.filter(numeric.isin(_NUMBERS) | numeric.startswith("DECIMAL"))
        numbered = cells.select("term", order.alias("shard"), F.try_variant_get("cell", "$", "double").cast("long").alias("idx"))
        table = numbered.groupBy("term").agg(F.max_by("idx", "shard").alias("idx"))
        if not table.isEmpty():
            return table
    raise ValueError("vocabulary appears empty")


def _object_cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, term, cell`` of JSON objects. A line that holds whole entries is read alone, so that a large file is
    read by many tasks; files with other lines are read as one text each."""
    def cells_of(texts: DataFrame, body: Column) -> DataFrame:
        cells = F.from_json(body, "map<string,variant>", {"mode": "PERMISSIVE"})
        return texts.select("file", "value", cells.alias("cells"))

    def named(texts: DataFrame) -> DataFrame:
        return texts.select(decoded_path(F.col("_metadata.file_path")).alias("file"), "value")

    inner = F.regexp_replace(F.regexp_replace("value", r"^\s*[{,]?\s*", ""), r"\s*[,}]?\s*$", "")
    by_line = cells_of(named(spark.read.text(paths)), F.concat(F.lit("{"), inner, F.lit("}")))
    odd = [row["file"] for row in by_line.filter(F.col("cells").isNull()).select("file").distinct().collect()]  # of the files given
    found = by_line.filter(~F.col("file").isin(odd)) if odd else by_line
    if odd:
        found = found.unionByName(cells_of(named(spark.read.text(odd, wholetext=True)), F.col("value")))
    return found.select("file", F.explode("cells").alias("term", "cell"))


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Trimmed non-blank lines; no file, no lines."""
    if not exists(spark, path):
        return []
    return [line.strip() for line in read_text(spark, path).splitlines() if line.strip()]


def read_text(spark: SparkSession, path: str) -> str:
    """A small document as one string."""
    return spark.read.text(require_file(spark, path), wholetext=True).first()[0]


def line_table(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-blank lines as rows."""
    lines = spark.read.text(require_file(spark, path)).select(strip(F.col("value")).alias("value"))
    return lines.filter(F.col("value") != "")


_VECTORIZER = (
    "struct<ngram_range:array<double>,min_df:string,max_df:string,sublinear_tf:boolean,use_idf:boolean,"
    "smooth_idf:boolean,norm:string,lowercase:boolean,token_pattern:string,stop_words:array<string>,"
    "binary:boolean,vocabulary_size:long,vocabulary_files:array<string>,idf:array<double>>"
)
_CLASSIFIER = "struct<solver:string,penalty:string,C:double,max_iter:int>"
_METADATA = (f"labels array<string>, thresholds map<string,double>, classifier {_CLASSIFIER}, "
             f"vectorizer {_VECTORIZER}")


def _metadata(spark: SparkSession, path: str):
    head = first_line(spark, require_file(spark, path))
    if head.endswith(_IDF):
        frame = _one_row(spark, head + _END).select(F.from_json("value", _METADATA).alias("all")).select("all.*")
    else:
        frame = spark.read.schema(_METADATA).json(path, multiLine=True)
    without_idf = F.when(F.col("vectorizer").isNotNull(), F.col("vectorizer").dropFields("idf"))
    return frame.select("labels", "thresholds", "classifier", without_idf.alias("vectorizer")).first()


def _settings(raw) -> VectorizerSettings:
    span = [int(n) for n in (raw["ngram_range"] or []) if n is not None]
    low = span[0] if span else 1
    high = span[1] if len(span) > 1 else low
    return VectorizerSettings(
        ngram_range=(low, high),
        min_df=_count(raw["min_df"]), max_df=_count(raw["max_df"]),
        sublinear_tf=bool(raw["sublinear_tf"]), use_idf=bool(raw["use_idf"]), smooth_idf=bool(raw["smooth_idf"]),
        norm=raw["norm"] if raw["norm"] in ("l1", "l2") else None,
        lowercase=bool(raw["lowercase"]), binary=bool(raw["binary"]),
        token_pattern=raw["token_pattern"], stop_words=raw["stop_words"],
    )


def _count(value: str | None) -> float:
    """A cut-off as its JSON number says: 1 counts documents, 1.0 is a share."""
    return 1 if value is None else int(value) if value.lstrip("-").isdigit() else float(value)


def _map(spark: SparkSession, path: str) -> dict[str, float] | None:
    if not exists(spark, path):
        return None
    return _document(spark, path, "map<string,double>").first()[0]


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    text = spark.read.text(require_file(spark, path), wholetext=True)
    return text.select(F.from_json("value", schema).alias("value"))


def _shard_rows(vocabulary: DataFrame, shard: int) -> DataFrame:
    """``(shard, cells)``: at most ``shard`` entries of a JSON object each, in index order."""
    number = (F.floor(F.col("idx") / F.lit(shard)) + 1).cast("int")
    grouped = vocabulary.groupBy(number.alias("shard")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "term"))).alias("entries"))
    cells = F.to_json(F.map_from_entries(F.transform(
        "entries", lambda entry: F.struct(entry["term"].alias("key"), entry["idx"].alias("value")))))
    return grouped.select("shard", cells.alias("object")).select(
        "shard", F.substring(F.col("object"), F.lit(2), F.length("object") - 2).alias("cells"))


def _export_combined(vocabulary: DataFrame, path: str) -> None:
    """All entries as one object, an entry a line."""
    entry = F.to_json(F.create_map("term", "idx"))
    bare = F.substring(entry, F.lit(2), F.length(entry) - 2)
    write_lines(_between(vocabulary.select(_place(0), _after_first(bare)), "{", "}"), path)


def _one_row(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "value string")


def _write_json(spark: SparkSession, value, path: str) -> None:
    write_document(_one_row(spark, json.dumps(value)), path)
