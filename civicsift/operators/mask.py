"""Replacing toxic sentences in texts and in the text nodes of web pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicsift.functions import segments as seg
from civicsift.functions.text import bind, settled
from civicsift.operators.model import TextModel, predict

# takes (segment, text), gives (segment, active_labels)
Scorer = Callable[[DataFrame], DataFrame]

_WORD = "[A-Za-z0-9_]"


def model_scorer(model: TextModel) -> Scorer:
    return lambda rows: predict(rows, model, "segment", "text").select("segment", "active_labels")


def rule_scorer(patterns, **options) -> Scorer:
    """Scores segments with rule labels instead of the model."""
    from civicsift.operators.label import label_comments

    def score(rows: DataFrame) -> DataFrame:
        labeled = label_comments(rows, patterns, body="text", **options)
        return labeled.select("segment", F.filter(F.split("labels", r"\|"), lambda label: label != "").alias(
            "active_labels"))
    return score


def text_segments(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, pos, segment_text)`` of every sentence."""
    return texts.select(key, F.posexplode(seg.sentences(F.col(text))).alias("pos", "segment_text"))


def page_nodes(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """``(key, node, text)``: texts of a page that may be masked, decoded."""
    nodes = pages.select(key, F.explode(_nodes(F.col(page))).alias("_node"))
    return nodes.select(key, F.col("_node.node").alias("node"), F.col("_node.text").alias("text"))


def mask_texts(texts: DataFrame, scorer: Scorer, key: str, text: str = "text", output: str = "masked") -> DataFrame:
    """Add ``output``: the text with active sentences replaced; a text without any is unchanged."""
    rows = text_segments(texts, key, text).select(
        F.struct(F.col(key).alias("key"), F.lit(0).alias("node"), "pos").alias("segment"),
        seg.trim_blank(F.col("segment_text")).alias("text"),
    ).filter(F.col("text") != "")
    masks = _masks(scorer(rows)).withColumnRenamed("key", "_key")
    joined = texts.join(masks, F.col(key) == F.col("_key"), "left")
    rebuilt = _rebuild(seg.sentences(F.col(text)), F.get("_masks", F.lit(0))["parts"], lambda part: part, lambda part: part)
    masked = F.when(F.col("_masks").isNull(), F.col(text)).otherwise(rebuilt)
    return joined.withColumn(output, settled(masked)).drop("_key", "_masks")


def mask_pages(pages: DataFrame, scorer: Scorer, key: str = "page_id", page: str = "html",
               output: str = "masked") -> DataFrame:
    """Add ``output``: the page with active sentences replaced by marked placeholders.

    Only sentences with active labels are grouped by page and joined back; pages without any,
    and all markup, stay as they are byte for byte.
    """
    nodes = page_nodes(pages, key, page)
    rows = nodes.select(key, "node", F.posexplode(seg.sentences(F.col("text"))).alias("pos", "sentence")).select(
        F.struct(F.col(key).alias("key"), "node", "pos").alias("segment"),
        seg.trim_blank(F.col("sentence")).alias("text"),
    ).filter(F.col("text") != "")
    masks = _masks(scorer(rows)).withColumnRenamed("key", "_key")
    joined = pages.join(masks, F.col(key) == F.col("_key"), "left")

    def node_text(piece: Column, parts: Column) -> Column:
        rebuilt = _rebuild(seg.sentences(seg.unescape(piece)), parts, seg.escape, _span)
        return F.when(parts.isNull(), piece).otherwise(rebuilt)

    # pieces and masks go side by side; the last masked piece may be followed by others
    whole = F.array_join(F.zip_with(seg.pieces(F.col(page)), seg.aligned(F.col("_masks"), "node", "parts"), node_text), "")
    masked = F.when(F.col("_masks").isNull(), F.col(page)).otherwise(whole)
    return joined.withColumn(output, settled(masked)).drop("_key", "_masks")


def _nodes(page: Column) -> Column:
    """Eligible text pieces of a page: array of (node, text)."""
    def build(parts: Column) -> Column:
        marked = F.transform(parts, lambda piece, i: F.struct(i.alias("node"), piece.alias("text")))
        texts = F.filter(marked, lambda part: seg.is_text(part["text"]))
        decoded = F.transform(texts, lambda part: F.struct(
            part["node"].alias("node"), seg.unescape(part["text"]).alias("text")))
        return F.filter(decoded, lambda part: part["text"].rlike(_WORD))

    def build_editable(parts: Column) -> Column:
        flags = bind(seg.editable_changes(parts), lambda changes: seg.editable_flags(parts, changes))
        return bind(flags, lambda on: F.filter(build(parts), lambda part: ~F.get(on, part["node"])))

    editable = page.rlike("(?i)contenteditable")
    return bind(
        seg.pieces(page), lambda parts: F.when(editable, build_editable(parts)).otherwise(build(parts)))


def _masks(scored: DataFrame) -> DataFrame:
    """``(key, _masks)``: per text its nodes with active segments, and per node the places and labels of those, in order."""
    active = scored.filter(F.size("active_labels") > 0).select("segment.key", "segment.node", "segment.pos", "active_labels")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "active_labels"))), lambda part: F.struct(
        part["pos"].alias("pos"), part["active_labels"].alias("labels")))
    nodes = active.groupBy("key", "node").agg(parts.alias("parts"))
    return nodes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "parts"))).alias("_masks"))


def _rebuild(sentences: Column, parts: Column, clean: Callable, put: Callable) -> Column:
    """Segments joined again, masked ones replaced."""
    def one(sentence: Column, labels: Column) -> Column:
        return F.when(labels.isNull(), clean(sentence)).otherwise(put(seg.placeholder(sentence, labels)))

    return F.array_join(F.zip_with(sentences, seg.aligned(parts, "pos", "labels"), one), "")


def _span(text: Column) -> Column:
    return F.concat(F.lit(f"<span {seg.MARK}>"), seg.escape(text), F.lit("</span>"))
