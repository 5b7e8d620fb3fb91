"""TF-IDF as grouping and joining of (document, term) rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicsift.functions.text import clean_text, model_tokens
from civicsift.operators.grams import bounded_batches, list_counts, term_list
from civicsift.operators.lookup import looked_up
from civicsift.operators.order import number_as_lying
from civicsift.operators.prefix import spread_lookup
from civicsift.session import materialise

# Vocabularies up to this many terms are broadcast (about 100 bytes a term).
BROADCAST_TERMS = 500_000

# Text in bytes whose terms, if all differ, are one bucket when documents are counted.
BUCKET_BYTES = 8 << 20


@dataclass(frozen=True)
class VectorizerSettings:
    """How texts become weighted terms."""

    ngram_range: tuple[int, int] = (1, 1)
    min_df: float = 1
    max_df: float = 1.0
    sublinear_tf: bool = False
    use_idf: bool = True
    smooth_idf: bool = True
    norm: str | None = "l2"
    lowercase: bool = True
    binary: bool = False
    token_pattern: str | None = None
    stop_words: Sequence[str] | None = None


# fixed values: settings of the published model
BASELINE_SETTINGS = VectorizerSettings(ngram_range=(1, 2), min_df=5, max_df=0.9, sublinear_tf=True)


@dataclass
class Vocabulary:
    """``(term, df, idx, idf)`` and the number of documents and of rows behind it."""

    table: DataFrame
    documents: int
    terms: int
    settings: VectorizerSettings = field(default_factory=VectorizerSettings)


def text_tokens(text: Column, settings: VectorizerSettings) -> Column:
    return model_tokens(clean_text(text), settings.token_pattern, settings.lowercase, settings.stop_words)


def token_source(text: Column, settings: VectorizerSettings) -> tuple[Column, Column]:
    """A plain text to be taken apart by ``plain_tokens``, and the tokens; one of them is null, both for a missing text.

    Plain are texts of ASCII characters only, if tokens are the default ones. Blanks end these in any number, so
    the texts need not be cleaned.
    """
    if settings.token_pattern or settings.stop_words:
        return F.lit(None).cast("string"), text_tokens(text, settings)
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, text), F.when(~plain, model_tokens(text, lowercase=settings.lowercase))


def term_counts(docs: DataFrame, settings: VectorizerSettings, doc: str = "doc_id", text: str = "text",
                keep_empty: bool = False) -> DataFrame:
    """``(doc, term, tf)``; ``keep_empty`` gives documents without terms one row with a null term.

    Terms are counted a batch of texts at a time, so nothing is shuffled and all rows of a document stay in one task.
    ``doc`` must be unique.
    """
    rows = docs.select(F.col(doc), F.col(text).alias("_text"))
    explode = F.explode_outer if keep_empty else F.explode
    bounded_batches(docs.sparkSession)
    source = token_source(F.col("_text"), settings)
    cells = rows.select(doc, explode(term_list(*source, settings.lowercase, *gram_sizes(settings))).alias("_cell"))
    return cells.select(doc, F.col("_cell.term").alias("term"), F.col("_cell.tf").alias("tf"))


def gram_sizes(settings: VectorizerSettings) -> tuple[int, int]:
    low, high = settings.ngram_range
    return max(low, 1), high


def document_frequency(docs: DataFrame, settings: VectorizerSettings, text: str = "text", size: int = 0) -> DataFrame:
    """``(term, df)`` of all terms; each batch of documents is added up first. ``size`` is that of all texts in bytes, about."""
    bounded_batches(docs.sparkSession)
    plain, tokens = token_source(F.col(text), settings)
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, size // BUCKET_BYTES)
    return list_counts(
        docs.select(plain.alias("plain"), tokens.alias("tokens")), *gram_sizes(settings), settings.lowercase, buckets)


def within_limits(df: Column, documents: int, settings: VectorizerSettings) -> Column:
    """Cut-offs: whole numbers count documents, fractions are shares of all documents."""
    low = settings.min_df if isinstance(settings.min_df, int) else settings.min_df * documents
    high = settings.max_df if isinstance(settings.max_df, int) else settings.max_df * documents
    return (df >= F.lit(low)) & (df <= F.lit(high))


def idf_weight(df: Column, documents: int, smooth: bool = True) -> Column:
    add = 1 if smooth else 0
    return F.ln(F.lit(float(documents + add)) / (df + F.lit(add))) + F.lit(1.0)


def tf_weight(tf: Column, settings: VectorizerSettings) -> Column:
    if settings.binary:
        return F.when(tf > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    if settings.sublinear_tf:
        return F.when(tf > 0, F.lit(1.0) + F.ln(tf.cast("double"))).otherwise(F.lit(0.0))
    return tf.cast("double")


def select_terms(docs: DataFrame, settings: VectorizerSettings, text: str = "text") -> tuple[DataFrame, int]:
    """``(term, df, idf)`` within the cut-offs, and the number of documents."""
    documents, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    kept = document_frequency(docs, settings, text, size).filter(within_limits(F.col("df"), documents, settings))
    return kept.withColumn("idf", idf_weight(F.col("df"), documents, settings.smooth_idf)), documents


def number_terms(terms: DataFrame) -> tuple[DataFrame, int]:
    """Add ``idx``: the place of each term in term order, so that no task ever holds the whole vocabulary."""
    terms = materialise(terms, "terms")  # the sort reads it twice
    numbered = number_as_lying(terms.orderBy("term"), "idx", start=0)
    return numbered.select("idx", *terms.columns), numbered.count()


def fit_vocabulary(docs: DataFrame, settings: VectorizerSettings = BASELINE_SETTINGS, text: str = "text") -> Vocabulary:
    """Terms within the cut-offs, numbered in term order, with their idf."""
    kept, documents = select_terms(docs, settings, text)
    table, terms = number_terms(kept)
    return Vocabulary(table.select("term", "df", "idx", "idf"), documents, terms, settings)


def with_vocabulary(counts: DataFrame, table: DataFrame, terms: int, how: str = "inner") -> DataFrame:
    """Attach vocabulary columns to ``(doc, term, ...)`` rows.

    Up to ``BROADCAST_TERMS`` terms the table is broadcast and the rows stay where they are.
    Beyond that the join shuffles by term, frequent terms kept apart if ``df`` is known.
    """
    if terms <= BROADCAST_TERMS:
        return counts.join(F.broadcast(table), "term", how)
    if "df" not in table.columns:
        return counts.join(table, "term", how)
    total = table.agg(F.sum("df")).first()[0]
    return spread_lookup(counts, table, "term", "df", total, how, strategy="shuffle_hash")


def known_terms(docs: DataFrame, settings: VectorizerSettings, table: DataFrame, terms: int, doc: str, text: str,
                labels: int | None = None, **wanted: bool) -> DataFrame:
    """A row for every row of ``docs`` with what ``looked_up`` gives."""
    source = token_source(F.col(text), settings)
    return looked_up(docs, doc, *source, settings, gram_sizes(settings), table, terms, labels, **wanted)


def unique_ids(docs: DataFrame, doc: str) -> bool:
    """Whether no two rows have one id; rows of one document need not be brought together then."""
    return docs.groupBy(doc).count().filter("count > 1").isEmpty()


def weighted_terms(docs: DataFrame, vocabulary: Vocabulary, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, term, idx, value)`` before normalisation."""
    settings = vocabulary.settings
    counts = term_counts(docs, settings, doc, text)
    known = with_vocabulary(counts, vocabulary.table, vocabulary.terms)
    value = tf_weight(F.col("tf"), settings)
    if settings.use_idf:
        value = value * F.coalesce(F.col("idf"), F.lit(1.0))
    return known.select(doc, "term", "idx", value.alias("value"))


def scale(squares: Column, sizes: Column, norm: str | None) -> Column:
    """Factor that brings a vector to length one; 1 for empty vectors."""
    if norm == "l2":
        length = F.sqrt(squares)
    elif norm == "l1":
        length = sizes
    else:
        return F.lit(1.0)
    return F.when(length > 0, F.lit(1.0) / length).otherwise(F.lit(1.0))


def vectors(docs: DataFrame, vocabulary: Vocabulary, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with at least one known term: ``(doc, cells)``.

    ``cells`` is an array of ``(idx, term, value)`` sorted by ``idx``; it is as long as the
    document has known terms.
    """
    if vocabulary.terms > BROADCAST_TERMS:
        found = known_terms(docs, vocabulary.settings, vocabulary.table, vocabulary.terms, doc, text).filter(F.size("_cells") > 0)
        packed = found if unique_ids(docs, doc) else found.groupBy(doc).agg(
            F.sort_array(F.flatten(F.collect_list("_cells"))).alias("_cells"),
            F.sum("_squares").alias("_squares"), F.sum("_sizes").alias("_sizes"))
    else:
        weighted = weighted_terms(docs, vocabulary, doc, text)
        packed = weighted.groupBy(doc).agg(
            F.sort_array(F.collect_list(F.struct("idx", "term", "value"))).alias("_cells"),
            F.sum(F.col("value") * F.col("value")).alias("_squares"),
            F.sum(F.abs("value")).alias("_sizes"),
        )
    factor = scale(F.col("_squares"), F.col("_sizes"), vocabulary.settings.norm)
    scaled = packed.withColumn("_factor", factor)
    cells = F.transform("_cells", lambda cell: F.struct(
        cell["idx"].alias("idx"), cell["term"].alias("term"), (cell["value"] * F.col("_factor")).alias("value")))
    return scaled.select(doc, cells.alias("cells"))


def tfidf(docs: DataFrame, vocabulary: Vocabulary, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, idx, term, value)``: the document-term matrix in long form."""
    whole = Window.partitionBy(doc)
    if vocabulary.terms > BROADCAST_TERMS:
        found = known_terms(docs, vocabulary.settings, vocabulary.table, vocabulary.terms, doc, text)
        squares, sizes = F.col("_squares"), F.col("_sizes")
        if not unique_ids(docs, doc):
            squares, sizes = F.sum("_squares").over(whole), F.sum("_sizes").over(whole)
        factor = scale(squares, sizes, vocabulary.settings.norm)
        scaled = found.withColumn("_factor", factor).select(doc, "_factor", F.inline("_cells"))
        return scaled.select(doc, "idx", "term", (F.col("value") * F.col("_factor")).alias("value"))
    weighted = weighted_terms(docs, vocabulary, doc, text)
    factor = scale(
        F.sum(F.col("value") * F.col("value")).over(whole), F.sum(F.abs("value")).over(whole),
        vocabulary.settings.norm)
    return weighted.select(doc, "idx", "term", (F.col("value") * factor).alias("value"))
