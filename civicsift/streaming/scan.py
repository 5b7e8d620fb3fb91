"""Streams of comments and pages, each item looked at once.

The file sink of a micro-batch is a folder named after the batch and replaced as a whole, so a
batch that is run again after a failure leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from civicsift.functions.rules import PatternSpec
from civicsift.operators.label import label_comments
from civicsift.operators.mask import Scorer, mask_pages
from civicsift.operators.model import TextModel, predict
from civicsift.session import materialise

# fixed values: pause between two looks at the input
PAUSE = "250 milliseconds"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet",
               files_per_batch: int | None = None, **options: str) -> DataFrame:
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def once(stream: DataFrame, keys: Sequence[str], event_time: str | None = None,
         delay: str = "1 hour") -> DataFrame:
    """Drop items seen before.

    With an event time the keys are forgotten after ``delay``; without one they are kept for
    good, in a state store that reaches beyond memory (see ``start``).
    """
    if event_time is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def bursts(stream: DataFrame, keys: Sequence[str], event_time: str, pause: str = PAUSE, delay: str = "0 seconds") -> DataFrame:
    """The last version of every item of a burst, so that it is looked at once however often it changes.

    Versions of an item no more than ``pause`` apart are one burst. It is given out once the watermark, the latest event time
    less ``delay``, has passed its end; then its state goes. Of versions at one time the greatest row is taken. Columns: the keys,
    ``row`` (the other columns of that version), ``started`` and ``versions``.
    """
    rest = F.struct(*[F.col(name) for name in stream.columns if name not in keys])
    timed = stream.withWatermark(event_time, delay)
    grouped = timed.groupBy(*keys, F.session_window(event_time, pause).alias("_burst")).agg(
        F.max(F.struct(F.col(event_time).alias("at"), rest.alias("row"))).alias("_last"), F.count(F.lit(1)).alias("versions"))
    return grouped.select(*keys, F.col("_last.row").alias("row"), F.col("_burst.start").alias("started"), "versions")


def state_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stream keeps in its state store after its last batch, read from its checkpoint."""
    return spark.read.format("statestore").load(checkpoint)


@contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """State of streams started inside is kept in RocksDB instead of executor memory; other streams are left as they are."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def label_stream(stream: DataFrame, patterns: Sequence[PatternSpec], **options) -> DataFrame:
    """Rule labels are row-local and work on a stream as they are."""
    return label_comments(stream, patterns, **options)


def start(stream: DataFrame, work: Callable[[DataFrame], DataFrame], output: str, checkpoint: str,
          available_now: bool = False, pause: str = PAUSE) -> StreamingQuery:
    """Run ``work`` on every micro-batch and write its result below ``output``."""
    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=pause)
    with large_state(stream.sparkSession):  # a stream keeps the settings it was started with
        return writer.start()


def score_stream(stream: DataFrame, load: Callable[[], TextModel], output: str, checkpoint: str,
                 doc: str = "doc_id", text: str = "text", **options) -> StreamingQuery:
    """Score arriving texts. The model is loaded first, and its vocabulary written once for all batches: if
    that fails, nothing is started."""
    model = load()
    model = replace(model, vocabulary=materialise(model.vocabulary, "stream-model"))
    return start(stream, lambda batch: predict(batch, model, doc, text), output, checkpoint, **options)


def mask_stream(stream: DataFrame, load: Callable[[], Scorer], output: str, checkpoint: str,
                key: str = "page_id", page: str = "html", **options) -> StreamingQuery:
    """Mask arriving pages; ``load`` gives the scorer and runs before the stream starts."""
    scorer = load()
    return start(stream, lambda batch: mask_pages(batch, scorer, key, page), output, checkpoint, **options)


def results(spark: SparkSession, output: str) -> DataFrame:
    """Everything written so far, without the batch number."""
    return spark.read.option("recursiveFileLookup", True).parquet(output)


def batch_counts(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(output).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))
