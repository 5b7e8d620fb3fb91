import datetime
import html
import re
import time

import pytest
from pyspark.sql import functions as F

from civicsift.functions import segments as seg
from civicsift.functions.rules import PatternSpec
from civicsift.operators import mask
from civicsift.operators.label import label_comments
from civicsift.streaming import scan

SPECS = [PatternSpec("insult", r"\bidiots?\b"), PatternSpec("obscene", r"\bscum\b")]
SCORER = mask.rule_scorer(SPECS)


def masked_text(text):
    """Independent form of the sentence rule."""
    parts = re.findall(r"[^.!?\n\r]+[.!?…]*\s*", text) or [text]
    out, hit = [], False
    for part in parts:
        labels = ["toxic"] if re.search(r"\b(idiots?|scum)\b", part, re.I) else []
        labels += ["obscene"] if re.search(r"\bscum\b", part, re.I) else []
        labels += ["insult"] if re.search(r"\bidiots?\b", part, re.I) else []
        if labels and part.strip():
            hit = True
            trail = part[len(part.rstrip()):]
            out.append(f"<this sentence was removed for {', '.join(labels)}>{trail}")
        else:
            out.append(part)
    return "".join(out) if hit else text


TEXTS = [
    "", "Fine.", "You idiot! Bye.", "...Hello idiot. ", "A\nidiots\n\nB", "scum idiot?! ok", "what… idiot… yes", "!!!",
    "idiot", "  idiot  . x", "fine\r\nidiot\r\nfine", "x. scum",
]


def test_texts_are_masked_by_sentence(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r["id"]: r["masked"] for r in mask.mask_texts(frame, SCORER, "id").collect()}
    assert [got[i] for i in range(len(TEXTS))] == [masked_text(t) for t in TEXTS]


HIT = '<span data-masked="placeholder">&lt;this sentence was removed for toxic, insult&gt;</span>'
PAGES = {
    "plain": ("<p>ok</p>", "<p>ok</p>"),
    "hit": ("<p>You <b>idiot</b> ok. idiots. yes</p>",
            '<p>You <b><span data-masked="placeholder">&lt;this sentence was removed for toxic, insult&gt;</span></b>'
            ' ok. <span data-masked="placeholder">&lt;this sentence was removed for toxic, insult&gt; </span>yes</p>'),
    "opaque": ("<head><title>idiot</title></head><script>idiot</script><style>idiot</style><!-- idiot -->"
               "<noscript>idiot</noscript><textarea>idiot</textarea><input value='idiot > x'>",) * 2,
    "open script": ("<p>a</p><script>idiot", "<p>a</p><script>idiot"),
    "editable": ('<div contenteditable="true">idiot <div>idiot</div> idiot</div>',) * 2,
    "not editable": ('<p contenteditable="false">fine</p>',) * 2,
    "entity": ("<i>a &amp; b. id&#105;ot &lt;x&gt;</i>",
               '<i>a &amp; b. <span data-masked="placeholder">&lt;this sentence was removed for toxic, insult&gt;</span></i>'),
    "kept entity": ("<i>a &amp; b &nbsp; &foo;</i>",) * 2,
    "head without end": ("<head><title>idiot</title><meta x><body><p>idiot</p>", f"<head><title>idiot</title><meta x><body><p>{HIT}</p>"),
    "header": ("<script>idiot</script ><header>idiot</header>", f"<script>idiot</script ><header>{HIT}</header>"),
    "void": ('<input contenteditable="true"><p>idiot</p>', f'<input contenteditable="true"><p>{HIT}</p>'),
    "nested": ('<div contenteditable="true">idiot<p contenteditable="false">idiot<p>idiot</p></p>idiot</div>idiot',
               f'<div contenteditable="true">idiot<p contenteditable="false">{HIT}<p>{HIT}</p></p>idiot</div>{HIT}'),
    "apostrophe": ("<p title=it's>idiot</p><p title='a > b'>it's idiot</p>", f"<p title=it's>{HIT}</p><p title='a > b'>{HIT}</p>"),
    "quoted": ('<a title="x > idiot">fine</a>',) * 2,
}


def test_pages(spark):
    frame = spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()], "page_id string, html string")
    masked = mask.mask_pages(frame, SCORER)
    got = {r["page_id"]: r["masked"] for r in masked.collect()}
    for name, (_, expected) in PAGES.items():
        assert got[name] == expected, name
    again = mask.mask_pages(masked.select("page_id", F.col("masked").alias("html")), SCORER)
    assert {r["page_id"]: r["masked"] for r in again.collect()} == got
    joined = frame.filter(F.array_join(seg.pieces(F.col("html")), "") != F.col("html"))
    assert joined.count() == 0
    nodes = {(r["page_id"], r["text"]) for r in mask.page_nodes(frame).collect()}
    assert ("entity", "a & b. idiot <x>") in nodes and ("editable", "idiot ") not in nodes


def test_long_page_with_an_editable_part(spark):
    page = "<b>idiot</b><i>fine</i>" * 16_000 + '<div contenteditable="true"><b>idiot</b></div>' + "<i>x</i>" * 10
    frame = spark.createDataFrame([("long", page)], "page_id string, html string")
    began = time.monotonic()
    assert mask.page_nodes(frame).count() == 32_010
    assert time.monotonic() - began < 60


def test_unescape_matches_python(spark):
    texts = ["a &amp; b", "&lt;&gt;&quot;&apos;", "&#65;&#x42;&#X43;", "&unknown; & &;", "&#128;&#x96;", "&#0;&#xD800;",
             "&#9999999;", "&#0000000065;&#x00000041;&#00000000000;", "&nbsp;&eacute;&hearts;", "no entity", "&amp;lt;", "&#x1F600;"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["v"] for r in frame.select("i", seg.unescape(F.col("t")).alias("v")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == html.unescape(text), text


@pytest.fixture
def comment_files(spark, tmp_path):
    rows = spark.range(60).select(
        F.col("id"), F.concat(F.when(F.col("id") % 4 == 0, "idiot ").otherwise("fine "), F.col("id")).alias("body"))
    path = str(tmp_path / "in")
    rows.repartition(3).write.parquet(path)
    return rows, path


def test_stream_equals_batch(spark, tmp_path, comment_files):
    rows, path = comment_files
    stream = scan.read_files(spark, path, rows.schema, files_per_batch=1)
    work = lambda batch: batch
    out = str(tmp_path / "out")
    scan.start(scan.label_stream(stream, SPECS), work, out, str(tmp_path / "state"),
               available_now=True).awaitTermination()
    batch = label_comments(rows, SPECS)
    streamed = scan.results(spark, out)
    assert streamed.count() == 60 and streamed.select(batch.columns).exceptAll(batch).count() == 0
    assert scan.batch_counts(spark, out).count() == 3


def test_stream_looks_once_and_survives_restart(spark, tmp_path, comment_files):
    rows, path = comment_files
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = scan.once(scan.read_files(spark, path, rows.schema), ["id"])
        scan.start(stream, lambda batch: batch, out, state, available_now=True).awaitTermination()

    run()
    rows.limit(30).unionByName(rows.withColumn("id", F.col("id") + 1000).limit(5)).write.mode("append").parquet(path)
    run()
    got = scan.results(spark, out)
    assert got.count() == 65 and got.select("id").distinct().count() == 65


def test_event_time_bounds_the_state(spark):
    stream = spark.readStream.format("rate").load()
    assert "DeduplicateWithinWatermark" in scan.once(
        stream, ["value"], "timestamp")._jdf.queryExecution().analyzed().toString()


def test_nothing_starts_if_the_model_does_not_load(spark, tmp_path, comment_files):
    rows, path = comment_files

    def broken():
        raise FileNotFoundError("model")

    before = len(spark.streams.active)
    with pytest.raises(FileNotFoundError):
        scan.score_stream(scan.read_files(spark, path, rows.schema), broken, str(tmp_path / "o"), str(tmp_path / "s"))
    assert len(spark.streams.active) == before


def test_bursts_give_the_last_version_once(spark, tmp_path):
    def at(seconds):
        return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=seconds)

    rows = [("a", at(0), 1), ("a", at(0.2), 2), ("a", at(0.4), 3), ("a", at(5), 4), ("b", at(0.1), 5), ("a", at(60), 6)]
    schema = "item string, ts timestamp, version int"
    spark.createDataFrame(rows[:2], schema).write.parquet(str(tmp_path / "in"))

    def run():
        stream = scan.bursts(scan.read_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema),
                             ["item"], "ts")
        scan.start(stream.select("item", "row.version", "versions"), lambda batch: batch, str(tmp_path / "out"),
                   str(tmp_path / "state"), available_now=True).awaitTermination()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    run()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    spark.createDataFrame(rows[2:], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # the burst of the first run goes on in the second
    got = sorted(tuple(r) for r in scan.results(spark, str(tmp_path / "out")).collect())
    assert got == [("a", 3, 3), ("a", 4, 1), ("b", 5, 1)]
    assert scan.state_rows(spark, str(tmp_path / "state")).count() >= 1
