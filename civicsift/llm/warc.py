"""WARC archives with revisit records and a two-level capture index.

Pages are written as gzip members of WARC files by the tasks that hold them. A payload that was seen
before becomes a revisit record that names the response. The index sorts captures by reversed-host url
key into compressed blocks; a sparse directory holds the first key of every block. A lookup binary-searches the
list of shards, then the shard's directory, reads and searches one block, and reads the record's range.

Everything lies in the shared folder. A task attempt writes files of its own name, and only files named by a
finished attempt's rows are ever read, so lost and repeated tasks do no harm.

Defined cases: a null html has an empty payload; a null url has the key ``)``. Control characters and blanks in
urls are percent-encoded in archives and keys. Records under ``LEAST_REVISIT`` bytes and records without an
id are responses. Rows that repeat the largest id of their payload are all responses. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicsift.llm.common import named, text_or_empty
from civicsift.llm.exact_dedup import filter_bits, mark_repeats, repeat_filter
from civicsift.llm.url_filter import host_of
from civicsift.operators.prefix import spread_lookup
from civicsift.session import materialise, scratch_path

LEAST_REVISIT = 1000
FILE_BYTES = 256 << 20
BLOCK_LINES = 512
CAPTURE_DATE = "2024-01-01T00:00:00Z"  # the pages carry no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ODD = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: Column) -> Column:
    """``https://blog.example.com/a?b`` -> ``com,example,blog)/a?b``, bytes outside printing ASCII kept."""
    host = host_of(url)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3 + F.length(host), F.length(url))).otherwise(url)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.regexp_replace(key, r"[\x00-\x20\x7f]", "%20")


def resolve_revisits(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: the page a revisit refers to, null for responses.

    Payloads that are unique for certain by the Bloom filter of their digests are not shuffled.
    """
    payload = F.encode(text_or_empty(named(pages, html_column)), "UTF-8")
    rows = pages.select(
        named(pages, id_column).alias("page_id"), named(pages, url_column).alias("url"),
        payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.filter(F.octet_length("payload") >= LEAST_REVISIT)
    digests = materialise(large.select("digest", "page_id"), "payload-digests")
    total = digests.count()
    bits = filter_bits(total)
    words = materialise(repeat_filter(digests, "digest", bits), "payload-filter")
    n_words = words.count()
    groups = (mark_repeats(digests, "digest", words, n_words, bits).filter("maybe_repeated")
              .groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.max("page_id").alias("response"))
              .filter("rows > 1 and response is not null"))
    marked = mark_repeats(rows, "digest", words, n_words, bits)
    repeated = F.col("maybe_repeated") & (F.octet_length("payload") >= LEAST_REVISIT)
    looked_up = spread_lookup(marked.filter(repeated).drop("maybe_repeated"), groups, "digest", "rows", total,
                              spread_on=["page_id"])
    refers = F.when(F.col("page_id") != F.col("response"), F.col("response"))
    single = marked.filter(~repeated).drop("maybe_repeated").withColumn("refers_to", F.lit(None).cast("long"))
    return single.unionByName(looked_up.withColumn("refers_to", refers).drop("response"))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = _ODD.sub(lambda odd: f"%{ord(odd[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", CAPTURE_DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"),
        *([] if refers_to is None else [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields of a record, of its HTTP block, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write_archives(resolved: DataFrame, folder: str) -> DataFrame:
    """Write one or more archives per task; ``key, page_id, file, offset, length`` of every record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                files, offsets, lengths = [], [], []
                columns = [batch.column(name).to_pylist() for name in ("page_id", "url", "payload", "digest", "refers_to")]
                for row in zip(*columns, strict=True):
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{at}/{name}", compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record(*row)) + packer.flush()
                    out.write(member)
                    files.append(name)
                    offsets.append(offset)
                    lengths.append(len(member))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("page_id"), pa.array(files, pa.string()),
                     pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    ["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    rows = resolved.withColumn("key", url_key(F.coalesce("url", F.lit(""))))
    return rows.mapInArrow(write, "key string, page_id long, file string, offset long, length long")


def _order(key: str, page_id: int | None) -> tuple[bytes, int, int]:
    """Sort order of captures: key bytes, then id, a null id first."""
    return key.encode(), page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures into shards of compressed blocks with a directory; ``shard, key, page_id`` where each begins."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        name, directory, lines, offset, out = uuid.uuid4().hex, [], [], 0, None

        def close_block() -> None:
            nonlocal offset, lines
            block = zlib.compress("\n".join(json.dumps(line) for line in lines).encode())
            directory.append([*lines[0][:2], offset, len(block)])
            out.write(block)
            offset, lines = offset + len(block), []

        for batch in batches:
            for line in zip(*(batch.column(n).to_pylist() for n in ("key", "page_id", "file", "offset", "length")), strict=True):
                out = out or store.open_output_stream(f"{at}/{name}.blocks", compression=None)
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    close_block()
        if lines:
            close_block()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{at}/{name}.directory", compression=None) as file:
                file.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([directory[0][0]], pa.string()), pa.array([directory[0][1]], pa.int64())],
                ["shard", "key", "page_id"])

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(write, "shard string, key string, page_id long")


class CaptureIndex:
    """Finds captures and reads their records; holds one directory and one block at a time."""

    def __init__(self, archives: str, index: str, shards: list[tuple[str, str, int | None]]) -> None:
        self.archives, self.index = _store(archives), _store(index)
        self.shards = sorted(shards, key=lambda shard: _order(*shard[1:]))
        self.starts = [_order(*shard[1:]) for shard in self.shards]
        self.directory = lru_cache(maxsize=2)(self._directory)
        self.block = lru_cache(maxsize=2)(self._block)
        self.archive = lru_cache(maxsize=64)(lambda name: self.archives[0].open_input_file(f"{self.archives[1]}/{name}"))

    def _directory(self, shard: int) -> tuple[list[tuple], list[list]]:
        with self.index[0].open_input_file(f"{self.index[1]}/{self.shards[shard][0]}.directory") as file:
            entries = json.loads(zlib.decompress(file.read()))
        return [_order(*entry[:2]) for entry in entries], entries

    def _block(self, shard: int, at: int) -> tuple[list[tuple], list[list]]:
        _, _, offset, length = self.directory(shard)[1][at]
        with self.index[0].open_input_file(f"{self.index[1]}/{self.shards[shard][0]}.blocks") as file:
            file.seek(offset)
            lines = [json.loads(line) for line in zlib.decompress(file.read(length)).split(b"\n")]
        return [_order(*line[:2]) for line in lines], lines

    def find(self, key: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of all captures with this key and id."""
        wanted = _order(key, page_id)
        shard = max(bisect.bisect_left(self.starts, wanted) - 1, 0)
        while shard < len(self.shards) and (self.starts[shard] <= wanted):
            starts, _ = self.directory(shard)
            at = max(bisect.bisect_left(starts, wanted) - 1, 0)
            while at < len(starts) and starts[at] <= wanted:
                orders, lines = self.block(shard, at)
                for line in range(bisect.bisect_left(orders, wanted), bisect.bisect_right(orders, wanted)):
                    yield tuple(lines[line][2:])
                at += 1
            shard += 1

    def read(self, file: str, offset: int, length: int) -> bytes:
        """The record at a range of an archive."""
        source = self.archive(file)
        source.seek(offset)
        return zlib.decompress(source.read(length), 31)


def read_captures(requests: DataFrame, archives: str, index: str, shards: list[tuple[str, str, int | None]]) -> DataFrame:
    """Look up ``key, page_id`` requests and read their records; digests are those of the bytes read.

    For a revisit, length and digest are those its record states for the full payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        captures = CaptureIndex(archives, index, shards)
        for batch in batches:
            out: list[tuple] = []
            for key, page_id in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                for place in captures.find(key, page_id):
                    fields, http, payload = parse(captures.read(*place))
                    revisit = fields["WARC-Type"] == "revisit"
                    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    digest = stated if revisit else hashlib.sha1(payload).hexdigest()
                    if digest != stated or not revisit and len(payload) != int(http["Content-Length"]):
                        raise ValueError(f"damaged record {place}")
                    out.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(http["Content-Length"]),
                                digest, fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None,
                                None if revisit else payload))
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            columns = zip(*out, strict=True) if out else ([] for _ in names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], names)

    ordered = requests.distinct().repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, "
                                    "record_type string, refers_to long, payload binary")


def _page(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def archive_and_read(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
                     html_column: str = "html") -> DataFrame:
    """Write all ``pages`` to archives, index them, and read every capture back through the index."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    archives, index = f"{folder}/archives", f"{folder}/index"
    resolved = resolve_revisits(pages, id_column, url_column, html_column)
    captures = materialise(write_archives(resolved, archives), "captures")
    shards = [tuple(row) for row in materialise(write_index(captures, index), "shards").collect()]  # one row a shard
    requests = pages.select(url_key(F.coalesce(named(pages, url_column), F.lit(""))).alias("key"),
                            named(pages, id_column).alias("page_id"))
    return read_captures(requests, archives, index, shards)
