import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civicsift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a \n b", " \n x", "x <|endoftext|> y<|endoftext|>", "<|endoftext|>", "aaaaaaaaa bbbbbbbbbbb",
       "don't we'LL I'm", "\x1c\x1d\x85\xa0  a\x1cb \x1c c", "日本語 テスト", "é 😀😀", "a " * 50, " " * 100, "\t\t\n\n", "1234567 ½ ²", "x" * 5000]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(vocabulary, texts):
    ids, ends = bpe.Encoder(vocabulary).encode(texts)
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def test_ids_equal_the_library(vocabulary, library):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(" \n\t ab'std1.!é\x1c\x85\xa0 日😀") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [" ".join(map(chr, range(start, start + 64))) for start in range(0, 0xD800, 64)]
    assert encoded(vocabulary, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_small_caches_change_nothing(vocabulary, monkeypatch):
    texts = ODD * 3
    before = encoded(vocabulary, texts)
    monkeypatch.setattr(bpe, "PENDING_UNITS", 2)
    monkeypatch.setattr(bpe, "CACHED_UNITS", 3)
    encoder, got = bpe.Encoder(vocabulary), []
    for text in texts:
        ids, _ = encoder.encode([text])
        got.append(ids.tolist())
    assert got == before


def test_decoding_equals_the_library(vocabulary, library):
    rng = random.Random(5)
    lists = [[rng.randrange(50257) for _ in range(rng.randrange(9))] for _ in range(2000)]
    got = bpe.decode_lists(vocabulary, pa.array([*lists, None, [220, None, -1, 10**9]], pa.list_(pa.int32()))).to_pylist()
    assert got[:-2] == [library.decode(ids, skip_special_tokens=False) for ids in lists] and got[-2:] == ["", " "]


def test_round_trip_of_messy_rows(messy, nothing, vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 100)
    rows = messy.withColumn("own_ids", bpe.encode(F.col("text"), vocabulary))
    rows = rows.withColumn("own_text", bpe.decode(F.col("own_ids"), vocabulary)).collect()
    assert len(rows) == messy.count()
    for row in rows:
        assert row.own_ids == library.encode(row.text or "", add_special_tokens=False).ids and row.own_text == (row.text or "")
    both = messy.select("text", bpe.round_trip(F.col("text"), vocabulary).alias("coded")).collect()
    assert sorted((r.text or "", r.coded.ids, r.coded.text) for r in both) == sorted((r.text or "", r.own_ids, r.own_text) for r in rows)
    assert nothing.withColumn("own_ids", bpe.encode(F.col("text"), vocabulary)).collect() == []
