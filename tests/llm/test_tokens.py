import struct
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from textloom.llm.tokens import Encoder, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, tokens string"
TEXTS = [
    "Plain words, and more WORDS; it's they'll DON'T 'S",
    "á é, ́alone ñandú İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ ß ﬁ …!! ?!… x…",
    "tab\tnew\nline\r\n\x0b\x0c nb sp  em  ls \x85nel \x1cfs \x1fus",
    "1234 ١٢ 5kg 3.14 v2.0-rc1 a_b__c (d) [e] {f}. ... --- ***",
    "<|endoftext|> in <|startoftext|> text<|",
    "日本語 テキスト。漢字！ 한국어 👍🏽 👨‍👩‍👧",
    "\x01a \x7f\x02 b\x1b_'s \xad\xa0x\x85y ½² ŁÓDŹ ǅ",
    "w’s l’été “quoted” — dash – x​zero‍width",
    "",
    " \n ",
]


def test_pieces_equal_whole_texts():
    plain, own = Tokenizer.from_file(PATH), Encoder(PATH)
    for text in TEXTS * 2:
        want = plain.encode(text, add_special_tokens=False).ids
        assert list(memoryview(own.encode(text)).cast("I")) == want, text


def test_memory_is_bounded():
    own = Encoder(PATH, memory=10)
    for k in range(20):
        own.encode(f"w{k}a w{k}b, w{k}c")
    assert len(own.known) <= 12


def test_sample_texts_equal_the_tokenizer(spark, sf):
    plain, own = Tokenizer.from_file(PATH), Encoder(PATH, memory=3000)
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert list(memoryview(own.encode(r.text or "")).cast("I")) == plain.encode(r.text or "", add_special_tokens=False).ids


def test_files_give_the_ids_back(spark, tmp_path):
    rows = [(i * 3 % 101, t, "clash") for i, t in enumerate(TEXTS * 4)] + [(500, None, None), (501, "long word " * 20000, None)]
    path = str(tmp_path / "tokens")
    got = sorted(encode_documents(spark.createDataFrame(rows, DOCS).repartition(5), PATH, path=path).collect())
    plain, start, want = Tokenizer.from_file(PATH), 0, []
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_layout(spark, tmp_path):
    path = str(tmp_path / "tokens")
    encode_documents(spark.createDataFrame([(i, f"some words {i}", None) for i in range(3000)], DOCS).coalesce(1), PATH, path=path)
    part = next(p for p in (tmp_path / "tokens").iterdir() if p.suffix == ".parquet" and pq.ParquetFile(p).metadata.num_rows)
    group = pq.ParquetFile(part).metadata.row_group(0)
    by = {group.column(k).path_in_schema.split(".")[0]: group.column(k) for k in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and "DELTA_BINARY_PACKED" in by["n_tokens"].encodings
    assert by["tokens"].has_dictionary_page and by["doc_id"].has_offset_index and by["doc_id"].has_column_index


def test_repeated_rows_and_empty_table(spark, tmp_path):
    twice = encode_documents(spark.createDataFrame([(1, "a b", None), (1, "a b", None), (None, "c", None)], DOCS), PATH, path=str(tmp_path / "a")).collect()
    assert sorted(r.start for r in twice) == [0, 2, 5]
    assert encode_documents(spark.createDataFrame([], DOCS), PATH, path=str(tmp_path / "b")).count() == 0
    with pytest.raises(Exception):
        Encoder("/nonexistent.json")
