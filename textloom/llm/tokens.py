"""Operator 4: token ids as Parquet lists that allow selective reads of tokens and metadata.

Rows are range-partitioned and sorted by id, encoded in place, and written by Spark's Parquet writer: token
ids dictionary-encoded, the sorted ids and counts delta-encoded, row groups and pages of controlled size,
with page indexes, so that a reader of a range of ids or of the counts alone skips the rest.

The encoder looks up the blank-separated chunks of the lower-case text, cuts chunks that it has not met into
pieces, and asks the tokenizer only for pieces that it has not met lately; a piece is a match of the vocabulary's
own pre-tokenizer pattern, so merges never cross its borders. Texts that hold special tokens or characters on
which libraries may differ, all that could break the normal form among them, are encoded whole.

Defined results: a null or empty text has the end id only; repeated rows are encoded each; rows of one id are
dealt and sorted by their text too; null ids come first; an empty table gives files without rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from textloom.llm.common import materialise, shared_folder

#: Texts with other characters than these are encoded whole: separators, and characters on which libraries may differ.
WHOLE = re.compile("[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]")
#: What the vocabulary's pre-tokenizer takes as pieces of the remaining texts.
BLANKS = "\x1c\x1d\x1e\x1f"
PIECE = re.compile(r"[^\W\d_]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")

_encoders: dict[tuple[str, int], "Encoder"] = {}


#: How byte-level vocabularies write bytes: printable ones as they are, the others from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)).difference(PRINTABLE)))}


class Memory(dict):
    """The ids of chunks, asked of the tokenizer's model piece by piece where they are missing.

    A full memory keeps what it holds, since frequent chunks come early, and starts anew once as many chunks were missing.
    """

    def __init__(self, model, limit: int):
        super().__init__()
        self.model, self.limit, self.missed = model, limit, 0

    def __missing__(self, chunk: str) -> bytes:
        pieces = PIECE.findall(chunk)
        if len(pieces) == 1:
            letters = chunk.encode().decode("latin-1").translate(LETTERS)
            ids = np.array([t.id for t in self.model.tokenize(letters)], dtype="<u4").tobytes()
        else:
            ids = b"".join([self[p] for p in pieces])
        if len(self) >= self.limit:
            self.missed += 1
            if self.missed < self.limit:
                return ids
            self.clear()
            self.missed = 0
        self[chunk] = ids
        return ids


class Encoder:
    """A tokenizer with a bounded memory of chunks."""

    def __init__(self, path: str, memory: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Memory(self.tokenizer.model, memory)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if self._odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        known = self.known
        return b"".join([known[c] for c in text.lower().split()])

    @staticmethod
    def _odd(text: str) -> bool:
        if text.isascii():
            return "<|" in text or any(b in text for b in BLANKS)
        return "<|" in text or WHOLE.search(text) is not None


def encoder(path: str, memory: int) -> Encoder:
    """One encoder of a worker, for all its tasks."""
    if (path, memory) not in _encoders:
        _encoders.clear()
        _encoders[path, memory] = Encoder(path, memory)
    return _encoders[path, memory]


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = 2, step: int = 256, memory: int = 600_000) -> DataFrame:
    """``(doc_id, n_tokens, tokens)`` of ``docs(doc_id, text)``, in the rows' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                ids = [x + end for x in map(encoder(tokenizer, memory).encode, [t or "" for t in batch.column(1).to_pylist()])]
                counts = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                values = np.frombuffer(b"".join(ids), dtype="<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "n_tokens", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, tokens array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000, file_rows: int = 1_000_000, memory: int = 600_000) -> None:
    """Write the token file set: part files of at most ``file_rows`` rows in ascending order of ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    options = {
        "compression": "zstd",
        "maxRecordsPerFile": file_rows,
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#n_tokens": "false",
    }
    token_rows(rows, tokenizer, end_id, memory=memory).write.mode("overwrite").options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files: places are counted over files in order."""
    files = spark.read.parquet(path).select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "tokens")
    kind = files.schema["doc_id"].dataType.simpleString()

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            at = lists.offsets.to_numpy()
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False)
            sums = pa.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sums], names=["doc_id", "n_tokens", "file", "row", "ids_crc32"])

    rows = materialise(files.mapInArrow(checksums, f"doc_id {kind}, n_tokens bigint, file string, row bigint, ids_crc32 bigint"))
    part, piece = (F.regexp_extract("file", p, 1).cast("long") for p in (r"part-(\d+)", r"-c(\d+)"))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total")).withColumns({"part": part, "piece": piece})
    before = Window.orderBy("part", "piece", "file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(totals, "file")
    return placed.select("doc_id", (F.col("inner") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, memory: int = 600_000) -> DataFrame:
    """Write the token files of ``docs`` (to the shared folder unless ``path`` is given) and read them back.

    ``memory`` bounds the chunks that a worker remembers, about 170 bytes each.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, id_col, text_col, memory=memory)
    return read_tokens(spark, path)
