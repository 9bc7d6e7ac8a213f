"""Token ids of documents as Parquet list columns.

Files hold documents in ascending order of id, one range of ids a file, in small row groups with page indexes, so a
reader of a few documents or of the metadata alone skips the other pages. Ids are dictionary-encoded (a vocabulary of
tens of thousands fits one dictionary page a row group) or delta-encoded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import keyed, size_of
from tapeloom.llm.tokens import VOCABULARY, encoder

# Text bytes that one file is meant to hold, and tokens that one Arrow batch hands on.
FILE_BYTES = 24 << 20
BATCH_TOKENS = 2_000_000

ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def token_batches(batches, vocabulary: str, end_id: int):
    """(doc_id, counts, ids) for slices of the batches, ids as one array; at most BATCH_TOKENS plus a document each."""
    enc, end = encoder(vocabulary), end_id.to_bytes(4, "little")
    for b in batches:
        at, held, size = 0, [], 0
        for k, text in enumerate(b["body"]):
            held.append(enc.encode(text.as_buffer().to_pybytes().decode("utf-8", "replace")) + end)
            size += len(held[-1])
            if size > 4 * BATCH_TOKENS or k == b.num_rows - 1:
                yield b.slice(at, k + 1 - at), np.fromiter(map(len, held), np.int64, len(held)) // 4, b"".join(held)
                at, held, size = k + 1, [], 0


def write_tokens(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write ``path`` in ascending order of id.

    Columns: part (number of the file), doc_id, start_in_part, n_tokens, ids. Null text is empty (the end id
    alone); null ids come first; rows of one id are ordered by a hash of their text, and repeated rows are all
    written. An empty table writes files without rows. Other columns of ``df`` are not read.
    """
    docs = keyed(df, id_col, text_col)
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size_of(docs)[1] // FILE_BYTES))
    ordered = docs.withColumn("tie", F.xxhash64("body")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for rows, counts, ids in token_batches(batches, vocabulary, end_id):
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(ids)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), part, np.int32)), rows["doc_id"], pa.array(before + ends - counts), pa.array(counts), lists],
                ["part", "doc_id", "start_in_part", "n_tokens", "ids"],
            )
            before += int(ends[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = ordered.mapInArrow(run, f"part int, doc_id {kind}, start_in_part long, n_tokens long, ids array<int>")
    options = ENCODINGS[encoding] | {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "compression": "zstd"}
    out.write.options(**options).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(part, start_in_part, doc_id, start, n_tokens) of every document, without reading ids."""
    rows = spark.read.parquet(path).select("part", "doc_id", "start_in_part", "n_tokens")
    return rows.join(part_starts(spark, path), "part").withColumn("start", F.col("base") + F.col("start_in_part")).drop("base")


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): the ids in all files before; one row a file that holds documents."""
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str, low=None, high=None) -> DataFrame:
    """Rows of the files, with ids from ``low`` to ``high`` if given: row groups and pages outside are skipped."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, computed from the ids in the files."""
    rows = spark.read.parquet(path).select("part", "doc_id", "start_in_part", "ids")

    def run(batches):
        for b in batches:
            lists = b["ids"]
            ends = lists.offsets.to_numpy().astype(np.int64)
            ids = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).view(np.uint8))
            sums = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b["part"], b["doc_id"], b["start_in_part"], pa.array(np.diff(ends)), pa.array(sums, pa.int64())],
                ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"part int, doc_id {kind}, start_in_part long, n_tokens long, ids_crc32 long")
    return found.join(part_starts(spark, path), "part").selectExpr("doc_id", "base + start_in_part AS start", "n_tokens", "ids_crc32")
