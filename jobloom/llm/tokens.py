"""Token-ID output: documents as Parquet list columns of token ids, in document order.

Each file holds a contiguous range of ids in ascending order. Token ids sit in a list<int> column of their own, so
reading lengths and places touches none of their pages; ids are dictionary encoded (delta encoded once a dictionary
page is full, as writer version 2 does), row groups are small and pages carry a column index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, shared_dir, text_bytes, worker_tokenizer

SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, at = worker_tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                raw = [ids + end for ids in encoder.encode(some.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in raw], np.int64)
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(n), ids],
                    ["doc_id", "part", "at", "n_tokens", "ids"],
                )
                at += int(ends[-1])

    return run


def write_token_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
    part_bytes: int = 24 << 20, row_group_bytes: int = 8 << 20, page_bytes: int = 128 << 10,
) -> str:
    """Encode every text and write `doc_id, part, at, n_tokens, ids` to Parquet in ascending id order; returns path.

    part is the file's rank, at the ids before the document in it. Null texts count as empty and give the end id
    alone; null ids come first; equal ids are ordered by a hash of their text, repeated rows are all kept; other
    columns are not read. An empty table gives files without rows. Work is split by ranges of the id, never by
    value, so no key is hot.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(1, -(-text_bytes(rows) // part_bytes))
    order = [F.col("doc_id"), F.xxhash64("text")]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    (
        placed.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write.mode("overwrite")
        .option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(page_bytes))
        .option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.writer.version", "PARQUET_2_0").option("compression", "snappy").parquet(path)
    )
    return path


def _before(spark: SparkSession, path: str, stretch: int = 4096) -> DataFrame:
    """`part, before`: ids in the files before each. Sums run inside stretches of parts; a row a stretch is summed in one place."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("total")).withColumn("s", F.floor(F.col("part") / stretch))
    so_far = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = totals.groupBy("s").agg(F.sum("total").alias("total"))
    stretches = stretches.select("s", so_far(Window.orderBy("s")).alias("ahead"))
    inside = totals.select("part", "s", so_far(Window.partitionBy("s").orderBy("part")).alias("own"))
    return inside.join(stretches, "s").select("part", (F.col("own") + F.col("ahead")).alias("before"))


def _with_start(rows: DataFrame, before: DataFrame, broadcast_parts: int) -> DataFrame:
    """rows joined to the ids before their file; the file table (12 bytes a row) is broadcast up to that many files, else both sides are shuffled."""
    before = settled(before)
    small = before.count() <= broadcast_parts
    return rows.join(F.broadcast(before) if small else before.hint("shuffle_merge"), "part").withColumn("start", F.col("before") + F.col("at"))


def token_places(spark: SparkSession, path: str, broadcast_parts: int = 1_000_000) -> DataFrame:
    """`doc_id, part, start, n_tokens` of written documents without reading any id: only the narrow columns are scanned."""
    meta = spark.read.parquet(path).select("doc_id", "part", "at", "n_tokens")
    return _with_start(meta, _before(spark, path), broadcast_parts).select("doc_id", "part", "start", "n_tokens")


def read_token_ids(spark: SparkSession, path: str, broadcast_parts: int = 1_000_000) -> DataFrame:
    """Written documents with their ids: `doc_id, start, n_tokens, ids`."""
    return _with_start(spark.read.parquet(path), _before(spark, path), broadcast_parts).select("doc_id", "start", "n_tokens", "ids")


def _digest(batches: Iterator) -> Iterator:
    import zlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        raw, at = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B"), lists.offsets.to_numpy()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per written document the checksum of the ids read back (unsigned crc32 of little-endian uint32)."""
    return read_token_ids(spark, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(docs, path, "byte_bpe_50k.json", 2)
    return token_digests(spark, path)
