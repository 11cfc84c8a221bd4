"""Token-ID output: documents encoded, packed with Simple-8b and written as blocks in ascending document order.

Documents are dealt by ranges of doc_id, sorted inside a range, encoded and packed by the task that writes them. A block is
self-contained (see ``simple8b``); blocks lie in Parquet files, so they are committed, retried and read like any Spark
output and need no local folder. A block knows the ids before it in its shard, so global offsets take the totals of the
shards only (one small row per writing task).

Nulls and odd input: a null text is empty and has the end id alone; null document ids come first; repeated rows are each
written, ordered by text among equal ids. An empty table gives no blocks and no rows. Other columns are not written.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraygraph.llm import simple8b
from fraygraph.llm.tables import query, read, small_batches
from fraygraph.llm.tokens import worker_ids
from fraygraph.session import checkpoint_folder, hint_small

END_ID = 2
BLOCK_IDS = 1 << 19
BLOCK_DOCUMENTS = 4096
SLICE = 2000
BLOCKS = "shard int, block int, ids_before long, n_docs int, n_ids long, payload binary"


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_slices(batches, tokenizer: str | None):
    """(doc_ids, coded texts) in slices of a bounded number of documents."""
    ids = worker_ids(tokenizer or tokenizer_file())
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            yield part.column(0).to_pylist(), ids.encode([t or "" for t in part.column(1).to_pylist()])


def write_ids(documents: DataFrame, path: str, end_id: int = END_ID, tokenizer: str | None = None) -> None:
    """Write the packed ids of ``documents`` (doc_id, text) below ``path``; ``tokenizer`` is a file every worker can open."""
    small_batches(documents.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        names, coded, held = [], [], 0

        def flush():
            nonlocal block, before, names, coded, held
            ids = np.frombuffer(b"".join(coded), "<u4")
            payload = simple8b.pack_block(names, ids, np.array([len(c) // 4 for c in coded], np.int64))
            row = [shard], [block], [before], [len(names)], [len(ids)], [payload]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
            block, before, names, coded, held = block + 1, before + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for slice_names, slice_coded in encoded_slices(batches, tokenizer):
            for name, ids in zip(slice_names, slice_coded):
                names.append(name)
                coded.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= BLOCK_IDS or len(names) >= BLOCK_DOCUMENTS:
                    yield flush()
        if names:
            yield flush()

    text = F.col("text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(text), text]
    dealt = documents.select("doc_id", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    dealt.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(payload, start) of every block: its bytes and the ids before it in all shards."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per writing task
    starts = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("shard_start"))
    return blocks.join(hint_small(starts), "shard").select("payload", (F.col("shard_start") + F.col("ids_before")).alias("start"))


def _decoded(batches):
    """(doc_ids, starts, ids per document, all ids as little-endian bytes) of every block."""
    for batch in batches:
        for payload, start in zip(batch.column(0), batch.column(1).to_pylist()):
            names, ids, lengths = simple8b.unpack_block(payload.as_py())
            ends = np.cumsum(lengths, dtype=np.int64)
            yield pa.array(names, pa.int64()), start + ends - lengths, 4 * (ends - lengths), 4 * ends, memoryview(ids.astype("<u4").tobytes())


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document written: ids as little-endian 32-bit integers, start counts the ids before."""

    def run(batches):
        for names, starts, begins, ends, data in _decoded(batches):
            ids = pa.array([bytes(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([names, pa.array(starts), ids], names=["doc_id", "start", "ids"])

    return _placed(spark, path).mapInArrow(run, "doc_id long, start long, ids binary")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document written, from its decoded ids."""

    def run(batches):
        for names, starts, begins, ends, data in _decoded(batches):
            crc = pa.array([zlib.crc32(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays([names, pa.array(starts), pa.array((ends - begins) // 4), crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Write ``documents`` to a new folder below the shared one, read it back: (doc_id, start, n_tokens, ids_crc32)."""
    path = f"{checkpoint_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(documents, path)
    return read_digests(spark, path)


@query("op10_token_ids")
def _(spark, sf):
    return token_table(spark, read(spark, sf, "documents", "doc_id", "text"))
