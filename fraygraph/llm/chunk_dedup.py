"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes proposes cuts, so they depend on the text nearby only and come back after an
insertion; chunks have ``LEAST`` to ``MOST`` bytes and end between code points. Chunks are deduplicated by digest (64 bits and
length) over all documents: the first one in order of doc_id and place stays, the others are repeats. A stretch of
neighbouring repeated chunks counts from ``SPAN`` bytes on, so chance repeats of a few common words do not.

Digests are counted inside a task before the shuffle, so a chunk that a third of all documents hold is a few rows; when
occurrences meet their counts again the join is one that Spark can split.

Nulls and odd input: a null or empty text has no chunks; repeated rows (and null ids) are separate documents, in the order
in which they were stored; an empty table gives no rows; other columns are kept by ``cut_repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraygraph.llm.tables import query, read, unused
from fraygraph.session import store

LEAST, MOST = 16, 192
MASK = np.uint16(0xF800)
SPAN = 64
GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)
NO_START = (np.arange(256) & 0xC0) == 0x80


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 ``data``."""
    if not data:
        return []
    own = np.frombuffer(data, np.uint8)
    gear = GEAR[own]
    for width in (1, 2, 4, 8):
        older = gear[:-width] << np.uint16(width)
        gear[width:] = gear[width:] + older
    inner = NO_START[own]
    good = (gear & MASK) == 0
    good[:-1] &= ~inner[1:]
    proposed = (np.flatnonzero(good) + 1).tolist()
    found, start, size, k, last = [], 0, len(data), 0, len(proposed)
    while start < size:
        least = start + LEAST
        while k < last and proposed[k] < least:
            k += 1
        end = proposed[k] if k < last and proposed[k] <= start + MOST else min(size, start + MOST)
        while end < size and inner[end]:
            end += 1
        found.append(end)
        start = end
    return found


def chunk_table(documents: DataFrame) -> DataFrame:
    """One row per document: row (``_row`` of ``documents`` if it has one), doc_id, n_bytes, ends (int32 array as bytes) and digests (int64 array as bytes)."""

    def run(batches):
        for batch in batches:
            sizes, ends, digests = [], [], []
            for text in batch.column(2).to_pylist():
                data = (text or "").encode()
                own = cuts(data)
                view = memoryview(data)
                sizes.append(len(data))
                ends.append(np.array(own, np.int32).tobytes())
                digests.append(b"".join([xxhash.xxh3_64_digest(view[a:b], b - a) for a, b in zip([0, *own], own)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.binary()), pa.array(digests, pa.binary())],
                names=["row", "doc_id", "n_bytes", "ends", "digests"],
            )

    row = F.col("_row") if "_row" in documents.columns else F.monotonically_increasing_id()
    rows = documents.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store(rows.mapInArrow(run, "row long, doc_id long, n_bytes long, ends binary, digests binary"))


def occurrences(chunks: DataFrame) -> DataFrame:
    """(digest, row, doc_id, start, size) of every chunk."""

    def run(batches):
        for batch in batches:
            for row, doc, ends, digests in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "ends", "digests"))):
                end = np.frombuffer(ends, np.int32).astype(np.int64)
                start = np.concatenate([[0], end[:-1]]).astype(np.int64) if len(end) else end
                n = len(end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(digests, np.int64)), pa.array(np.full(n, row)), pa.array([doc] * n, pa.int64()), pa.array(start), pa.array((end - start).astype(np.int32))],
                    names=["digest", "row", "doc_id", "start", "size"],
                )

    return chunks.select("row", "doc_id", "ends", "digests").mapInArrow(run, "digest long, row long, doc_id long, start long, size int")


def repeated_digests(chunks: DataFrame) -> DataFrame:
    """(digest, first) of the chunks that occur twice or more, with the place (doc_id, row, start) of the first."""

    def run(batches):
        for batch in batches:
            digests, rows, docs, starts = [], [], [], []
            for row, doc, ends, own in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "ends", "digests"))):
                end = np.frombuffer(ends, np.int32).astype(np.int64)
                digests.append(np.frombuffer(own, np.int64))
                starts.append(np.concatenate([[0], end[:-1]]) if len(end) else end)
                rows.append(np.full(len(end), row))
                docs.append(np.full(len(end), np.iinfo(np.int64).min if doc is None else doc))
            if not digests:
                continue
            digest, row, doc, start = (np.concatenate(x).astype(np.int64) for x in (digests, rows, docs, starts))
            order = np.lexsort((start, row, doc, digest))
            digest = digest[order]
            first = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]])) if len(digest) else np.zeros(0, int)
            count = np.diff(np.append(first, len(digest)))
            at = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digest[first], count, doc[at], row[at], start[at])], names=["digest", "n", "doc", "row", "start"])

    parts = chunks.select("row", "doc_id", "ends", "digests").mapInArrow(run, "digest long, n long, doc long, row long, start long")
    first = F.min(F.struct("doc", "row", "start")).alias("first")
    return parts.groupBy("digest").agg(F.sum("n").alias("n"), first).filter("n > 1").select("digest", "first")


def stretches(chunks: list[dict]) -> list[dict]:
    """Runs of neighbouring chunks (start, size, in order) of at least ``SPAN`` bytes."""
    found = []
    for c in chunks:
        if found and found[-1]["end"] == c["start"]:
            found[-1]["end"] += c["size"]
        else:
            found.append({"start": c["start"], "end": c["start"] + c["size"]})
    return [s for s in found if s["end"] - s["start"] >= SPAN]


RESULT = "n_repeated long, repeated_bytes long, repeated array<struct<start:bigint,end:bigint>>, shared array<struct<start:bigint,end:bigint>>"


def find_repeats(documents: DataFrame) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): row, doc_id, n_bytes, n_chunks, n_repeated (chunks seen before), repeated_bytes,
    repeated (stretches of such chunks, byte offsets) and shared (stretches of chunks that occur elsewhere, first ones too)."""
    chunks = chunk_table(documents)
    found = occurrences(chunks).join(repeated_digests(chunks), "digest")
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("doc"), "row", "start")
    chunk = F.struct("start", F.col("size").cast("long").alias("size"), (place != F.col("first")).alias("again"))
    by_row = found.groupBy("row").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))  # the chunks of one text

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            again = [[c for c in own if c["again"]] for own in batch.column(1).to_pylist()]
            repeated = [stretches(x) for x in again]
            shared = [stretches(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(x) for x in again], pa.int64()),
                    pa.array([sum(s["end"] - s["start"] for s in x) for x in repeated], pa.int64()), pa.array(repeated, kind), pa.array(shared, kind),
                ],
                names=["row", *[c.split()[0] for c in RESULT.split(", ")]],
            )

    spans = by_row.mapInArrow(run, f"row long, {RESULT}")
    all_rows = chunks.select("row", "doc_id", "n_bytes", (F.octet_length("ends") / 4).cast("long").alias("n_chunks"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return all_rows.join(spans, "row", "left").select(
        "row", "doc_id", "n_bytes", "n_chunks", F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"),
        F.coalesce("repeated_bytes", F.lit(0).cast("long")).alias("repeated_bytes"), F.coalesce("repeated", none).alias("repeated"), F.coalesce("shared", none).alias("shared"),
    )


def cut_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with repeated stretches cut from their texts; what a document repeats stays in the first one."""
    columns = documents.columns
    row_, repeated_ = unused(documents, "row", "repeated")
    settled = store(documents.withColumn(row_, F.monotonically_increasing_id()))
    found = find_repeats(settled.select(F.col(row_).alias("_row"), "doc_id", "text")).select(F.col("row").alias(row_), F.col("repeated").alias(repeated_))
    joined = settled.join(found, row_, "left")

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(repeated_).to_pylist()):
                data, kept, at = (text or "").encode(), [], 0
                for s in spans or []:
                    kept.append(data[at : s["start"]])
                    at = s["end"]
                texts.append(None if text is None else b"".join([*kept, data[at:]]).decode())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).select(columns)

    return joined.mapInArrow(run, documents.schema)


@query("op8_substring_dedup")
def _(spark, sf):
    return find_repeats(read(spark, sf, "documents", "doc_id", "text")).drop("row")
