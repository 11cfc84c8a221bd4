"""Benchmark decontamination: a broadcast hash set of normalised test n-grams scanned over token windows of training texts.

A window is ``n`` consecutive words of a test item; an item with fewer words, but not none, is one window. Document windows
are looked up by a rolling hash, and a hit counts only if the SHA-256 of its words is that of the test window.

Nulls and odd input: a null or wordless text (document or item) has no words and no hits. Repeated documents and repeated
item rows are each judged alone, an item id counts once per document. Items with a null id mark words as hit but are not
listed. An empty benchmark or an empty table gives rows without hits, respectively no rows. Other columns stay; those named
like a result column are replaced.

Size: the broadcast holds at most ``BLOCK_ROWS`` fixed-size rows. A larger benchmark is cut by hash into several such blocks
and the documents are scanned once per block, so nothing grows without bound and no window is dropped.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraygraph.llm.tables import query, read, set_aside, with_arrow
from fraygraph.llm.words import ALPHANUMERIC, alphanumeric_bytes, window_hashes, word_hashes, word_places

BLOCK_ROWS = 400_000
WINDOW = 10
LEAST_BITS, BITS_A_HASH = 1 << 20, 16
RESULT = "n_words long, hit_words array<int>, item_ids array<long>"


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct (length, hash, digest, item_id) of the windows of all items."""

    def run(batches):
        for batch in batches:
            lengths, hashes, digests, ids = [], [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                data = alphanumeric_bytes(text)
                words = data.split()
                if not words:
                    continue
                length = min(n, len(words))
                found = window_hashes(word_hashes(data), length)
                hashes += found.view(np.int64).tolist()
                digests += [hashlib.sha256(b" ".join(words[i : i + length])).digest() for i in range(len(found))]
                lengths += [length] * len(found)
                ids += [item] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lengths, pa.int32()), pa.array(hashes, pa.int64()), pa.array(digests, pa.binary()), pa.array(ids, pa.int64())],
                names=["length", "hash", "digest", "item_id"],
            )

    items = benchmark.select("item_id", "text")
    return items.mapInArrow(run, "length int, hash long, digest binary, item_id long").distinct()


def scan(documents: DataFrame, rows: list, text: str) -> DataFrame:
    """One pass over ``documents`` with one block of test windows; adds what it finds to earlier blocks' results."""
    items: dict[bytes, list] = {}
    by_length: dict[int, list[int]] = {}
    for row in rows:
        items.setdefault(bytes(row.digest), []).append(row.item_id)
        by_length.setdefault(row.length, []).append(row.hash)
    seen = {}
    for length, found in by_length.items():
        sorted_hashes = np.unique(np.array(found, np.int64).view(np.uint64))
        bits = np.zeros(max(LEAST_BITS, 1 << (BITS_A_HASH * len(sorted_hashes) - 1).bit_length()), bool)
        bits[(sorted_hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        seen[length] = (np.packbits(bits), sorted_hashes)
    shared = documents.sparkSession.sparkContext.broadcast((items, seen))

    def run(texts):
        items, packed = shared.value
        if not hasattr(run, "bits"):
            run.bits = {k: np.unpackbits(b).astype(bool) for k, (b, _) in packed.items()}
        made = {"n_words": [], "hit_words": [], "item_ids": []}
        for text in texts:
            data = alphanumeric_bytes(text)
            starts, ends = word_places(data)
            hashes = word_hashes(data, (starts, ends))
            hit, found = set(), set()
            for length, (_, known) in packed.items():
                windows = window_hashes(hashes, length)
                bits = run.bits[length]
                near = np.flatnonzero(bits[(windows & np.uint64(len(bits) - 1)).astype(np.int64)])
                near = near[known[np.minimum(np.searchsorted(known, windows[near]), len(known) - 1)] == windows[near]]
                for i in near.tolist():
                    own = b" ".join([data[a:b] for a, b in zip(starts[i : i + length], ends[i : i + length])])
                    ids = items.get(hashlib.sha256(own).digest())
                    if ids is not None:
                        hit.update(range(i, i + length))
                        found.update(x for x in ids if x is not None)
            made["n_words"].append(len(starts))
            made["hit_words"].append(sorted(hit))
            made["item_ids"].append(sorted(found))
        return made

    return with_arrow(documents, [text], RESULT, run)


def find_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", n: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``documents`` plus n_words, hit_words (ordinals of words inside any occurrence of a test window) and item_ids."""
    windows = item_windows(benchmark, n)
    total = windows.count()
    blocks = max(1, -(-total // block_rows))
    block = F.pmod(F.xxhash64("digest", "item_id"), F.lit(blocks))
    result = None
    for i in range(blocks):
        rows = windows.filter(block == i).collect()
        if result is None:
            result = scan(documents, rows, text)
            continue
        before = result.withColumnsRenamed({"hit_words": "_hit_words", "item_ids": "_item_ids"})
        result = scan(before, rows, text)
        for name in ("hit_words", "item_ids"):
            result = result.withColumn(name, F.array_sort(F.array_union(name, f"_{name}"))).drop(f"_{name}")
    return result


WORD = re.compile(rb"[^ ]+")


def cut_words(text: str, hit: list[int]) -> str:
    """``text`` without the stretches that hold hit words, each with what stands between its words."""
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data.translate(ALPHANUMERIC))]
    kept, at = [], 0
    for i, word in enumerate(hit):
        if i == 0 or hit[i - 1] != word - 1:
            kept.append(data[at : places[word][0]])
        at = places[word][1]
    return b"".join([*kept, data[at:]]).decode()


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", n: int = WINDOW) -> DataFrame:
    """``documents`` without leaked items: whole documents go, or with ``remove="spans"`` only the hit stretches."""
    apart, back = set_aside(documents, RESULT)
    found = find_leaks(apart, benchmark, text, n)
    if remove == "documents":
        return back(found.filter(F.size("hit_words") == 0))

    def run(batches):
        for batch in batches:
            texts = [
                cut_words(t, h) if h else t for t, h in zip(batch.column(text).to_pylist(), batch.column("hit_words").to_pylist())
            ]
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(texts, pa.string()))

    return back(found.mapInArrow(run, found.schema))


ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), {ALPHABET}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op2_benchmark_leaks", rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS_SQL} AS w FROM documents), b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
t AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM s)),
x AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k)),
h AS MATERIALIZED (SELECT doc_id, i, x.k, item_id FROM x JOIN t ON x.k = t.k AND x.g = t.g),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)""")
def _(spark, sf):
    found = find_leaks(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id", F.col("n_words"), F.size("hit_words").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )
