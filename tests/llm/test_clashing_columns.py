"""Columns of the caller with the operators' own names stay, rare languages are learned, big benchmarks are looked up fast."""

import random
import time

import numpy as np
from llm.data import prose
from pyspark.sql import functions as F

from fraygraph.llm import chunk_dedup, decontaminate, jaccard, language_id, mixing, quality, tables
from fraygraph.llm.words import window_hashes, word_hashes

NAMES = ["key", "bytes", "of_id", "_key", "_bytes", "_0", "_1", "_2", "size", "copies", "nth", "_size", "_nth", "_times", "_one", "row", "_row", "repeated", "_repeated", "packed", "_range", "_inside", "_before"]


def docs(spark, rows):
    return spark.createDataFrame([(*r, *NAMES) for r in rows], ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in NAMES]]))


def kept(df):
    rows = df.collect()
    assert all([r[n] for n in NAMES] == NAMES for r in rows)
    return sorted((str(r.doc_id), str(r.text)) for r in rows)


ROWS = [(1, prose(1, 60), "a"), (2, prose(1, 60), "a"), (3, prose(2, 60), "b"), (3, prose(2, 60), "b"), (None, prose(3, 40), None), (None, prose(4, 40), None), (None, prose(3, 40), None), (5, None, "a"), (6, "", "b")]


def test_own_names_stay_in_the_stages(spark):
    table = docs(spark, ROWS)
    once = kept(jaccard.keep_one(table))
    assert len(once) == 6
    mixed = kept(mixing.mix(table))
    want = mixing.mix_copies(table.select("doc_id", "text", "source")).agg(F.sum("copies")).first()[0]
    assert len(mixed) == want and set(mixed) <= {(str(a), str(b)) for a, b, _ in ROWS}
    assert len(kept(chunk_dedup.cut_repeats(table))) == len(ROWS)


def test_rows_alike_in_id_source_and_size_are_mixed_alone(spark):
    rows = [(None, f"{prose(i % 7, 9)}", "a") for i in range(40)] + [(i, prose(i, 12), "b") for i in range(30)]
    table = docs(spark, rows)
    copies = mixing.mix_copies(table.select("doc_id", "text", "source"))
    assert len(kept(mixing.mix(table))) == copies.agg(F.sum("copies")).first()[0]


def test_more_than_two_hundred_languages(spark):
    r = random.Random(3)
    rows = []
    for k in range(230):
        letters = "".join(chr(0x0430 + (k * 7 + 5 * j) % 32) if k % 2 else chr(97 + (k * 5 + 3 * j) % 26) for j in range(4)) + chr(0x4E00 + k)
        rows += [(len(rows) + i, " ".join("".join(r.choices(letters, k=r.randrange(2, 6))) for _ in range(70)), f"l{k:03d}") for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table)
    assert len(model.names) == 230
    found = language_id.predict(table, model)
    assert found.filter("lang = lang_pred").count() > 0.5 * len(rows)
    assert len([k for k in quality.learn_references(table) if k is not None]) == 230


def test_lookup_of_windows_is_fast_for_a_full_block():
    """A document of 400 windows against 400,000 test windows: no sort of the test windows per document."""
    known = np.unique(np.random.default_rng(1).integers(0, 2**63, decontaminate.BLOCK_ROWS).astype(np.uint64))
    bits = np.zeros(1 << (decontaminate.BITS_A_HASH * len(known) - 1).bit_length(), bool)
    bits[(known & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    windows = window_hashes(word_hashes(prose(9, 409).encode()), 10)
    assert bits[(windows & np.uint64(len(bits) - 1)).astype(np.int64)].mean() < 0.12
    begin = time.process_time()
    for _ in range(50):
        at = np.minimum(np.searchsorted(known, windows), len(known) - 1)
        assert not (known[at] == windows).any()
    assert time.process_time() - begin < 1


def test_batches_are_bounded(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(rows), spark.conf.get(size)
    try:
        for own, left in ((("10000", "64m"), (str(tables.BATCH_ROWS), f"{tables.BATCH_BYTES}b")), (("100", "4m"), ("100", "4m")), (("0", "64m"), (str(tables.BATCH_ROWS), f"{tables.BATCH_BYTES}b"))):
            spark.conf.set(rows, own[0])
            spark.conf.set(size, own[1])
            tables.small_batches(spark)
            assert (spark.conf.get(rows), spark.conf.get(size)) == left
    finally:
        spark.conf.set(rows, before[0])
        spark.conf.set(size, before[1])
