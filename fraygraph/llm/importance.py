"""Target-distribution importance resampling over hashed word n-grams; CRC-32 of all features from a position table.

CRC-32 is linear: the checksum of n bytes is a constant of n (that of n zero bytes) xor one contribution per byte, which
depends on the byte and its distance from the end alone. ``position_table`` holds those contributions, and the checksums of
many features come from one gather and one ``bitwise_xor.reduceat`` over their spans: once for the single words, once for the
word pairs that begin at even words and once for those at odd ones, so spans never overlap within a pass. A span beyond the
table is folded block by block.

Bucket counts of the documents and of the target give every bucket a gain (log ratio with one count added, in thousandths),
a document's weight is the floored mean gain of its features, and its score adds a Gumbel variate that sha256 of seed and id
fixes. The highest scores are drawn: importance sampling without replacement.

Nulls and odd input: a null, empty or wordless text has no features, weight 0 and is never drawn while ``least_words`` is
positive; a null doc_id counts as the empty string in the hash and comes last among equal scores; repeated rows are each
counted, scored and ranked (equal ids by features, then words). Empty documents give no rows, an empty target leaves every
bucket its added count. Very long texts are hashed in stretches of bounded size. Other columns stay, whatever their names;
those named like a result column are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.llm.tables import query, read, with_arrow
from fraygraph.llm.words import ALPHANUMERIC
from fraygraph.operators.ranking import number_ordered
from fraygraph.session import hint_small, store

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
SHARE = 25
REACH = 256  # distances from the end that the table serves at once
STRETCH = 1 << 16  # bytes hashed at once
RESULT = "n_features long, weight long, score long, rank long"


def position_table(reach: int = REACH) -> np.ndarray:
    """Row d: what a byte with d - 1 bytes after it adds to a CRC-32; row 0, for bytes outside all spans, is zero.

    Four rows more than ``reach``, so the first block of a long span can take up a short rest.
    """
    table = np.zeros((reach + 5, 256), np.uint32)
    table[1] = [zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)]
    for d in range(2, reach + 5):
        table[d] = (table[d - 1] >> np.uint32(8)) ^ table[1][table[d - 1] & np.uint32(255)]
    return table


class SpanCrc:
    """CRC-32 of many byte spans of one array."""

    def __init__(self, reach: int = REACH):
        self.reach = reach
        self.table = position_table(reach)
        self.flat = self.table.ravel()
        self.of_zeros = np.array([zlib.crc32(bytes(n)) for n in range(reach + 1)], np.uint32)

    def spans(self, own: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Checksums of own[starts[i]:ends[i]]; the spans ascend and do not overlap, and the first one begins at 0."""
        if not len(starts):
            return np.zeros(0, np.uint32)
        lengths = ends - starts
        pieces = np.diff(starts, append=len(own))
        after = np.repeat(ends, pieces)
        after -= np.arange(len(own), dtype=after.dtype)
        np.maximum(after, 0, out=after)
        long = np.flatnonzero(lengths > self.reach)
        if len(long):
            np.minimum(after, self.reach, out=after)
        after <<= 8
        after |= own
        found = np.bitwise_xor.reduceat(self.flat.take(after), starts)
        found ^= self.of_zeros[np.minimum(lengths, self.reach)]
        for i in long.tolist():
            found[i] = self._long(own[starts[i] : ends[i]])
        return found

    def _long(self, own: np.ndarray) -> int:
        """Blocks of ``reach`` bytes, the first one longer or shorter: each moves the register on and adds its own bytes."""
        first = len(own) % self.reach
        first += self.reach * (first < 4) if len(own) >= self.reach + 4 else len(own) - first
        first = min(first, self.reach + 4)
        edges = np.concatenate([[0], np.arange(first, len(own), self.reach)])
        after = np.repeat(np.append(edges[1:], len(own)), np.diff(edges, append=len(own))) - np.arange(len(own))
        blocks = np.bitwise_xor.reduceat(self.flat.take((after << 8) | own), edges).tolist()
        register = 0xFFFFFFFF
        for k, block in enumerate(blocks):
            size = self.reach if k else first
            for byte in range(4):
                block ^= int(self.table[size - byte, (register >> (8 * byte)) & 255])
            register = block
        return register ^ 0xFFFFFFFF


def stretches(texts: list[str | None]) -> Iterator[list[tuple[int, bytes, bool]]]:
    """Groups of (text, words joined by one blank, whether the first word repeats the last one of the stretch before).

    A group has about ``STRETCH`` bytes at most, unless a single word is longer. Texts without words are left out.
    """
    group, size = [], 0
    for k, text in enumerate(texts):
        data = b" ".join((text or "").encode().translate(ALPHANUMERIC).split())
        at, repeats = 0, False
        while at < len(data):
            end = len(data)
            if end - at > STRETCH:
                end = data.rfind(b" ", at, at + STRETCH)
                if end < 0 or (repeats and data.find(b" ", at, end) < 0):  # one word, or the repeated one and a part of the next
                    end = data.find(b" ", data.find(b" ", at) + 1 if repeats else at)
                    end = len(data) if end < 0 else end
            if group and size + end - at > STRETCH:
                yield group
                group, size = [], 0
            group.append((k, data[at:end], repeats))
            size += end - at
            if end == len(data):
                break
            at, repeats = data.rfind(b" ", at, end) + 1 if b" " in data[at:end] else at, True
    if group:
        yield group


def hashed_group(crc: SpanCrc, group: list[tuple[int, bytes, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(single, pair, first, last): checksums of every word and of every word with the next one, and the first and last word
    of each stretch."""
    own = np.frombuffer(b" ".join([data for _, data, _ in group]), np.uint8)
    blanks = np.flatnonzero(own == 0x20)
    starts = np.concatenate([np.zeros(1, np.int64), blanks + 1])
    ends = np.append(blanks, len(own))
    single = crc.spans(own, starts, ends)
    pair = np.zeros(max(0, len(starts) - 1), np.uint32)
    for odd in (0, 1):
        heads, tails = starts[odd:-1:2], ends[odd + 1 :: 2]
        if len(heads):
            base = heads[0]
            stop = int(tails[-1])
            pair[odd::2] = crc.spans(own[base:stop], heads - base, tails - base)
    words = np.array([data.count(b" ") + 1 for _, data, _ in group])
    last = np.cumsum(words) - 1
    return single, pair, last - words + 1, last


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket, at most ``buckets`` rows; every task counts before anything is shuffled."""

    def run(batches):
        crc, counts = SpanCrc(), np.zeros(buckets, np.int64)
        for batch in batches:
            for group in stretches(batch.column(0).to_pylist()):
                single, pair, first, last = hashed_group(crc, group)
                fresh = np.ones(len(single), bool)
                fresh[first[[repeats for _, _, repeats in group]]] = False
                inner = np.ones(len(pair), bool)
                inner[last[:-1]] = False
                for found in (single[fresh], pair[inner]):
                    counts += np.bincount(found % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 * log of its share in ``target`` by its share in ``raw``), one count added."""
    raw_all, target_all = (float(side.agg(F.sum("n")).first()[0] or 0) for side in (raw, target))
    spark = raw.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = ((t + 1) * (raw_all + buckets)) / ((s + 1) * (target_all + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def with_weights(documents: DataFrame, gains: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``documents`` plus n_words, n_features and weight. ``gains`` has a row per bucket, all of which travel to the tasks."""
    table = np.zeros(buckets, np.int64)
    for row in gains.collect():
        table[row.bucket] = row.gain
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(texts):
        gain = shared.value
        if not hasattr(run, "crc"):
            run.crc = SpanCrc()
        words, features, sums = [0] * len(texts), [0] * len(texts), [0] * len(texts)
        for group in stretches(texts):
            single, pair, first, last = hashed_group(run.crc, group)
            of_single = np.concatenate([[0], np.cumsum(gain[single % np.uint32(buckets)])])
            of_pair = np.concatenate([[0], np.cumsum(gain[pair % np.uint32(buckets)])])
            for (k, _, repeats), a, b in zip(group, first.tolist(), last.tolist()):
                own = a + repeats
                words[k] += b + 1 - own
                features[k] += b + 1 - own + b - a
                sums[k] += int(of_single[b + 1] - of_single[own] + of_pair[b] - of_pair[a])
        return {"n_words": words, "n_features": features, "weight": [s // n if n else 0 for s, n in zip(sums, features)]}

    return with_arrow(documents, [text], "n_words long, n_features long, weight long", run)


def gumbel(name, seed: int = SEED):
    """Thousandths of a standard Gumbel variate, fixed by sha256 of ``seed`` and the column ``name``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    documents: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
    text: str = "text", name: str = "doc_id", buckets: int = BUCKETS,
) -> DataFrame:
    """``documents`` plus n_features, weight, score and rank; rank is null for rows that are not drawn.

    Of the rows with at least ``least_words`` words, ``share`` percent are drawn. Scores are whole numbers in a narrow range,
    so a histogram of them (one row per distinct score) gives the rows above each score; only rows from the threshold on are
    put in order, dealt to ranges of (score, id), so neither a frequent score nor one id is ordered in one task.
    """
    raw, wanted = (store(bucket_counts(t, text, buckets)) for t in (documents, target))
    kept = [F.col(c) for c in documents.columns if c not in ("n_features", "weight", "score", "rank")]
    packed = documents.select(F.struct(*kept).alias("row"), F.col(name).alias("name"), F.col(text).alias("text"))
    weighed = with_weights(packed, bucket_gains(raw, wanted, buckets), "text", buckets).drop("text")
    scored = store(weighed.withColumn("score", F.col("weight") + gumbel("name", seed)))
    eligible = F.col("n_words") >= least_words
    histogram = store(scored.filter(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # a row per distinct score
    total = histogram.agg(F.sum("n")).first()[0] or 0
    drawn = share * total // 100
    before = histogram.select(F.col("score"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before")).filter(F.col("before") < drawn)
    before = store(before)
    least = before.agg(F.min("score")).first()[0]
    chosen = eligible & (F.col("score") >= least) if least is not None else F.lit(False)
    order = [F.col("name").asc_nulls_last(), F.col("n_features").asc(), F.col("n_words").asc()]
    ranked = number_ordered(scored.filter(chosen), ["score"], order, "place").join(hint_small(before), "score")
    place = F.col("before") + F.col("place")
    result = [F.col("row.*"), "n_features", "weight", "score"]
    ranked = ranked.select(*result, F.when(place <= drawn, place).alias("rank"))
    return ranked.unionByName(scored.filter(~chosen).select(*result, F.lit(None).cast("long").alias("rank")))


ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op12_importance_resampling", rf"""
WITH RECURSIVE table256 AS (SELECT list(c ORDER BY b) AS k FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, step: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) AS r(b))),
texts AS (SELECT true AS raw, row_number() OVER () AS id, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
words AS MATERIALIZED (SELECT raw, id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {ALPHABET}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
parts AS (SELECT raw, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counted AS MATERIALIZED (SELECT raw, id, f, count(*) AS n FROM parts GROUP BY ALL),
hashed AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, length(hex(f)) + 1, 2), lambda i: ('0x' || substr(hex(f), i, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, k[1 + (xor(c, b) & 255)]))) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM counted), table256),
buckets AS MATERIALIZED (SELECT bucket, coalesce(sum(n) FILTER (raw), 0) AS s, coalesce(sum(n) FILTER (NOT raw), 0) AS t
    FROM counted JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM buckets, totals),
sums AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE raw GROUP BY id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM words LEFT JOIN sums USING (id) WHERE raw),
placed AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, n_words) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS n FROM placed)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM ranked""")
def _(spark, sf):
    drawn = resample(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "benchmark", "text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
