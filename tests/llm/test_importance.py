"""Position-table checksums against zlib, weights and draws against a plain reading of their definition."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from llm.data import ALNUM_WORD, LOWER, frame, odd_rows, prose

from fraygraph.llm import importance


@pytest.mark.parametrize("reach", [4, 7, 256])
def test_checksums_equal_zlib(reach):
    r = random.Random(reach)
    crc = importance.SpanCrc(reach)
    for _ in range(40):
        words = [bytes(r.choices(b"abc\xc3\xa9xyz09", k=r.choice([1, 2, 3, 5, 8, 9, 12, 13, 17, 255, 256, 257, 300, 516, 600, 1030]))) for _ in range(r.randrange(1, 9))]
        single, pair, _, _ = importance.hashed_group(crc, [(0, b" ".join(words), False)])
        assert single.tolist() == [zlib.crc32(w) for w in words]
        assert pair.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]


def features(text):
    words = ALNUM_WORD.findall((text or "").translate(LOWER))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def buckets(texts):
    return Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)[1])


def drawn(rows, target):
    s, t = buckets(r[1] for r in rows), buckets(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    scored = []
    for r in rows:
        n, own = features(r[1])
        weight = sum(gain(zlib.crc32(f.encode()) % 10_000) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        scored.append((weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), r[0], len(own), weight, n))
    able = sorted((x for x in scored if x[4] >= 20), key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2], x[4]))
    k = 25 * len(able) // 100
    rest = able[k:] + [x for x in scored if x[4] < 20]
    return [(x[1], x[2], x[3], x[0], i + 1 if i < k else None) for i, x in enumerate(able[:k] + rest)]


@pytest.mark.parametrize("stretch", [importance.STRETCH, 60])
def test_draw_equals_plain_reading(spark, monkeypatch, stretch):
    monkeypatch.setattr(importance, "STRETCH", stretch)
    rows = odd_rows() + [(900 + i, prose(300 + i % 40, 25 + i % 7), "en", "a", 0, "clash", "clash") for i in range(160)]
    rows += [(None, prose(5, 30), None, None, None, None, None)] * 9 + [(77, "x" * 900 + " " + prose(6, 40), "en", None, 0, None, None)] * 3
    target = [prose(1, 60), None, "", prose(2, 9), prose(2, 9)]
    found = importance.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"))
    assert found.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "label"]
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(map(str, drawn(rows, target)))


def test_empty_tables_and_own_columns(spark):
    rows = [(i, prose(i, 30), "n", "w", "p", "b") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, name string, place string, before string")
    none = spark.createDataFrame([], "text string")
    found = importance.resample(docs, none).collect()
    assert len(found) == 12 and {(r["row"], r["name"], r["place"], r["before"]) for r in found} == {("n", "w", "p", "b")}
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3]
    assert importance.resample(docs.limit(0), none).count() == 0
