"""Language identification by held-out accuracy, substring deduplication against its promises."""

import random
import zlib

import numpy as np
from llm.data import frame, odd_rows, prose

from fraygraph.llm import chunk_dedup, language_id
from fraygraph.llm.tables import read

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = read(spark, SF, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs)
    held = docs.withColumn("held", language_id.held_out()).filter("held AND lang IS NOT NULL")
    found = language_id.predict(held, model).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in found)
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found) and all(0 <= r.score <= 1 for r in found)


def test_prediction_ignores_labels_and_order(spark):
    docs = read(spark, SF, "documents", "doc_id", "text", "lang")
    held = docs.filter(language_id.held_out())
    changed = docs.filter(~language_id.held_out()).unionByName(held.withColumn("lang", held.lang.substr(1, 1)))
    one, two = language_id.fit(docs), language_id.fit(changed.repartition(3))
    assert one.names == two.names and np.allclose(one.final, two.final)


def test_odd_texts(spark):
    docs = frame(spark, odd_rows())
    found = language_id.predict(docs, language_id.fit(docs)).collect()
    assert len(found) == len(odd_rows())
    for r in found:
        lettered = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred in ("en", "fr")) == lettered and (lettered or (r.lang_pred, r.score) == ("und", 0.0))
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.limit(0))).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), language_id.fit(docs)).count() == 0


def test_kernel_is_shared_places():
    a, b = language_id.presence(["abcab", "abd"])
    own = language_id.kernel(a[None], b[None])[0, 0]
    assert abs(own - (a * b).sum() / np.sqrt(a.sum() * b.sum())) < 1e-6


def test_cuts_depend_on_nearby_text():
    text = prose(3, 900).encode()
    ends = chunk_dedup.cuts(text)
    assert ends[-1] == len(text) and all(chunk_dedup.LEAST <= b - a <= chunk_dedup.MOST + 3 for a, b in zip(ends[:-2], ends[1:-1]))
    moved = chunk_dedup.cuts(b"something new, " + text)
    assert len({e - 15 for e in moved} & set(ends)) > 0.9 * len(ends)
    assert all("é".encode()[1:] != text[e : e + 1] for e in ends[:-1])
    assert chunk_dedup.cuts(b"") == [] and "".join(["é" * 500]).encode()[: chunk_dedup.cuts(("é" * 500).encode())[0]].decode()


def test_gear_hash_is_the_rolling_sum():
    data = prose(4, 60).encode()
    rolling, found = 0, []
    for i, b in enumerate(data):
        rolling = ((rolling << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFF
        if not rolling & int(chunk_dedup.MASK) and not (i + 1 < len(data) and data[i + 1] & 0xC0 == 0x80):
            found.append(i + 1)
    start, want = 0, []
    while start < len(data):
        end = next((e for e in found if e >= start + chunk_dedup.LEAST), len(data))
        end = min(end, start + chunk_dedup.MOST, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        want.append(end)
        start = end
    assert chunk_dedup.cuts(data) == want


def test_repeats(spark):
    r = random.Random(6)
    passage = prose(5, 55)
    rows = [(i, prose(100 + i, r.randrange(30, 200)) + " " + (passage + " " + prose(700 + i, 40) if i % 4 == 0 else ""), "en", "a", 0, "", "") for i in range(80)]
    found = {x.doc_id: x for x in chunk_dedup.find_repeats(frame(spark, rows)).collect()}
    for i, row in enumerate(rows):
        x = found[i]
        assert x.n_bytes == len(row[1].encode()) and bool(x.repeated) == (i % 4 == 0 and i > 0) and bool(x.shared) == (i % 4 == 0)
        for s in x.repeated:
            assert row[1].encode()[s.start : s.end].decode().strip() in rows[0][1]
    cut = {x.doc_id: x.text for x in chunk_dedup.cut_repeats(frame(spark, rows)).collect()}
    assert cut[0] == rows[0][1] and cut[1] == rows[1][1] and len(cut[4]) < len(rows[4][1]) - 64


def test_odd_rows_keep_one_of_each_repeat(spark):
    docs = frame(spark, odd_rows())
    cut = chunk_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    base = odd_rows()[0][1]
    assert sum(r.text == base for r in cut.collect()) == 1
    assert chunk_dedup.find_repeats(docs).count() == docs.count() and chunk_dedup.find_repeats(docs.limit(0)).count() == 0
