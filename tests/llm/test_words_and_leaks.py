"""Word rules, benchmark decontamination and quality rules against plain readings of their definitions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm.data import ALNUM_WORD, BLANK_WORD, LOWER, frame, odd_rows, prose
from pyspark.sql import functions as F

from fraygraph.llm import decontaminate, quality, words
from fraygraph.llm.words import alphanumeric_words, blank_words, window_hashes, word_hashes

TEXTS = [r[1] for r in odd_rows()] + ["A\x00b\x1fC\x7fD\x85e\xa0f", "Ünï-cödé_É 9x", "\x0b\x0c"]


def test_words_follow_their_patterns():
    for text in TEXTS:
        assert [w.decode() for w in blank_words(text)] == BLANK_WORD.findall((text or "").translate(LOWER))
        assert [w.decode() for w in alphanumeric_words(text)] == ALNUM_WORD.findall((text or "").translate(LOWER))


def test_window_hashes_tell_windows_apart():
    text = prose(5, 500)
    words = text.encode().split()
    found = window_hashes(word_hashes(text.encode()), 3)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    assert len(set(found.tolist())) == len(set(windows))
    assert not len(window_hashes(word_hashes(b"two words"), 3))


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    """Everywhere in a text, over part borders, and for words longer than a part."""
    r = random.Random(2)
    vocabulary = [bytes(r.choices(b"abcdz\xc3\xa9", k=r.randrange(1, 9))) for _ in range(3000)] + [b"x" * 500, b"x" * 501, b"ab", b"ba", b"aab", b"aba"]
    text = [r.choice(vocabulary) for _ in range(20_000)]
    data = b" \t".join(text) + b"\n"
    whole = word_hashes(data)
    of = {}
    for word, value in zip(text, whole.tolist()):
        assert of.setdefault(word, value) == value
    assert len(set(of.values())) == len(of)
    monkeypatch.setattr(words, "PART", 300)
    short = word_hashes(data)
    assert all(a == b for w, a, b in zip(text, short.tolist(), whole.tolist()) if len(w) < 300)
    assert len(word_hashes(b" \n ")) == len(word_hashes(b"")) == 0


def leaks(text, items, n=10):
    words = ALNUM_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, item_text in items:
        own = ALNUM_WORD.findall((item_text or "").translate(LOWER))
        k = min(n, len(own))
        for j in range(len(own) - k + 1 if k else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == own[j : j + k]:
                    hit.update(range(i, i + k))
                    found |= {item} - {None}
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("block_rows", [decontaminate.BLOCK_ROWS, 40])
def test_leaks_equal_brute_force(spark, block_rows):
    passage = " ".join(prose(2, 70).split(" ")[20:50])
    items = [(1, passage), (2, "Two-Words"), (2, "one"), (3, None), (4, ""), (5, prose(77, 30)), (None, prose(41, 15)), (12, prose(1, 180)), (12, prose(1, 180))]
    docs = frame(spark, odd_rows())
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench, block_rows=block_rows).collect()
    want = sorted((str(r[0]), str(r[1]), *map(str, leaks(r[1], items))) for r in odd_rows())
    assert sorted((str(r.doc_id), str(r.text), str(r.n_words), str(r.hit_words), str(r.item_ids)) for r in found) == want
    assert {r.label for r in found} == {"clash", None}


def test_leak_removal(spark):
    docs = frame(spark, odd_rows())
    bench = spark.createDataFrame([(1, " ".join(prose(2, 70).split(" ")[5:60]))], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5
    cut = decontaminate.decontaminate(docs, bench, remove="spans")
    assert {r.n_words for r in cut.collect()} == {r.n_words for r in kept.collect()} == {"clash", None} and cut.schema == docs.schema
    assert cut.count() == docs.count() and decontaminate.find_leaks(cut, bench).filter(F.size("hit_words") > 0).count() == 0
    assert {r.text for r in cut.filter("doc_id < 15").collect()} == {r.text for r in docs.filter("doc_id < 15").collect()}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, empty).count() == docs.count()
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_ids_digest():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def counted(text):
    words = BLANK_WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeats = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if BLANK_WORD.search(x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(repeats) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(repeats), failed


def test_quality_counts_and_verdicts(spark):
    rows = odd_rows() + [(200 + i, prose(300 + i, 150), "en", "a", 0, "", "") for i in range(40)]
    docs = frame(spark, rows)
    references = quality.learn_references(docs)
    found = quality.judge(docs, references).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(str, ((r.doc_id, r.text, *[r[f] for f in fields]) for r in found))) == sorted(map(str, ((r[0], r[1], *counted(r[1])) for r in rows)))
    assert all(r.kept for r in found if r.doc_id and r.doc_id >= 200)
    assert all(r.class_distance is None or 0 <= r.class_distance <= 1 for r in found)
    assert not any(r.kept and r.base_failed for r in found)
    kept = quality.keep_good(docs, references)
    assert kept.schema == docs.schema and kept.count() == sum(r.kept for r in found)
    again = quality.learn_references(docs.repartition(5))
    for lang, one in references.items():
        assert again[lang].words == one.words and (again[lang].shares == one.shares).all() and (again[lang].classes == one.classes).all()
    assert quality.judge(docs.limit(0), quality.learn_references(docs.limit(0))).count() == 0


def test_distance():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert quality.distance(p, p) == 0 and quality.distance(p, q) == 1
    half = quality.distance(p, np.array([0.5, 0.5]))
    assert abs(half - (0.5 * np.log2(1 / 0.75) + 0.25 * np.log2(0.5 / 0.75) + 0.25 * np.log2(0.5 / 0.25)) ** 0.5) < 1e-12


def test_odd_symbols_are_rejected(spark):
    rows = [(i, prose(i, 150), "en", "a", 0, "", "") for i in range(60)] + [(99, " ".join(w + "***" for w in prose(500, 150).split(" ")), "en", "a", 0, "", "")]
    found = quality.judge(frame(spark, rows), quality.learn_references(frame(spark, rows))).collect()
    assert [r.doc_id for r in found if not r.kept] == [99]
