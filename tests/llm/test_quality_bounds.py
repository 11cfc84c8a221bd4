"""Quality bounds: junk whose distances lie below those of the farthest good text, and copies that must not set the bound."""

import random

from llm.data import frame, prose

from fraygraph.llm import quality


def sentences(seed, words):
    r = random.Random(seed)
    parts = prose(seed, words).split(" ")
    return " ".join(w.capitalize() + ("." if r.random() < 0.1 else "") if r.random() < 0.1 else w for w in parts)


def menu(seed, words):
    return " | ".join(prose(seed, words).split(" "))


def test_menus_are_rejected_and_copies_do_not_set_the_bound(spark):
    good = [(i, sentences(i, 130 + i % 100), "en", "a", 0, "", "") for i in range(300)]
    bad = [(1000 + i, menu(1000 + i, 150), "en", "a", 0, "", "") for i in range(15)]
    copies = [(2000 + i, sentences(7, 137), "en", "a", 0, "", "") for i in range(300)]
    for rows in (good + bad, good + bad + copies):
        docs = frame(spark, rows)
        found = quality.judge(docs, quality.learn_references(docs)).collect()
        assert not [r.doc_id for r in found if r.kept and 1000 <= r.doc_id < 2000]
        assert sum(not r.kept for r in found if not 1000 <= r.doc_id < 2000) <= 3


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = quality.judge(docs, quality.learn_references(docs)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = [r for r in found.filter("NOT base_failed AND n_words >= 60").collect()]
    bad, good = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert sum(bad) <= 0.2 * len(bad) and sum(good) >= 0.99 * len(good)
