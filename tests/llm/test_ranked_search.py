"""Ranked search against a plain scoring of every document, also with tiny trees, and the bounds of the trees."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from llm.data import ALNUM_WORD, LOWER, frame, odd_rows, prose

from fraygraph.llm import ranked_search


def terms(text):
    return ALNUM_WORD.findall((text or "").translate(LOWER))


def ranked(docs, items, k=20):
    own = [(name, Counter(terms(t))) for name, t in docs if terms(t)]
    n, total = len(own), sum(c.total() for _, c in own)
    df = Counter(w for _, c in own for w in c)
    rows = []
    for item, text in items:
        scored = []
        for name, counts in own:
            m = 75 + (25 * counts.total() * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * counts[w]) // (1000 * counts[w] + 12 * m)) for w in terms(text) if counts[w]
            )
            scored += [(-score, name is None, name)] if score else []
        rows += [(item, i + 1, name, -score) for i, (score, _, name) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return rows


def check(spark, rows, items, k=20):
    docs = frame(spark, rows)
    found = ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), k).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, ranked([(r[0], r[1]) for r in rows], items, k)))


ITEMS = [(1, prose(1, 40)), (2, prose(2, 30) + " ONE one one"), (3, None), (4, "nowhere-at-all"), (None, "two words"), (5, prose(99, 60)), (5, prose(99, 60)), (6, "  "), (7, "日本語 のテ é́")]


def test_odd_rows_equal_plain_scoring(spark):
    check(spark, odd_rows(), ITEMS)


@pytest.mark.parametrize("leaf, levels, documents, block", [(2, 64, 30, 200_000), (1, 3, 8, 40), (3, 64, 10_000, 60)])
def test_small_trees_and_item_blocks(spark, monkeypatch, leaf, levels, documents, block):
    monkeypatch.setattr(ranked_search, "LEAF", leaf)
    monkeypatch.setattr(ranked_search, "LEVELS", levels)
    monkeypatch.setattr(ranked_search, "TREE_DOCUMENTS", documents)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    r = random.Random(5)
    texts = [" ".join(r.choices(prose(7, 80).split(), k=r.randrange(1, 60))) for _ in range(150)]
    texts += [prose(7, 25)] * 60 + [" ".join(prose(7, 80).split()[:i]) for i in range(1, 50)]
    rows = [(i if i % 11 else None, t, None, None, 0, "clash", "clash") for i, t in enumerate(texts)]
    check(spark, rows, [(i, " ".join(r.choices(prose(7, 100).split(), k=12))) for i in range(12)], 7)


def test_empty_tables(spark):
    docs, items = frame(spark, odd_rows()), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.search(docs, items.filter("item_id = 6")).count() == 0


def test_bounds_hold_and_cut():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 30, 3000)
    ranks = np.concatenate([np.sort(r.choice(200, n, False, np.arange(200, 0, -1) / 20100)) for n in sizes]).astype(np.int64)
    tree = ranked_search.FpTree(list(range(3000)), 75 + sizes, sizes, ranks, r.integers(1, 9, len(ranks)))
    opened = 0
    for _ in range(20):
        own = np.sort(r.choice(200, 12, False)).astype(np.int64)
        weights = (own * 20 + 1).astype(np.int64)
        bounds = tree.bounds(own, weights)
        for leaf in tree.leaves:
            most, node = int(tree.scores(leaf, own, weights).max()), leaf
            while node >= 0:
                assert bounds[node] >= most
                node = tree.parent[node]
        best = []
        opened += tree.search(own, weights, best, 5)
        every = sorted((-int(s), False, tree.names[tree.low[x] + i]) for x in tree.leaves for i, s in enumerate(tree.scores(x, own, weights)) if s)
        assert best == every[:5]
    assert opened < 20 * len(tree.leaves)


def test_long_texts_are_counted_in_stretches(monkeypatch):
    text = prose(3, 5000)
    whole = ranked_search.term_counts(text)
    monkeypatch.setattr(ranked_search, "STRETCH", 100)
    assert ranked_search.term_counts(text) == whole == Counter(w.encode() for w in terms(text))
