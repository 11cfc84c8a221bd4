"""The n-gram Jaccard join against all pairs."""

import random

import pytest
from llm.data import BLANK_WORD, LOWER, edited, frame, odd_rows, prose

from fraygraph.llm import jaccard


def sets_of(text):
    words = BLANK_WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def expected(rows):
    """doc_id, set size and component of each row, by all pairs."""
    sets = [sets_of(r[1]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(map(str, ((r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))))


def found(spark, rows):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.join_components(frame(spark, rows)).collect())


def test_odd_rows(spark):
    assert found(spark, odd_rows()) == expected(odd_rows())
    assert jaccard.join_components(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("block", [128, 7])
def test_chains_of_near_copies_and_shared_passages(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "QUERIES_PER_BLOCK", 5)
    r = random.Random(3)
    base, passage, rows = prose(1, 120), prose(2, 60), []
    for i in range(90):
        rows.append(edited(base, i, r.choice([0.0, 0.01, 0.02, 0.03, 0.04])))
    text = prose(8, 100)
    for i in range(25):  # a chain, each a little further
        text = edited(text, 1000 + i, 0.01)
        rows.append(text)
    rows += [passage + " " + prose(100 + i, r.choice([1, 2, 4, 8, 50])) for i in range(40)]
    rows += [" ".join(prose(7, 30).split(" ")[: 20 + i % 7]) for i in range(20)]
    r.shuffle(rows)
    table = [(i * 3 + 1, t, "en", "a", 0, "", "") for i, t in enumerate(rows)]
    assert found(spark, table) == expected(table)


def test_one_of_each_group_stays(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    empty = [r for r in rows if not sets_of(r[1])]
    parts = {eval(x)[2] for x in expected(rows) if eval(x)[1]}  # noqa: S307  own strings of tuples
    assert len(left) == len(empty) + len(parts)
    assert sorted(r.doc_id for r in left if sets_of(r.text)) == sorted(parts)


def test_overlaps_over_slices(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "COLUMNS", 3)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 40, n).astype(np.uint64)) for n in (5, 20, 1, 30)]
    others = [np.unique(r.integers(0, 40, n).astype(np.uint64)) for n in (9, 25)]
    assert jaccard.overlaps(sets, others).tolist() == [[len(set(a) & set(b)) for b in others] for a in sets]
    own = jaccard.overlaps(sets)
    assert all(own[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(4) for j in range(4) if i != j)
