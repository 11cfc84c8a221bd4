"""Mixing: targets against the iterated rule, rounding by its promises."""

import random
from collections import defaultdict

from llm.data import BLANK_WORD, frame, odd_rows, prose

from fraygraph.llm import mixing


def iterated(sizes):
    """Targets by dealing and resharing until no source is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    stopped, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2.0 * sizes[s] for s in stopped)
        left = [s for s in names if s not in stopped]
        target = {s: 2.0 * sizes[s] for s in stopped} | {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if target[s] > 2.0 * sizes[s] + 1e-9}
        if not above:
            return target
        stopped |= above


def table(n, seed, hot=0.4):
    r = random.Random(seed)
    sources = [None, "é", "z", "a", "", "B", "src1", "src10"]
    return [(i, prose(i % 50, int(min(3000, r.paretovariate(1.1) * 4))), "en", "hot" if r.random() < hot else r.choice(sources), 0, "", "") for i in range(n)]


def test_targets_and_rounding(spark):
    rows = table(1500, 5) + odd_rows()
    found = mixing.mix_copies(frame(spark, rows)).collect()
    size = {}
    sizes = defaultdict(int)
    for r in rows:
        size[r[0], r[1]] = len(BLANK_WORD.findall(r[1] or ""))
        sizes[r[3]] += size[r[0], r[1]]
    assert len(found) == len(rows)
    assert sorted((str(r.doc_id), str(r.source), r["size"]) for r in found) == sorted((str(r[0]), str(r[3]), size[r[0], r[1]]) for r in rows)
    target, taken, largest = iterated(sizes), defaultdict(int), defaultdict(int)
    for r in found:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source]) and r.source_size == sizes[r.source]
        ratio = target[r.source] / max(1, sizes[r.source])
        assert int(ratio) <= r.copies <= int(ratio) + 1 <= 3 and r.copies <= 2
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix_copies(frame(spark, rows).repartition(5)).collect()))


def test_levels_of_the_tree(spark):
    docs = spark.createDataFrame([(i, "x" if i % 3 else None, i % 97) for i in range(3000)], "doc_id long, source string, size long")
    sums = docs.groupBy("source").agg({"size": "sum", "doc_id": "count"}).toDF("source", "source_size", "docs")
    targets = mixing.source_targets(sums)
    found = mixing.round_copies(docs, targets, group=8).collect()
    assert len(found) == 3000
    for s in ("x", None):
        own = [r for r in found if r.source == s]
        assert abs(sum(r.copies * r["size"] for r in own) - own[0].target) <= 97


def test_probabilities_hold_on_average(spark):
    docs = spark.createDataFrame([(i, "a" if i < 40 else "b", 5 + 7 * i % 23) for i in range(60)], "doc_id long, source string, size long")
    sums = docs.groupBy("source").agg({"size": "sum", "doc_id": "count"}).toDF("source", "source_size", "docs")
    targets = mixing.source_targets(sums, weights=(1, 1), share=0.7)
    ratio = {r.source: r.target / r.source_size for r in targets.collect()}
    times, seeds = defaultdict(int), 12
    for seed in range(seeds):
        for r in mixing.round_copies(docs, targets, seed=seed).collect():
            times[r.source] += r.copies
    for s, n in (("a", 40), ("b", 20)):
        assert abs(times[s] / seeds / n - ratio[s]) < 0.15


def test_mixed_rows(spark):
    rows = table(300, 8) + odd_rows()
    docs = frame(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id, r.text] += 1
    want = defaultdict(int)
    text = {}
    for r in rows:
        text.setdefault((r[0], r[3], len(BLANK_WORD.findall(r[1] or ""))), []).append(r[1])
    for r in mixing.mix_copies(docs).collect():
        want[r.doc_id, r.source, r["size"]] += r.copies
    assert sum(got.values()) == sum(want.values())
    for (doc, source, size), n in want.items():
        assert sum(got[doc, t] for t in set(text[doc, source, size])) >= n or n == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix_copies(docs.limit(0)).count() == 0
