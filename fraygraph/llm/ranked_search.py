"""Ranked lexical search by document FP-trees.

Documents are read once: each becomes a vector restricted to the terms of the items, with its length. The vectors are ordered
by frequency (terms held by most documents first) and documents with a common prefix share a path of a trie. Every node knows
the largest tf of each term and the smallest m (length norm) below it, so the score of everything below is bounded. Per item
the tree is searched depth first, highest bound first: a subtree whose bound is below the current k-th score is cut, a leaf
(up to ``LEAF`` neighbouring documents) is scored exactly. Thresholds live on from tree to tree of a task, tasks hand on at
most k rows per item, and the best of them are merged in two rounds, so no task gathers the rows of an item.

Scores are the whole numbers of the contract of ``op11``: a term adds w * ((10^9 tf) div (1000 tf + 12 m)), which grows with tf
and falls with m; equal scores go to the smaller id, a null id last. Bounds only decide what is opened, never what is returned.

Nulls and odd input: null, empty and wordless texts hold no terms, count nowhere and are never returned; items without terms
(or whose terms no document holds) return nothing; repeated item rows are each answered, repeated documents are each ranked;
a null item_id is an item like any other. Without documents or items the result is empty. Other columns are ignored.

Size: items are answered in blocks of about ``BLOCK_TERMS`` terms, which is what travels to the tasks; a tree holds at most
``TREE_DOCUMENTS`` documents and about ``TREE_ENTRIES`` terms of them; long texts are counted in stretches.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.llm.tables import query, read
from fraygraph.llm.words import ALPHANUMERIC
from fraygraph.session import store

BEST = 20
LEAF = 64
LEVELS = 64
TREE_DOCUMENTS = 8192
TREE_ENTRIES = 1 << 20
BLOCK_TERMS = 200_000
STRETCH = 1 << 20
VECTORS = "name long, n long, terms array<int>, tfs array<int>"
FOUND = "item int, score long, name long, shard int"


def term_counts(text: str | None) -> Counter:
    """Occurrences of every term of ``text``, counted in stretches of about ``STRETCH`` bytes."""
    data = (text or "").encode().translate(ALPHANUMERIC)
    counts: Counter = Counter()
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= STRETCH else data.find(b" ", at + STRETCH)
        end = len(data) if end < 0 else end
        counts.update(data[at:end].split())
        at = end
    return counts


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(id, copies, terms, counts) of every distinct (item, text) that has a term."""

    def run(batches):
        for batch in batches:
            counts = [term_counts(t) for t in batch.column(1).to_pylist()]
            kept = [i for i, c in enumerate(counts) if c]
            terms = [sorted(counts[i]) for i in kept]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(kept, pa.int64())), batch.column(2).take(pa.array(kept, pa.int64())), pa.array(terms, pa.list_(pa.binary())),
                    pa.array([[counts[i][t] for t in own] for i, own in zip(kept, terms)], pa.list_(pa.int32())),
                ],
                names=["id", "copies", "terms", "counts"],
            )

    distinct = items.groupBy(F.col(item).alias("id"), F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    kind = distinct.schema["id"].dataType.simpleString()
    return distinct.mapInArrow(run, f"id {kind}, copies long, terms array<binary>, counts array<int>")


def restricted_vectors(documents: DataFrame, vocabulary: dict[bytes, int], text: str, name: str) -> DataFrame:
    """(name, n, terms, tfs) of every document with a term: its length and how often it holds the terms of ``vocabulary``."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for batch in batches:
            lengths, sizes, terms, tfs = [], [], [], []
            for t in batch.column(1).to_pylist():
                counts = term_counts(t)
                own = [(known[w], c) for w, c in counts.items() if w in known]
                lengths.append(counts.total())
                sizes.append(len(own))
                terms += [x for x, _ in own]
                tfs += [c for _, c in own]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            columns = [batch.column(0), pa.array(lengths, pa.int64())]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "n", "terms", "tfs"])

    vectors = documents.select(F.col(name).cast("long"), text).mapInArrow(run, VECTORS)
    return vectors.filter("n > 0")


def document_frequencies(vectors: DataFrame, size: int) -> DataFrame:
    """(term, df): documents that hold each term; at most ``size`` rows, counted in the tasks first."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["term", "df"])

    return vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i] - 1 of all i, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class FpTree:
    """The documents of one block: ``ranks`` (ascending inside a document) and ``tfs`` of document i lie at
    starts[i] .. starts[i] + sizes[i] - 1."""

    def __init__(self, names: list, m: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, tfs: np.ndarray):
        starts = np.cumsum(sizes) - sizes
        paths = ranks.astype(">u4").tobytes()
        keys = [paths[4 * a : 4 * b] for a, b in zip(starts.tolist(), (starts + sizes).tolist())]
        order = np.array(sorted(range(len(names)), key=keys.__getitem__), np.int64)
        moved = spread(starts[order], sizes[order])
        self.names = [names[i] for i in order.tolist()]
        self.m, self.sizes = m[order], sizes[order]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ranks, self.tfs = ranks[moved], tfs[moved]
        self.low, self.high, self.parent, self.level, self.children = [], [], [], [], []
        self._split()
        self._leaves()
        self._bounds()

    def _node(self, low: int, high: int, parent: int) -> int:
        node = len(self.low)
        self.low.append(low)
        self.high.append(high)
        self.parent.append(parent)
        self.level.append(self.level[parent] + 1 if parent >= 0 else 0)
        self.children.append([])
        if parent >= 0:
            self.children[parent].append(node)
        return node

    def _split(self) -> None:
        """Nodes by shared prefixes; neighbouring small branches of a node become one leaf, long runs of equal paths several."""
        open_nodes = [self._node(0, len(self.names), -1)]
        while open_nodes:
            node = open_nodes.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            first, last = (self.ranks[self.starts[i] : self.starts[i] + self.sizes[i]] for i in (low, high - 1))
            both = min(len(first), len(last))
            apart = np.flatnonzero(first[:both] != last[:both])
            shared = int(apart[0]) if len(apart) else both
            if self.level[node] >= LEVELS or shared == len(first) == len(last):
                for at in range(low, high, LEAF):
                    self._node(at, min(high, at + LEAF), node)
                continue
            longer = self.sizes[low:high] > shared
            step = np.full(high - low, -1, np.int64)
            step[longer] = self.ranks[self.starts[low:high][longer] + shared]
            edges = [low, *(low + 1 + np.flatnonzero(np.diff(step))).tolist(), high]
            at = low
            for a, b in zip(edges, edges[1:]):
                if b - at <= LEAF:
                    continue
                if a > at:
                    self._node(at, a, node)
                if b - a > LEAF:
                    open_nodes.append(self._node(a, b, node))
                at = b if b - a > LEAF else a
            if at < high:
                self._node(at, high, node)

    def _leaves(self) -> None:
        """Entries of every leaf by term: document (place inside the leaf) and what a weight of one scores there."""
        self.leaves = [i for i, c in enumerate(self.children) if not c]
        leaf_of = np.empty(len(self.names), np.int64)
        for i in self.leaves:
            leaf_of[self.low[i] : self.high[i]] = i
        document = np.repeat(np.arange(len(self.names)), self.sizes)
        node = leaf_of[document]
        order = np.lexsort((self.ranks, node))
        self.entry_rank, node, document, tf = self.ranks[order], node[order], document[order], self.tfs[order]
        self.entry_document = document - np.array(self.low)[node]
        self.entry_gain = 1_000_000_000 * tf // (1000 * tf + 12 * self.m[document])
        self.leaf_edges = {i: tuple(np.searchsorted(node, [i, i + 1]).tolist()) for i in self.leaves}
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(node) != 0) | (np.diff(self.entry_rank) != 0)])) if len(node) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(tf, heads) if len(heads) else tf
        self.most = [(self.entry_rank[heads], node[heads], most)]

    def _bounds(self) -> None:
        """Maxima of all nodes from those of their children, level by level, by term."""
        levels, parents = np.array(self.level), np.array(self.parent)
        rank, node, tf = self.most[0]
        waiting = [(rank[keep], node[keep], tf[keep]) for keep in (levels[node] == depth for depth in range(max(self.level) + 1))]
        done = []
        for depth in range(len(waiting) - 1, -1, -1):
            rank, node, tf = waiting[depth]
            done.append((rank, node, tf))
            if depth and len(rank):
                up = parents[node]
                order = np.lexsort((up, rank))
                rank, up, tf = rank[order], up[order], tf[order]
                heads = np.flatnonzero(np.concatenate([[True], (np.diff(rank) != 0) | (np.diff(up) != 0)]))
                rank, up, tf = rank[heads], up[heads], np.maximum.reduceat(tf, heads)
                waiting[depth - 1] = tuple(np.concatenate(x) for x in zip(waiting[depth - 1], (rank, up, tf)))
        rank, node, tf = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(rank, kind="stable")
        rank, self.bound_node, tf = rank[order], node[order], tf[order]
        least = np.array([self.m[a:b].min() for a, b in zip(self.low, self.high)])
        self.bound_gain = 1_000_000_000 * tf // (1000 * tf + 12 * least[self.bound_node])
        self.held, first = np.unique(rank, return_index=True)
        self.held_edges = np.append(first, len(rank))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> list[int]:
        """The most that a document below each node can score."""
        at = np.searchsorted(self.held, terms)
        inside = at < len(self.held)
        inside[inside] = self.held[at[inside]] == terms[inside]
        at, weights = at[inside], weights[inside]
        lengths = self.held_edges[at + 1] - self.held_edges[at]
        places = spread(self.held_edges[at], lengths)
        found = np.zeros(len(self.low), np.int64)
        np.add.at(found, self.bound_node[places], self.bound_gain[places] * np.repeat(weights, lengths))
        return found.tolist()

    def scores(self, leaf: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        a, b = self.leaf_edges[leaf]
        own = self.entry_rank[a:b]
        first = np.searchsorted(own, terms)
        lengths = np.searchsorted(own, terms, "right") - first
        places = spread(first, lengths) + a
        found = np.zeros(self.high[leaf] - self.low[leaf], np.int64)
        np.add.at(found, self.entry_document[places], self.entry_gain[places] * np.repeat(weights, lengths))
        return found

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple], k: int) -> int:
        """Merge the documents of the tree into ``best``, the k first of (-score, id is null, id); the leaves opened."""
        bounds = self.bounds(terms, weights)
        least = -best[-1][0] if len(best) == k else 1
        opened, waiting = 0, [0]
        while waiting:
            node = waiting.pop()
            if bounds[node] < least:
                continue
            if self.children[node]:
                waiting += sorted(self.children[node], key=bounds.__getitem__)
                continue
            opened += 1
            scores = self.scores(node, terms, weights)
            for i in np.flatnonzero(scores >= least).tolist():
                name = self.names[self.low[node] + i]
                best.append((-int(scores[i]), name is None, name or 0))
            if len(best) > k:
                best.sort()
                del best[k:]
            if len(best) == k:
                best.sort()
                least = -best[-1][0]
        return opened


def best_of_tasks(vectors: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], ranks: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """(item, score, name, shard): at most k rows per item and task. ``items`` are (terms, weights) by rank, ``ranks`` the
    place of every vocabulary term in order of frequency."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, ranks))

    def run(batches):
        wanted, place = shared.value
        best: list[list[tuple]] = [[] for _ in wanted]
        held: list[tuple] = []

        def answer():
            names = [x for part in held for x in part[0]]
            lengths, sizes, terms, tfs = (np.concatenate([part[i] for part in held]) for i in range(1, 5))
            own = place[terms].astype(np.int64)
            order = np.lexsort((own, np.repeat(np.arange(len(sizes)), sizes)))
            tree = FpTree(names, 75 + 25 * lengths * n // total, sizes, own[order], tfs[order].astype(np.int64))
            for (own_terms, weights), rows in zip(wanted, best):
                tree.search(own_terms, weights, rows, k)
            held.clear()

        count = entries = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                terms, tfs = part.column(2), part.column(3)
                sizes = np.diff(terms.offsets.to_numpy())
                lengths = part.column(1).to_numpy(zero_copy_only=False)
                held.append((part.column(0).to_pylist(), lengths, sizes.astype(np.int64), terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)))
                count, entries = count + part.num_rows, entries + int(sizes.sum())
                if count + 1024 > TREE_DOCUMENTS or entries >= TREE_ENTRIES:
                    answer()
                    count = entries = 0
        if held:
            answer()
        shard = TaskContext.get().partitionId()
        rows = [(i, -score, None if absent else name, shard) for i, own in enumerate(best) for score, absent, name in sorted(own)[:k]]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else ((), (), (), ()), kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "name", "shard"])

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, FOUND)


def search(documents: DataFrame, items: DataFrame, k: int = BEST, text: str = "text", name: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, document, score) of the k best documents of every row of ``items``; ids keep the names given, ids of
    documents are whole numbers."""
    terms = store(item_terms(items, item, item_text))
    blocks = max(1, -(-(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("id", "terms"), F.lit(blocks))
    answers = [_answer_block(documents, terms.filter(block == i).orderBy("id", "terms").collect(), terms, k, text, name) for i in range(blocks)]
    result = answers[0]
    for more in answers[1:]:
        result = result.unionByName(more)
    return result.select(F.col("id").alias(item), "rank", F.col("name").alias(name), "score")


def _answer_block(documents: DataFrame, rows: list, terms: DataFrame, k: int, text: str, name: str) -> DataFrame:
    spark = documents.sparkSession
    kind = terms.schema["id"].dataType.simpleString()
    if not rows:
        return spark.createDataFrame([], f"id {kind}, rank int, name long, score long")
    vocabulary = {w: i for i, w in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
    vectors = store(restricted_vectors(documents, vocabulary, text, name))
    n, total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for row in document_frequencies(vectors, len(vocabulary)).collect():
        df[row.term] = row.df
    ranks = np.empty(len(df), np.int32)
    ranks[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    wanted = []
    for row in rows:
        own = np.array([vocabulary[bytes(t)] for t in row.terms], np.int64)
        order = np.argsort(ranks[own])
        wanted.append((ranks[own][order].astype(np.int64), (weight[own] * np.array(row.counts, np.int64))[order]))
    found = store(best_of_tasks(vectors, wanted, ranks, n, total, k))
    shards = (found.agg(F.max("shard")).first()[0] or 0) + 1
    order = [F.col("score").desc(), F.col("name").asc_nulls_last()]
    few = found.withColumn("part", F.pmod("shard", F.lit(max(1, math.isqrt(shards)))))
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, r.id, r.copies) for i, r in enumerate(rows)], f"item int, id {kind}, copies long")
    answered = last.join(F.broadcast(ids), "item")
    return answered.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("id", "rank", "name", "score")


ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
TERMS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), {ALPHABET}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_ranked_search", rf"""
WITH items AS MATERIALIZED (SELECT row_number() OVER () AS row, item_id, {TERMS_SQL} AS w FROM benchmark),
docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {TERMS_SQL} AS w FROM documents),
sizes AS (SELECT id, doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
asked AS (SELECT row, item_id, term, count(*) AS times FROM (SELECT row, item_id, unnest(w) AS term FROM items) GROUP BY ALL),
counted AS MATERIALIZED (SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT id, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, totals GROUP BY term, n_docs),
gains AS MATERIALIZED (SELECT id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS gain
    FROM counted JOIN sizes USING (id) JOIN weights USING (term), totals),
scored AS (SELECT row, item_id, id, doc_id, sum(times * gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM placed WHERE rank <= 20""")
def _(spark, sf):
    return search(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "benchmark", "item_id", "text"))
