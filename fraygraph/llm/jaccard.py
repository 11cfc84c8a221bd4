"""N-gram Jaccard join: documents whose shingle sets overlap enough, by a token-group matrix.

A document is the set of its distinct word shingles (64-bit hashes); documents with equal sets are one node. The join gives
the connected components of all links, not the links themselves, so groups of near copies never become lists of pairs.

1. *Groups.* Nodes are dealt to similar groups by min-hashes: two of the whole set, so that copies of a text held by many
   meet, and one of its rarer shingles, so that documents with a common passage meet by what else they hold. A group is cut into blocks of about ``BLOCK`` nodes; a block is
   compared exactly at once by products of its node-shingle matrix, together with a few pivots of its group that tie the
   blocks of a large group. Components of these links are the groups of the matrix.
2. *Token-group matrix.* Its cells are the distinct (shingle, group) of the prefix shingles of all members: linked nodes share
   a shingle among their first n - ceil(0.85 n) + 1 in any fixed order. The order puts shingles that very many documents hold
   last, so common passages make few cells. Shingles in several groups name the pairs of groups that can be linked at all,
   if what both have left from that shingle on is enough.
3. *Bound.* A group keeps the least and largest member and, per hash bin, the most shingles of a member in that bin: a
   compressed union. The sum over bins of the smaller counts bounds the overlap of any member with any member of another
   group; pairs that cannot reach the needed overlap are not opened.
4. *Open.* The members of the smaller group are taken as queries to the blocks of the larger one and compared exactly.

The common-shingle list (at most ``COMMON`` rows) affects the order only, never the result. Nothing is capped or sampled.

Nulls and odd input: a null, empty or wordless text has an empty set, is linked with nothing and is its own component (also
when its doc_id repeats). With fewer than four words the whole sequence is the one shingle. Repeated rows are classed by
their text; null doc_ids take part in links but never name a component unless it has no other id. An empty table gives no
rows. Other columns are ignored by the join and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraygraph.llm.components import components
from fraygraph.llm.tables import query, read, unused
from fraygraph.llm.words import PRIME, blank_bytes, window_hashes, word_hashes
from fraygraph.session import hint_small, store

SHINGLE = 4
PERCENT = 85
BLOCK = 128
QUERIES_PER_BLOCK = 512
COMMON = 1 << 17
CHUNK = 1 << 21
BINS = 256
COLUMNS = 4096


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = word_hashes(blank_bytes(text))
    return np.unique(window_hashes(words, min(width, len(words)))) if len(words) else words


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of ``n`` with any set that it is linked with."""
    return -(-percent * n // 100)


def common_shingles(documents: DataFrame, most: int = COMMON) -> np.ndarray:
    """Hashes of at most ``most`` shingles held by the most documents, the more frequent ones later.

    A task reports what several documents of a chunk of it hold; that is enough, since the list only shapes an order.
    """

    def run(batches):
        held, size, docs = [], 0, 0

        def report():
            found, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= max(3, docs // 2000)
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(count[often])], names=["shingle", "docs"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingle_set(text))
                size, docs = size + len(held[-1]), docs + 1
                if size >= CHUNK:
                    yield report()
                    held, size, docs = [], 0, 0
        if held:
            yield report()

    parts = documents.select("text").mapInArrow(run, "shingle long, docs long")
    sums = parts.groupBy("shingle").agg(F.sum("docs").alias("docs"))
    rows = sums.orderBy(F.desc("docs"), "shingle").limit(most).collect()
    return np.array([r.shingle for r in reversed(rows)], np.int64).view(np.uint64)


NODES = "doc_id long, text_key long, text_bytes int, n_shingles long, node binary, key1 long, key2 long, key3 long, commonness double, prefix binary, bins binary"


def describe(documents: DataFrame, common: np.ndarray) -> DataFrame:
    """One row per document: its node (digest of the set), min-hash keys, prefix shingles and bin counts."""
    by_hash = np.argsort(common, kind="stable")
    shared = documents.sparkSession.sparkContext.broadcast((common[by_hash], by_hash.astype(np.int64)))  # at most COMMON rows

    def one(shingles: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> tuple:
        n = len(shingles)
        if not n:
            return n, None, None, None, None, 0.0, b"", b""
        rank = np.zeros(n, np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
            found = hashes[at] == shingles
            rank[found] = places[at[found]] + 1
        rare = shingles[rank == 0]
        keys = []
        for salt, own in ((1, shingles), (2, shingles), (3, rare if len(rare) else shingles)):
            mixed = (own ^ np.uint64(salt * 0x9E3779B1)) * PRIME
            keys.append(int(np.min(mixed ^ (mixed >> np.uint64(31))).view(np.int64)))
        first = n - needed(n) + 1
        prefix = rare[:first]
        if len(prefix) < first:
            prefix = np.concatenate([prefix, shingles[rank > 0][np.argsort(rank[rank > 0])[: first - len(prefix)]]])
        bins = np.minimum(np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)
        return n, xxhash.xxh3_128_digest(shingles.tobytes()), *keys, 1 - len(rare) / n, prefix.tobytes(), bins.tobytes()

    def run(batches):
        hashes, places = shared.value
        for batch in batches:
            rows = [one(shingle_set(text), hashes, places) for text in batch.column(1).to_pylist()]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *made], names=[c.split()[0] for c in NODES.split(", ")])

    return documents.select("doc_id", "text", *text_key()).mapInArrow(run, NODES)


def text_key() -> tuple[Column, Column]:
    return F.xxhash64("text").alias("text_key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("text_bytes")


def with_texts(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """``rows`` (text_key, text_bytes, ...) with the texts; equal texts are read once, all others stay where they are."""
    wanted = hint_small(store(rows.select("text_key", "text_bytes").distinct()))
    texts = documents.select("text", *text_key()).join(wanted, ["text_key", "text_bytes"], "left_semi")
    return rows.join(texts.dropDuplicates(["text_key", "text_bytes"]), ["text_key", "text_bytes"])


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Exact overlap of every one of ``sets`` with every one of ``others`` (default: of ``sets``), by matrix products over
    slices of the shingles that occur twice or more."""
    both = sets + (others or [])
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    several = count > 1
    column = np.cumsum(several) - 1
    keep = several[place]
    column, owner = column[place[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    right = slice(0, None) if others is None else slice(len(sets), None)
    found = np.zeros((len(sets), len(sets if others is None else others)), np.float32)
    width = int(several.sum())
    for start in range(0, width, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        matrix = np.zeros((len(both), min(COLUMNS, width - start)), np.float32)
        matrix[owner[low:high], column[low:high] - start] = 1
        found += matrix[: len(sets)] @ matrix[right].T
    return np.rint(found).astype(np.int64)


def linked(sets: list[np.ndarray], others: list[np.ndarray] | None = None, percent: int = PERCENT) -> np.ndarray:
    common = overlaps(sets, others)
    sizes, other_sizes = (np.array([len(s) for s in x]) for x in (sets, sets if others is None else others))
    return (common > 0) & (100 * common >= percent * (sizes[:, None] + other_sizes[None, :] - common))


def in_groups(batches, keys: int):
    """Lists of rows with equal first ``keys`` columns, from batches sorted by them."""
    held, own = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != own:
                if held:
                    yield held
                held, own = [], row[:keys]
            held.append(row)
    if held:
        yield held


def block_links(members: DataFrame) -> DataFrame:
    """Links (a, b) that span the components inside each block of ``members`` (key, slot, node, text)."""

    def run(batches):
        for rows in in_groups(batches, 2):
            rows = list({r[2]: r for r in rows}.values())
            sets = [shingle_set(r[3]) for r in rows]
            near = linked(sets)
            a, b, seen = [], [], np.zeros(len(rows), bool)
            for start in range(len(rows)):
                if seen[start]:
                    continue
                seen[start], border = True, [start]
                while border:
                    at = border.pop()
                    for other in np.flatnonzero(near[at] & ~seen).tolist():
                        seen[other] = True
                        border.append(other)
                        a.append(rows[start][2])
                        b.append(rows[other][2])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    dealt = members.select("key", "slot", "node", "text").repartition("key", "slot").sortWithinPartitions("key", "slot")
    return dealt.mapInArrow(run, "a binary, b binary")


def similar_groups(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links found inside groups of equal min-hash key, in blocks that share pivots."""
    keyed = nodes.select("node", "text_key", "text_bytes", "commonness", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"key{i}").alias("k")) for i in (1, 2, 3)])).alias("key"))
    keyed = keyed.select("node", "text_key", "text_bytes", "commonness", F.xxhash64("key.i", "key.k").alias("key"))
    own = F.struct("node", "text_key", "text_bytes")
    draws = [F.xxhash64(F.lit(i), "node") for i in (1, 2)]
    groups = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.array(F.max_by(own, F.struct("commonness", "node")), *[F.max_by(own, F.struct(d, "node")) for d in draws]).alias("pivots"),
    )
    groups = store(groups.filter("nodes > 1").withColumn("blocks", F.ceil(F.col("nodes") / BLOCK)))
    slot = F.pmod(F.xxhash64("node", "key"), F.col("blocks"))
    members = keyed.join(groups.select("key", "blocks"), "key").select("key", slot.alias("slot"), "node", "text_key", "text_bytes")
    pivots = groups.filter("blocks > 1").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("slot"), F.explode("pivots").alias("p"))
    members = members.unionByName(pivots.select("key", "slot", "p.*"))
    return block_links(with_texts(members, documents))


CELLS = "shingle long, grp long, least int, most int, rest int"


def group_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of groups that may hold a link, from the prefixes of ``members`` (prefix, n_shingles, grp, least,
    most).

    A cell of the matrix also keeps ``rest``: the most shingles that a member has from this one on, in the order. Take the
    first shingle that two linked documents share: all they share is in the rest of both. So groups are paired by a shingle
    only if both rests, and their sizes, allow the needed overlap.
    """

    def cell_rows(batches):
        for batch in batches:
            found = []
            for prefix, n, group, least, most in zip(*(c.to_pylist() for c in batch.columns)):
                shingles = np.frombuffer(prefix, np.int64)
                rows = np.empty((len(shingles), 5), np.int64)
                rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4] = shingles, group, least, most, n - np.arange(len(shingles))
                found.append(rows)
            rows = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
            rows = rows[np.lexsort((-rows[:, 4], rows[:, 1], rows[:, 0]))]
            first = np.ones(len(rows), bool)
            first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            rows = rows[first]
            kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i].astype(k)) for i, k in enumerate(kinds)], names=[c.split()[0] for c in CELLS.split(", ")])

    def fitting(left, right):
        need = np.maximum(PERCENT * np.maximum(left[:, 2], right[:, 2]) / 100, PERCENT * (left[:, 2] + right[:, 2]) / (100 + PERCENT)) - 1e-6
        sizes = (left[:, 2] * PERCENT <= right[:, 3] * 100) & (right[:, 2] * PERCENT <= left[:, 3] * 100)
        return (left[:, 1] != right[:, 1]) & sizes & (left[:, 4] >= need) & (right[:, 4] >= need)

    def found_in(rows):
        """Pairs in sorted whole runs of equal shingles; in order of least size the partners of a group are a stretch."""
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        change = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        sizes = np.diff(np.append(change, len(rows)))
        twos = change[sizes == 2]
        pairs = [(twos, twos + 1)]
        for start, size in zip(change[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = rows[start : start + size]
            # A cell whose rest is below the least need of its own size pairs with nobody.
            own_places = start + np.flatnonzero(own[:, 4] * 100 >= PERCENT * own[:, 2])
            least, most = rows[own_places, 2], rows[own_places, 3]
            counts = np.maximum(np.searchsorted(least * PERCENT, most * 100, "right") - np.arange(len(least)) - 1, 0)
            for at in range(0, len(least), 4096):
                part = counts[at : at + 4096]
                left = at + np.repeat(np.arange(len(part)), part)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(part) - part, part)
                left, right = own_places[left], own_places[right]
                good = fitting(rows[left], rows[right])
                pairs.append((left[good], right[good]))
        left, right = (np.concatenate(x) for x in zip(*pairs))
        good = fitting(rows[left], rows[right])
        named = np.sort(np.stack([rows[left[good], 1], rows[right[good], 1]], 1), axis=1)
        return np.unique(named, axis=0)

    def pairs(batches):
        rest, held, size = np.zeros((0, 5), np.int64), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([rest, np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], 1)])
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            rest = rows[cut:]
            if cut:
                held.append(found_in(rows[:cut]))
                size += len(held[-1])
            if size > CHUNK:
                held = [np.unique(np.concatenate(held), axis=0)]
                yield named_pairs(held.pop())
                size = 0
        if len(rest):
            held.append(found_in(rest))
        if held:
            yield named_pairs(np.unique(np.concatenate(held), axis=0))

    def named_pairs(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])

    dealt = members.mapInArrow(cell_rows, CELLS).repartition("shingle").sortWithinPartitions("shingle")
    return dealt.mapInArrow(pairs, "a long, b long").distinct()


def group_bounds(members: DataFrame) -> DataFrame:
    """(grp, label, nodes, least, most, bins): per group the sizes of its members and the largest count of each bin.

    A task sends one row per group it has met; a group of any size meets in as many rows as there are tasks.
    """

    def partial(batches):
        for batch in batches:
            held: dict = {}
            for label, least, most, nodes, bins in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(bins, np.uint8)
                if label in held:
                    own = held[label]
                    held[label] = (min(own[0], least), max(own[1], most), own[2] + nodes, np.maximum(own[3], counts))
                else:
                    held[label] = (least, most, nodes, counts)
            rows = [(label, *own[:3], own[3].tobytes()) for label, own in held.items()]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["label", "least", "most", "nodes", "bins"])

    schema = "label binary, least long, most long, nodes long, bins binary"
    own = members.select("label", F.col("n_shingles").alias("least"), F.col("n_shingles").alias("most"), F.lit(1).cast("long").alias("nodes"), "bins")
    first = own.mapInArrow(partial, schema)

    def merged(batches):
        for rows in in_groups(batches, 1):
            bins = np.maximum.reduce([np.frombuffer(r[4], np.uint8) for r in rows])
            made = [[rows[0][0]], [min(r[1] for r in rows)], [max(r[2] for r in rows)], [sum(r[3] for r in rows)], [bins.tobytes()]]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds)], names=["label", "least", "most", "nodes", "bins"])

    return first.repartition("label").sortWithinPartitions("label").mapInArrow(merged, schema)


def can_link(pairs: DataFrame) -> DataFrame:
    """The pairs of groups whose bound reaches the overlap that a link needs."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = {n: batch.column(n) for n in batch.schema.names}
            bins_a, bins_b = (np.frombuffer(b"".join(get[n].to_pylist()), np.uint8).reshape(-1, BINS) for n in ("bins_a", "bins_b"))
            smaller = np.minimum(bins_a, bins_b).astype(np.int64)
            bound = smaller.sum(axis=1)
            bound[(smaller == 255).any(axis=1)] = np.iinfo(np.int64).max
            least_a, least_b = (np.asarray(get[n]) for n in ("least_a", "least_b"))
            enough = np.maximum(PERCENT * np.maximum(least_a, least_b) / 100, PERCENT * (least_a + least_b) / (100 + PERCENT))
            yield batch.filter(pa.array(bound >= enough - 1e-6)).select(["label_a", "nodes_a", "label_b", "nodes_b"])

    return pairs.mapInArrow(run, "label_a binary, nodes_a long, label_b binary, nodes_b long")


def open_groups(pairs: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a, b) between labels: members of the smaller group against the blocks of the larger one, exactly."""
    swap = F.col("nodes_a") > F.col("nodes_b")
    sides = pairs.select(
        F.when(swap, F.col("label_b")).otherwise(F.col("label_a")).alias("asking"), F.when(swap, F.col("label_a")).otherwise(F.col("label_b")).alias("opened"),
    )
    member = nodes.select("label", "node", "text_key", "text_bytes")
    asking = sides.join(member.withColumnRenamed("label", "asking"), "asking")
    blocks = member.groupBy(F.col("label").alias("opened")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    load = asking.groupBy("opened").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_BLOCK).alias("parts"))
    load = store(load.join(blocks, "opened"))
    slots = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("slot")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")
    queries = asking.join(load, "opened").select("opened", part, F.lit(1).alias("role"), F.col("asking").alias("label"), "node", "text_key", "text_bytes", slots)
    opened = member.withColumn("opened", F.col("label")).join(load, "opened")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    opened = opened.select("opened", parts, F.lit(0).alias("role"), "label", "node", "text_key", "text_bytes", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("slot"))
    rows = with_texts(queries.unionByName(opened), documents).select("opened", "part", "slot", "role", "label", "node", "text")

    def run(batches):
        for group in in_groups(batches, 3):
            members = [shingle_set(r[6]) for r in group if r[3] == 0]
            asked = [(r[4], shingle_set(r[6])) for r in group if r[3] == 1]
            if not members or not asked:
                continue
            near = linked([s for _, s in asked], members).any(axis=1)
            found = sorted({asked[i][0] for i in np.flatnonzero(near).tolist()})
            yield pa.RecordBatch.from_arrays([pa.array([group[0][0]] * len(found), pa.binary()), pa.array(found, pa.binary())], names=["a", "b"])

    dealt = rows.repartition("opened", "part", "slot").sortWithinPartitions("opened", "part", "slot", "role")
    return dealt.mapInArrow(run, "a binary, b binary")


def _joined(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, text_key, text_bytes, n_shingles and, unless it is empty, the document that names its
    component (first: struct of doc_id, text_key, text_bytes; the least id, null last)."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = store(describe(documents, common_shingles(documents)))
    some = described.filter("n_shingles > 0")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "text_bytes")
    classes = some.groupBy("node").agg(
        F.min(row).alias("first"), F.max("n_shingles").alias("n_shingles"), F.min("key1").alias("key1"), F.min("key2").alias("key2"), F.min("key3").alias("key3"), F.max("commonness").alias("commonness")
    )
    nodes = store(classes.select("node", "first", "first.text_key", "first.text_bytes", "n_shingles", "key1", "key2", "key3", "commonness"))

    small = hint_small(components(store(similar_groups(nodes, documents))).toDF("node", "_label"))
    label = F.coalesce("_label", "node").alias("label")
    grouped = store(nodes.join(small, "node", "left").select("node", label, "first", "text_key", "text_bytes"))

    one_each = some.join(small, "node", "left").select("n_shingles", "bins", "prefix", label)
    code = F.xxhash64("label").alias("grp")
    bounds = store(group_bounds(one_each))
    sizes = hint_small(bounds.filter("least < most").select("label", "least", "most"))
    least, most = (F.coalesce(c, "n_shingles").cast("int").alias(c) for c in ("least", "most"))
    pairs = store(group_pairs(one_each.join(sizes, "label", "left").select("prefix", "n_shingles", code, least, most)))
    side = bounds.select(code, "label", "least", "nodes", "bins")
    for x in ("a", "b"):
        pairs = pairs.join(side.toDF(x, *[f"{c}_{x}" for c in ("label", "least", "nodes", "bins")]), x)
    across = open_groups(store(can_link(pairs)), grouped, documents)

    merged = hint_small(components(store(across)).toDF("label", "_merged"))
    final = grouped.join(merged, "label", "left").withColumn("final", F.coalesce("_merged", "label"))
    firsts = final.groupBy("final").agg(F.min("first").alias("_first"))
    by_node = final.join(firsts, "final").select("node", F.col("_first").alias("first"))
    return described.select("doc_id", "text_key", "text_bytes", "n_shingles", "node").join(by_node, "node", "left").drop("node")


def join_components(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents`` (doc_id, text)."""
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id")
    return _joined(documents).select("doc_id", "n_shingles", component)


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents`` with one document of each component, the one that names it; empty texts stay."""
    found = store(_joined(documents))
    key = [F.col("doc_id"), F.col("text_key"), F.col("text_bytes")]
    is_first = key[0].eqNullSafe(F.col("first.doc_id")) & (key[1] == F.col("first.text_key")) & (key[2] == F.col("first.text_bytes"))
    id_, hash_, size_, key_, bytes_ = unused(documents, "of_id", "of_hash", "of_size", "key", "bytes")
    named = found.filter("n_shingles > 0").select(*[c.alias(n) for n, c in zip((id_, hash_, size_), key)], is_first.alias("is_first"))
    dropped = hint_small(named.filter("NOT is_first").drop("is_first").distinct())
    repeated = named.filter("is_first").groupBy(id_, hash_, size_).count().filter("count > 1").drop("count")
    keyed = documents.withColumns({key_: F.xxhash64("text"), bytes_: F.coalesce(F.octet_length("text"), F.lit(0))})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(key_) == F.col(hash_)) & (F.col(bytes_) == F.col(size_))
    kept = keyed.join(dropped, same, "left_anti")
    if repeated.isEmpty():
        return kept.select(*documents.columns)
    repeated = hint_small(store(repeated))
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", key_, bytes_])
    return kept.join(repeated, same, "left_anti").unionByName(once).select(*documents.columns)


@query("op3_jaccard_components")
def _(spark, sf):
    return join_components(read(spark, sf, "documents", "doc_id", "text"))
