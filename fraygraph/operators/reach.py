"""Reachability, distance and disconnection as semi-naive fixpoints over (keys, v, val).

The state lies still: it is dealt once by (keys, v) and kept that way. A superstep sends only rows that changed in the last one
along the edges, combines what arrives before and after one shuffle, looks its present value up where the state lies, and
keeps what is better as a delta. Deltas are few rows; they are merged into the state when they add up to a part of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.operators.graph_build import Graph
from fraygraph.operators.ranking import number_within
from fraygraph.session import dealt, hint_small, replicate, settle

NEVER = 2**31 - 1  # batch number of a vertex or edge that is never removed
WORD = 63  # sources per bit mask row


# Deltas are merged into the state after so many supersteps, or once they hold this share of its rows.
MERGE_STEPS, MERGE_SHARE = 8, 0.5
SCALAR = {F.bit_or: lambda a, b: a.bitwiseOR(b), F.min: F.least, F.max: F.greatest}


def propagate(
    seeds: DataFrame,
    arcs: DataFrame,
    combine: Callable[[str], Column],
    send: Callable[[Column, Column], Column],
    keys: list[str],
    cap: DataFrame | None = None,
    cap_keys: list[str] | None = None,
) -> DataFrame:
    """Least fixpoint of val(v) = combine(seed(v), send(val(u), cap) over arcs u->v).

    ``seeds`` is (keys, v, val), ``arcs`` (src, dst), ``cap`` (cap_keys, cap) with cap_keys among keys, src, dst; a
    missing cap is null. ``combine`` is one of ``SCALAR``, ``send`` returns null to block an arc. Returns a settled
    (keys, v, val).
    """
    limits = hint_small(settle(cap.select(*cap_keys, "cap"))) if cap is not None else None
    better, on = SCALAR[combine], [*keys, "v"]
    names = [*on, "val"]

    def merged(*tables: DataFrame) -> DataFrame:
        rows = tables[0].select(*names)
        for table in tables[1:]:
            rows = rows.unionByName(table.select(*names))
        return rows.groupBy(*on).agg(combine("val").alias("val"))

    fresh = settle(seeds.groupBy(*on).agg(combine("val").alias("val")))
    (state, size), deltas, changed = dealt(fresh, on), [], 0
    rows = size
    while rows:
        sent = fresh.withColumnRenamed("v", "src").join(arcs, "src")
        sent = sent.join(limits, cap_keys, "left") if limits is not None else sent.withColumn("cap", F.lit(None).cast("int"))
        sent = sent.select(*keys, F.col("dst").alias("v"), send(F.col("val"), F.col("cap")).alias("val")).filter("val is not null")
        come = merged(sent).join(state.withColumnRenamed("val", "old"), on, "left")
        if deltas:
            come = come.join(merged(*deltas).withColumnRenamed("val", "newer"), on, "left").withColumn("old", F.coalesce("newer", "old"))
        now = F.when(F.col("old").isNull(), F.col("val")).otherwise(better(F.col("val"), F.col("old")))
        fresh = settle(come.withColumn("val", now).filter(F.col("old").isNull() | (F.col("val") != F.col("old"))).select(*names))
        rows = fresh.count()
        deltas.append(fresh)
        changed += rows
        if len(deltas) == MERGE_STEPS or changed > MERGE_SHARE * size:
            before = state
            (state, size), deltas, changed = dealt(merged(state, *deltas), on), [], 0
            before.unpersist()
    result = settle(merged(state, *deltas) if deltas else state.select(*names))
    state.unpersist()
    return result


def intact_scenario(graph: Graph) -> DataFrame:
    return graph.spark.range(1).select(F.col("id").alias("scenario"))


def live_seeds(seeds: DataFrame, removed: DataFrame | None) -> DataFrame:
    return seeds if removed is None else seeds.join(removed.select("scenario", "v"), ["scenario", "v"], "left_anti")


def removal_cap(removed: DataFrame | None) -> tuple[DataFrame | None, list[str]]:
    if removed is None:
        return None, []
    return removed.select("scenario", F.col("v").alias("dst"), F.lit(0).alias("cap")).distinct(), ["scenario", "dst"]


def source_words(graph: Graph) -> DataFrame:
    """(s, word, bit): sources packed 63 to a mask, so the reach relation has one row per word instead of per source."""
    numbered = number_within(graph.sources.withColumn("_all", F.lit(0)), ["_all"], ["v"], group_rows=graph.vertices.count())
    index = F.col("n") - 1
    return settle(numbered.select(F.col("v").alias("s"), F.floor(index / WORD).cast("int").alias("word"), (index % WORD).cast("int").alias("bit")))


def reach_masks(graph: Graph, scenarios: DataFrame, removed: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """(scenario, word, v, val): which sources of each word reach v when the scenario's vertices are gone."""
    words = source_words(graph) if words is None else words
    seeds = graph.spread(words.select(F.col("s").alias("v"), "word", F.expr("shiftleft(1L, bit)").alias("val")), scenarios)
    cap, on = removal_cap(removed)
    return propagate(
        live_seeds(seeds, removed), graph.arcs(), F.bit_or, lambda val, cap: F.when(cap.isNull(), val),
        ["scenario", "word"], cap, on,
    )


def reachable_pair_counts(graph: Graph, scenarios: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(scenario, reachable_pairs): (source, target) pairs joined by a path; zero rows kept."""
    masks = reach_masks(graph, scenarios, removed).join(hint_small(settle(graph.targets)), "v")
    counts = masks.groupBy("scenario").agg(F.sum(F.bit_count("val")).alias("reachable_pairs"))
    return scenarios.join(counts, "scenario", "left").na.fill(0, ["reachable_pairs"])


def reach_fraction(graph: Graph, scenarios: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Adds ``fraction``: reachable pairs over pairs of terminals still present (0 when a side is empty)."""
    counts = reachable_pair_counts(graph, scenarios, removed)
    live = live_seeds(graph.spread(graph.terminals.join(graph.vertices.select("v"), "v", "left_semi"), scenarios), removed)
    sizes = live.groupBy("scenario").agg(
        F.count_if(F.col("role") == "S").alias("n_s"), F.count_if(F.col("role") == "M").alias("n_m")
    )
    possible = F.col("n_s") * F.col("n_m")
    fraction = F.when(possible > 0, F.col("reachable_pairs") / possible).otherwise(0.0)
    return counts.join(sizes, "scenario", "left").select("scenario", "reachable_pairs", F.coalesce(fraction, F.lit(0.0)).alias("fraction"))


def unpack(masks: DataFrame, words: DataFrame) -> DataFrame:
    """Mask rows -> one row (…, s) per set bit."""
    bits = masks.withColumn("bit", F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), b -> shiftright(val, b) & 1 = 1)")))
    return bits.join(words, ["word", "bit"]).drop("word", "bit", "val")


def reach_relation(graph: Graph, scenarios: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(scenario, s, m), absent row = unreachable."""
    words = source_words(graph)
    masks = reach_masks(graph, scenarios, removed, words).join(hint_small(settle(graph.targets)), "v")
    return unpack(masks, words).select("scenario", "s", F.col("v").alias("m"))


def distances(graph: Graph, scenarios: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(scenario, s, v, dist): hops from every source to every vertex it reaches."""
    seeds = graph.spread(graph.sources.select(F.col("v").alias("s"), "v", F.lit(0).alias("val")), scenarios)
    cap, on = removal_cap(removed)
    found = propagate(
        live_seeds(seeds, removed), graph.arcs(), F.min, lambda val, cap: F.when(cap.isNull(), val + 1),
        ["scenario", "s"], cap, on,
    )
    return found.withColumnRenamed("val", "dist")


def cut_off(graph: Graph, scenarios: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(scenario, v) still present and without a path from any live source."""
    seeds = live_seeds(graph.spread(graph.sources.select("v", F.lit(1).alias("val")), scenarios), removed)
    cap, on = removal_cap(removed)
    reached = propagate(seeds, graph.arcs(), F.max, lambda val, cap: F.when(cap.isNull(), val), ["scenario"], cap, on)
    present = live_seeds(graph.spread(graph.vertices.select("v"), scenarios), removed)
    return present.join(reached, ["scenario", "v"], "left_anti").select("scenario", "v")


def source_labels(graph: Graph, scenarios: DataFrame, removed: DataFrame) -> DataFrame:
    """(scenario, s, v, val): the label of ``disconnection`` per source; s still reaches v after batch k when val > k."""
    caps = removed.select("scenario", F.col("v").alias("dst"), F.col("batch").alias("cap"))
    return _labels(graph, scenarios, removed, caps, ["scenario", "s"], True)


def disconnection(graph: Graph, scenarios: DataFrame, removed: DataFrame, per_source: DataFrame | None = None) -> DataFrame:
    """Whole removal orders at once. ``removed`` is (scenario, v, batch).

    The label of v is the largest, over paths from a source, of the earliest removal on the path; v keeps a source
    through batch k exactly when label > k. Returns (scenario, v, removed_at, silenced_at); null where it never happens,
    silenced_at 0 for vertices that never had a source. With ``per_source`` labels at hand no fixpoint is run.
    """
    if per_source is not None:
        return _label_table(graph, scenarios, removed, per_source.groupBy("scenario", "v").agg(F.max("val").alias("val")))
    caps = removed.select("scenario", F.col("v").alias("dst"), F.col("batch").alias("cap"))
    return _label_table(graph, scenarios, removed, _labels(graph, scenarios, removed, caps, ["scenario"], False))


def _labels(graph, scenarios, removed, caps, keys, per_source):
    columns = [F.col("v").alias("s"), "v"] if per_source else ["v"]
    seeds = graph.spread(graph.sources.select(*columns), scenarios)
    seeds = seeds.join(removed.select("scenario", "v", "batch"), ["scenario", "v"], "left")
    seeds = seeds.select(*keys, "v", F.coalesce("batch", F.lit(NEVER)).alias("val"))
    send = lambda val, cap: F.least(val, F.coalesce(cap, F.lit(NEVER)))
    return propagate(seeds, graph.arcs(), F.max, send, keys, caps, ["scenario", "dst"])


def _label_table(graph, scenarios, removed, labels):
    everyone = graph.spread(graph.vertices.select("v"), scenarios)
    joined = everyone.join(removed.select("scenario", "v", F.col("batch").alias("removed_at")), ["scenario", "v"], "left").join(
        labels, ["scenario", "v"], "left"
    )
    label = F.coalesce("val", F.lit(0))
    silenced = F.when(label < F.coalesce("removed_at", F.lit(NEVER)), label)
    return joined.select("scenario", "v", "removed_at", silenced.alias("silenced_at"))


def avalanches(timeline: DataFrame, batches: DataFrame) -> DataFrame:
    """(scenario, batch, newly_cut, silenced, removed): per-batch counts of ``disconnection`` rows.

    ``newly_cut`` counts vertices that lose their last source in a batch while present (null at batch 0); ``silenced``
    and ``removed`` are running totals, where a silenced vertex leaves the silenced total when it is removed.
    """
    moves = timeline.select(
        "scenario",
        F.explode(
            F.array(
                F.struct(F.col("silenced_at").alias("batch"), F.lit(1).alias("cut"), F.lit(1).alias("silent"), F.lit(0).alias("gone")),
                F.struct(
                    F.col("removed_at").alias("batch"), F.lit(0).alias("cut"),
                    F.when(F.col("silenced_at").isNotNull(), -1).otherwise(0).alias("silent"), F.lit(1).alias("gone"),
                ),
            )
        ).alias("e"),
    ).select("scenario", "e.*").filter("batch is not null")
    sums = moves.groupBy("scenario", "batch").agg(F.sum("cut").alias("cut"), F.sum("silent").alias("silent"), F.sum("gone").alias("gone"))
    grid = replicate(batches.select("batch"), timeline.select("scenario").distinct())
    upto = Window.partitionBy("scenario").orderBy("batch")
    filled = grid.join(sums, ["scenario", "batch"], "left").na.fill(0, ["cut", "silent", "gone"])
    return filled.select(
        "scenario", "batch", F.when(F.col("batch") > 0, F.col("cut")).alias("newly_cut"),
        F.sum("silent").over(upto).alias("silenced"), F.sum("gone").over(upto).alias("removed"),
    )


def pair_curve(
    graph: Graph, scenarios: DataFrame, batches: DataFrame, removed: DataFrame | None = None,
    removed_edges: DataFrame | None = None, per_source: DataFrame | None = None,
) -> DataFrame:
    """(scenario, batch, reachable_pairs) for a whole vertex order (scenario, v, batch) or edge order (scenario, src, dst, batch)."""
    if removed_edges is not None:
        seeds = graph.spread(graph.sources.select(F.col("v").alias("s"), "v", F.lit(NEVER).alias("val")), scenarios)
        caps = removed_edges.select("scenario", "src", "dst", F.col("batch").alias("cap"))
        send = lambda val, cap: F.least(val, F.coalesce(cap, F.lit(NEVER)))
        labels = propagate(seeds, graph.arcs(), F.max, send, ["scenario", "s"], caps, ["scenario", "src", "dst"])
    else:
        labels = source_labels(graph, scenarios, removed) if per_source is None else per_source
    ends = labels.join(hint_small(settle(graph.targets)), "v")
    lost = ends.groupBy("scenario", F.col("val").alias("batch")).agg(F.count(F.lit(1)).alias("lost"))
    total = ends.groupBy("scenario").agg(F.count(F.lit(1)).alias("total"))
    grid = replicate(batches.select("batch"), scenarios)
    upto = Window.partitionBy("scenario").orderBy("batch")
    return (
        grid.join(lost, ["scenario", "batch"], "left").join(total, "scenario", "left")
        .select("scenario", "batch", (F.coalesce("total", F.lit(0)) - F.coalesce(F.sum("lost").over(upto), F.lit(0))).alias("reachable_pairs"))
    )
