"""Edge-disjoint flow from all sources to all targets, for many removal scenarios at once.

Every edge carries one unit; terminals are joined to a virtual source and sink without limit. Layered graphs (sources to
middle, middle to targets, sources to targets) have a closed form that is one aggregation for all scenarios and batches;
other graphs advance by augmentation rounds in which tokens walk back along the shortest residual levels.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraygraph.operators.graph_build import Graph
from fraygraph.operators.ranking import ONE_TASK_ROWS, number_within
from fraygraph.operators.reach import WORD, live_seeds
from fraygraph.session import BROADCAST_ROWS, checkpoint_folder, hint_small, replicate, settle, store

# Tokens that start in a round for each unit that the sources could still send: some meet at a vertex and stop.
SPARE = 32
CHANCES = 1 << 30


def edge_roles(graph: Graph) -> DataFrame:
    """Edges with the roles of both ends (S, M or I)."""
    roles = hint_small(settle(graph.terminals.select("v", "role")))
    ends = graph.edges.select("src", "dst")
    ends = ends.join(roles.select(F.col("v").alias("src"), F.col("role").alias("src_role")), "src", "left")
    ends = ends.join(roles.select(F.col("v").alias("dst"), F.col("role").alias("dst_role")), "dst", "left")
    return ends.na.fill("I", ["src_role", "dst_role"])


def is_layered(graph: Graph) -> bool:
    """True when every edge goes S->I, I->M or S->M; found once per graph."""
    if graph.layers is None:
        kind = F.concat("src_role", "dst_role")
        graph.layers = edge_roles(graph).filter(~kind.isin("SI", "IM", "SM")).isEmpty()
    return graph.layers


def use_layers(graph: Graph, layered: bool | None) -> bool:
    """Whether to take the closed form; a caller who asks for it on another graph gets an error, not a wrong flow."""
    graph.require_disjoint_terminals()
    if layered and not is_layered(graph):
        raise ValueError("the closed form needs a graph whose edges all go S->I, I->M or S->M")
    return is_layered(graph) if layered is None else layered


def layered_curve(graph: Graph, scenarios: DataFrame, batches: DataFrame, removed: DataFrame | None = None, removed_edges: DataFrame | None = None) -> DataFrame:
    """(scenario, batch, flow) on a layered graph, from (scenario, v, batch) and/or (scenario, src, dst, batch) removals.

    A middle vertex passes min(live inputs, live outputs). Only the middle vertices a removal touches are looked at:
    each edge death is an event at its middle vertex, events are counted per batch before the shuffle, and running
    sums per (scenario, middle vertex) turn them into drops. No scenario ever copies the graph.
    """
    edges = settle(
        edge_roles(graph).select(
            "src", "dst",
            F.when(F.col("src_role") == "I", F.col("src")).when(F.col("dst_role") == "I", F.col("dst")).alias("mid"),
            F.when(F.col("src_role") == "I", "out").when(F.col("dst_role") == "I", "in").otherwise("direct").alias("kind"),
        )
    )
    base = edges.filter("mid is not null").groupBy("mid").agg(
        F.count_if(F.col("kind") == "in").alias("ins"), F.count_if(F.col("kind") == "out").alias("outs")
    )
    base = settle(base)
    hops = base.agg(F.coalesce(F.sum(F.least("ins", "outs")), F.lit(0)).alias("hops"))
    direct = edges.filter("kind = 'direct'").agg(F.count(F.lit(1)).alias("direct"))
    intact = hops.first()["hops"] + direct.first()["direct"]

    deaths = None
    if removed is not None:
        gone = removed.select("scenario", "v", "batch")
        for end in ("src", "dst"):
            hit = gone.join(edges, F.col("v") == F.col(end)).select("scenario", "src", "dst", "mid", "kind", "batch")
            deaths = hit if deaths is None else deaths.unionByName(hit)
    if removed_edges is not None:
        hit = removed_edges.select("scenario", "src", "dst", "batch").join(edges, ["src", "dst"])
        hit = hit.select("scenario", "src", "dst", "mid", "kind", "batch")
        deaths = hit if deaths is None else deaths.unionByName(hit)
    if deaths is None:
        grid = replicate(batches.select("batch"), scenarios)
        return grid.withColumn("flow", F.lit(intact).cast("long"))
    # An edge dies once, with its first end; a dead middle vertex takes all its edges along.
    deaths = deaths.groupBy("scenario", "src", "dst", "mid", "kind").agg(F.min("batch").alias("batch"))
    direct_drop = deaths.filter("kind = 'direct'").groupBy("scenario", "batch").agg(F.count(F.lit(1)).alias("drop"))
    events = deaths.filter("kind <> 'direct'").groupBy("scenario", "mid", "batch").agg(
        F.count_if(F.col("kind") == "in").alias("i"), F.count_if(F.col("kind") == "out").alias("o")
    )
    past = Window.partitionBy("scenario", "mid").orderBy("batch")
    run = events.join(hint_small(base), "mid").select(
        "scenario", "batch", "mid",
        F.least(F.col("ins") - F.sum("i").over(past), F.col("outs") - F.sum("o").over(past)).alias("now"),
        F.least("ins", "outs").alias("start"),
    )
    drops = run.select("scenario", "batch", (F.coalesce(F.lag("now").over(past), F.col("start")) - F.col("now")).alias("drop"))
    drops = drops.unionByName(direct_drop).groupBy("scenario", "batch").agg(F.sum("drop").alias("drop"))
    grid = replicate(batches.select("batch"), scenarios)
    upto = Window.partitionBy("scenario").orderBy("batch")
    return grid.join(drops, ["scenario", "batch"], "left").select(
        "scenario", "batch", (F.lit(intact) - F.coalesce(F.sum("drop").over(upto), F.lit(0))).cast("long").alias("flow")
    )


@dataclass
class Flow:
    """value: (scenario, flow); used: (scenario, src, dst) edges that carry a unit; rounds of augmentation it took."""

    value: DataFrame
    used: DataFrame
    rounds: int


@dataclass
class Base:
    """One flow of the whole graph, from which scenarios start: its value and its edges (path, src, dst) by unit path."""

    value: int
    paths: DataFrame


@dataclass
class _Residual:
    """What is open to augmentation, for 63 scenarios to a mask: ``arcs`` (src, dst, busy) with the base flow and ``flips`` (word, src,
    dst, busy, flip), the scenarios in which an edge differs from it, and what is gone. A scenario costs bits for its changes only,
    never a copy of the flow."""

    arcs: DataFrame
    busy: DataFrame | None
    flips: DataFrame
    removed: DataFrame | None
    dead: DataFrame | None

    def ahead(self, front: DataFrame) -> DataFrame:
        """``front`` (word, src or dst, mask, ...) with the edges beside it that carry no unit; ``mask`` keeps the scenarios where that is so."""
        end = "src" if "src" in front.columns else "dst"
        rows = front.join(self.arcs, end).join(self.flips.drop("busy"), ["word", "src", "dst"], "left")
        flip = F.coalesce("flip", F.lit(0))
        rows = rows.withColumn("mask", F.col("mask").bitwiseAND(F.when(F.col("busy"), flip).otherwise(F.bitwise_not(flip)))).drop("flip")
        return (rows if self.dead is None else _without(rows, self.dead, ["word", "src", "dst"])).filter("mask <> 0")

    def back(self, front: DataFrame) -> DataFrame:
        """``front`` with the edges beside it that carry a unit, to be taken against their direction."""
        end = "src" if "src" in front.columns else "dst"
        rows = front.join(self.flips.filter("not busy"), ["word", end]).withColumn("mask", F.col("mask").bitwiseAND(F.col("flip"))).drop("flip")
        if self.busy is not None:
            kept = front.join(self.busy.withColumn("busy", F.lit(True)), end)
            given = self.flips.filter("busy").select("word", "src", "dst", F.col("flip").alias("gone"))
            rows = rows.unionByName(_without(kept, given, ["word", "src", "dst"]))
        return rows.filter("mask <> 0")


def _without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose ``mask`` lacks the scenarios of ``gone`` (on, gone)."""
    rows = rows.join(gone, on, "left")
    return rows.withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("gone", F.lit(0))))).drop("gone")


def _words(scenarios: DataFrame) -> DataFrame:
    """(scenario, word, bit): scenarios packed 63 to a mask. A null one has no bit: nothing is joined to it."""
    names = settle(scenarios.select("scenario").filter("scenario is not null").distinct())
    numbered = number_within(names.withColumn("_all", F.lit(0)), ["_all"], ["scenario"], group_rows=names.count())
    index = F.col("n") - 1
    places = (F.floor(index / WORD).cast("int").alias("word"), (index % WORD).cast("int").alias("bit"))
    return hint_small(settle(numbered.select("scenario", *places)))


def _packed(rows: DataFrame, words: DataFrame, on: list[str], name: str) -> DataFrame:
    """(scenario, on) -> (word, on, name), ``name`` the mask of the scenarios."""
    return rows.join(words, "scenario").groupBy("word", *on).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias(name))


def _bits(rows: DataFrame, name: str = "mask") -> DataFrame:
    """One row with ``bit`` per scenario of the mask ``name``."""
    return rows.withColumn("bit", F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), b -> shiftright({name}, b) & 1 = 1)"))).drop(name)


def _levels(residual: _Residual, seeds, targets) -> list[DataFrame]:
    """(word, v, mask) by level over residual arcs; a scenario stops at its first level with a target (none: runs out)."""
    table, levels = settle(seeds.select("word", "v", F.col("mask").alias("seen"), "mask")), []
    while True:
        front = table.filter("mask <> 0").select("word", "v", "mask")
        levels.append(front)
        if targets is not None and len(levels) > 1:
            hit = front.join(targets, "v", "left_semi").groupBy("word").agg(F.bit_or("mask").alias("gone"))
            front = _without(front, hit, ["word"]).filter("mask <> 0")
        rows = front.count()
        if not rows:
            return levels
        front = F.broadcast(front) if rows <= BROADCAST_ROWS else front
        ahead = residual.ahead(front.withColumnRenamed("v", "src")).select("word", F.col("dst").alias("v"), "mask")
        back = residual.back(front.withColumnRenamed("v", "dst")).select("word", F.col("src").alias("v"), "mask")
        step = ahead.unionByName(back)
        if residual.removed is not None:
            step = _without(step, residual.removed, ["word", "v"])
        both = table.select("word", "v", "seen", F.lit(0).cast("long").alias("mask"))
        both = both.unionByName(step.select("word", "v", F.lit(0).cast("long").alias("seen"), "mask"))
        both = both.groupBy("word", "v").agg(F.bit_or("seen").alias("seen"), F.bit_or("mask").alias("mask"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not("seen"))
        table = settle(both.select("word", "v", F.col("seen").bitwiseOR(F.col("mask")).alias("seen"), fresh.alias("mask")))


def _entering(spots, residual: _Residual, reached) -> DataFrame:
    """Residual arcs u->v into ``spots`` (word, v, level, mask) from one level lower: (word, bit, v, level, u, src, dst, busy)."""
    names = ("src", "dst", "busy", "mask")
    ahead = residual.ahead(spots.withColumn("dst", F.col("v"))).select("word", "v", "level", F.col("src").alias("u"), *names)
    back = residual.back(spots.withColumn("src", F.col("v"))).select("word", "v", "level", F.col("dst").alias("u"), *names)
    lower = reached.select("word", F.col("v").alias("u"), (F.col("level") + 1).alias("level"), F.col("mask").alias("under"))
    rows = ahead.unionByName(back).join(lower, ["word", "u", "level"])
    return _bits(rows.withColumn("mask", F.col("mask").bitwiseAND(F.col("under"))).drop("under"))


def _useful(starts: DataFrame, residual: _Residual, sources: DataFrame, order) -> DataFrame:
    """``starts`` thinned by chance to ``SPARE`` times what can leave the sources in this round, one a scenario at least.

    The others would walk for nothing: no more tokens arrive than residual arcs leave the sources. What a round leaves, a later one
    takes, as rounds go on until no target is levelled.
    """
    leaving = residual.ahead(sources.withColumnRenamed("v", "src")).select("word", "mask")
    leaving = _bits(leaving.unionByName(residual.back(sources.withColumnRenamed("v", "dst")).select("word", "mask")))
    supply = leaving.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("supply"))
    starts = store(starts.withColumn("chance", F.pmod(order, F.lit(CHANCES)) / CHANCES))
    sums = starts.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("total"), F.min("chance").alias("first"))
    bound = sums.join(supply, ["word", "bit"]).select("word", "bit", F.greatest("first", SPARE * F.col("supply") / F.col("total")).alias("bound"))
    return starts.join(bound, ["word", "bit"]).filter("chance <= bound").drop("chance", "bound")


def unit_paths(graph: Graph, flow: Flow) -> Base:
    """The flow of one scenario cut into unit paths.

    At every vertex the k-th unit that enters goes on as the k-th that leaves; units without a partner begin or end there.
    The first edge of every path is found by pointer jumping, so a path of n edges takes log n joins. Units that go round in
    a circle carry nothing from a source to a target and are left out.
    """
    edges = settle(flow.used.select("src", "dst"))
    rows = edges.count()
    enter = number_within(edges, ["dst"], ["src"], "k", group_rows=rows)
    leave = number_within(edges, ["src"], ["dst"], "k", group_rows=rows)
    before = enter.select(F.col("dst").alias("v"), "k", F.struct("src", "dst").alias("before"))
    state = leave.withColumn("v", F.col("src")).join(before, ["v", "k"], "left")
    own = F.struct("src", "dst")
    state = store(state.select(own.alias("edge"), F.coalesce("before", own).alias("up"), F.col("before").isNull().alias("done")))
    for _ in range(max(1, rows).bit_length()):
        if state.filter("not done").isEmpty():
            break
        above = state.select(F.col("edge").alias("up"), F.col("up").alias("further"), F.col("done").alias("ends"))
        state = store(state.join(above, "up").select("edge", F.col("further").alias("up"), (F.col("done") | F.col("ends")).alias("done")))
    paths = settle(state.filter("done").select(F.col("up").alias("path"), "edge.src", "edge.dst"))
    return Base(flow.value.first()["flow"], paths)


def _cancelled(base: Base, removed: DataFrame | None, dead: DataFrame | None) -> DataFrame:
    """(scenario, src, dst): the edges of all unit paths that a scenario's removals interrupt, given free."""
    hit = None
    if removed is not None:
        places = base.paths.select(F.explode(F.array("src", "dst")).alias("v"), "path").distinct()
        hit = removed.select("scenario", "v").join(places, "v").select("scenario", "path")
    if dead is not None:
        more = dead.select("scenario", "src", "dst").join(base.paths, ["src", "dst"]).select("scenario", "path")
        hit = more if hit is None else hit.unionByName(more)
    return hit.distinct().join(base.paths, "path").select("scenario", "src", "dst")


def most_arcs(edges: DataFrame) -> int:
    """A bound on the edges beside one vertex: all of them, or the counted most where one task could not order all."""
    rows = edges.count()
    if rows <= ONE_TASK_ROWS:
        return rows
    sizes = edges.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.max("size").alias("most")).first()["most"]


def max_flow(
    graph: Graph, scenarios: DataFrame, removed: DataFrame | None = None, removed_edges: DataFrame | None = None,
    base: Base | None = None, start: DataFrame | None = None,
) -> Flow:
    """Flow of any graph under vertex removals (scenario, v) and edge removals (scenario, src, dst).

    State is the set of edges per scenario that differ from where it started, never scenario x edges, with 63 scenarios to a mask.
    Each round levels the residual graph from the sources, all scenarios of a mask at once, starts tokens at residual arcs entering
    a nearest target, and walks them back level by level, pairing the tokens at a vertex with its entering arcs, these in an order by
    chance, by number; surplus tokens stop. Tokens that arrive are edge-disjoint shortest paths. A scenario ends when no target is
    levelled.

    With ``base`` every scenario starts from one flow of the whole graph: only the unit paths through what it lacks are given
    up, and only those are augmented again. ``start`` (scenario, src, dst) are units that each scenario already carries.
    """
    arcs = graph.edges.select("src", "dst")
    most = most_arcs(arcs)  # a vertex has at most this many entering arcs, and so many tokens, per scenario
    words = _words(scenarios)
    removed = settle(removed.select("scenario", "v").distinct()) if removed is not None else None
    dead = settle(removed_edges.select("scenario", "src", "dst").distinct()) if removed_edges is not None else None
    targets = hint_small(settle(graph.targets))
    seeds = settle(_packed(live_seeds(graph.spread(graph.sources, scenarios), removed), words, ["v"], "mask"))
    if base is None:
        arcs, busy = arcs.withColumn("busy", F.lit(False)), None
        begin = scenarios.select("scenario").limit(0).join(graph.edges.select("src", "dst").limit(0)) if start is None else start
    else:
        busy = base.paths.select("src", "dst")
        arcs = arcs.join(busy.withColumn("busy", F.lit(True)), ["src", "dst"], "left").na.fill(False, ["busy"])
        begin = _cancelled(base, removed, dead)
    flips = _packed(begin, words, ["src", "dst"], "flip").select("word", "src", "dst", F.lit(base is not None).alias("busy"), "flip")
    residual = _Residual(
        hint_small(store(arcs)), busy, hint_small(store(flips)),
        hint_small(settle(_packed(removed, words, ["v"], "gone"))) if removed is not None else None,
        hint_small(settle(_packed(dead, words, ["src", "dst"], "gone"))) if dead is not None else None,
    )
    active, rounds = seeds, 0
    step = F.struct("src", "dst", "busy")
    while True:
        rounds += 1
        levels = _levels(residual, active, targets)
        reached = reduce(DataFrame.unionByName, [rows.withColumn("level", F.lit(k)) for k, rows in enumerate(levels)])
        reached = hint_small(reached)
        hits = reached.filter("level > 0").join(targets, "v", "left_semi")
        if hits.isEmpty():
            break
        by_chance = F.xxhash64("word", "bit", "u", "v", F.lit(rounds))
        starts = _useful(_entering(hint_small(hits), residual, reached), residual, hint_small(levels[0]), by_chance)
        tokens = store(
            starts.select(
                "word", "bit", F.struct("src", "dst").alias("token"), F.col("u").alias("v"), (F.col("level") - 1).alias("level"),
                F.array(step).alias("path"),
            )
        )
        for _ in range(len(levels) - 2):
            moving = tokens.filter("level > 0")
            spots = moving.groupBy("word", "v", "level").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
            doors = _entering(hint_small(spots), residual, reached).drop("level").withColumn("order", by_chance)
            doors = number_within(doors, ["word", "bit", "v"], ["order", "src", "dst"], "n", group_rows=most)
            queue = number_within(moving, ["word", "bit", "v"], ["token"], "n", group_rows=most)
            moved = queue.join(doors, ["word", "bit", "v", "n"]).select(
                "word", "bit", "token", F.col("u").alias("v"), (F.col("level") - 1).alias("level"),
                F.concat("path", F.array(step)).alias("path"),
            )
            tokens = store(moved.unionByName(tokens.filter("level = 0")))
        one = F.expr("shiftleft(1L, bit)")
        turned = tokens.select("word", one.alias("flip"), F.explode("path").alias("e")).select("word", "e.src", "e.dst", "e.busy", "flip")
        # An edge flips at most once in a round: back to where it started, or away from it.
        turned = residual.flips.unionByName(turned).groupBy("word", "src", "dst", "busy").agg(F.bit_xor("flip").alias("flip"))
        residual.flips = hint_small(store(turned.filter("flip <> 0")))
        live = tokens.groupBy("word").agg(F.bit_or(one).alias("live"))
        active = seeds.join(live, "word").select("word", "v", F.col("mask").bitwiseAND(F.col("live")).alias("mask")).filter("mask <> 0")
    value = _net_out(scenarios, residual.flips, words, targets, base)
    return Flow(value, _carried(scenarios, residual.flips, words, base), rounds)


def _net_out(scenarios, flips, words, targets, base) -> DataFrame:
    """Units entering targets minus units leaving them, by scenario (source-to-source units cancel the same way)."""
    sign = F.when(F.col("busy"), -1).otherwise(1)
    into = flips.join(targets.withColumnRenamed("v", "dst"), "dst", "left_semi").select("word", "flip", sign.alias("unit"))
    out = flips.join(targets.withColumnRenamed("v", "src"), "src", "left_semi").select("word", "flip", (-sign).alias("unit"))
    sums = _bits(into.unionByName(out), "flip").groupBy("word", "bit").agg(F.sum("unit").alias("flow"))
    whole = F.lit(base.value if base else 0) + F.coalesce("flow", F.lit(0))
    sums = sums.join(words, ["word", "bit"]).select("scenario", "flow")
    return scenarios.join(sums, "scenario", "left").select("scenario", whole.cast("long").alias("flow"))


def _carried(scenarios, flips, words, base) -> DataFrame:
    """(scenario, src, dst) of all edges that carry a unit; with a base flow, its copy per scenario is made only if asked for."""
    changes = _bits(flips, "flip").join(words, ["word", "bit"])
    extra = changes.filter("not busy").select("scenario", "src", "dst")
    if base is None:
        return extra
    kept = replicate(base.paths.select("src", "dst"), scenarios.select("scenario"))
    return kept.join(changes.filter("busy"), ["scenario", "src", "dst"], "left_anti").unionByName(extra)


def flow_values(graph: Graph, scenarios: DataFrame, removed: DataFrame | None = None, layered: bool | None = None) -> DataFrame:
    """(scenario, flow) under vertex removals; picks the closed form when the graph is layered."""
    layered = use_layers(graph, layered)
    if not layered:
        return max_flow(graph, scenarios, removed).value
    one = graph.spark.range(1, 2).select(F.col("id").cast("int").alias("batch"))
    gone = removed.select("scenario", "v").distinct().withColumn("batch", F.lit(1)) if removed is not None else None
    return layered_curve(graph, scenarios, one, gone).select("scenario", "flow")


def flow_curve(
    graph: Graph, scenarios: DataFrame, batches: DataFrame, removed: DataFrame | None = None,
    removed_edges: DataFrame | None = None, layered: bool | None = None,
) -> DataFrame:
    """(scenario, batch, flow) along removal orders (scenario, v, batch) or (scenario, src, dst, batch)."""
    layered = use_layers(graph, layered)
    if layered:
        return layered_curve(graph, scenarios, batches, removed, removed_edges)
    return general_curve(graph, scenarios, batches, removed, removed_edges)


def general_curve(graph: Graph, scenarios: DataFrame, batches: DataFrame, removed: DataFrame | None, removed_edges: DataFrame | None) -> DataFrame:
    """(scenario, batch, flow) on any graph, all runs at once, from the last batch back to the intact graph.

    What a smaller graph carries stays possible when a batch is put back, so every step only adds the units that the batch
    makes possible: the augmentations of a whole run add up to those of one flow.
    """
    folder = f"{checkpoint_folder(graph.spark)}/curve-{uuid.uuid4().hex}"
    scenarios = settle(scenarios.select("scenario"))
    steps = sorted((r["batch"] for r in batches.select("batch").distinct().collect()), reverse=True)  # grows with log(n)
    carried, paths = None, []

    def gone(order):
        return None if order is None else order.filter(F.col("batch") <= at)

    for at in steps:
        found = max_flow(graph, scenarios, gone(removed), gone(removed_edges), start=carried)
        carried = found.used
        paths.append(f"{folder}/{at}")
        found.value.withColumn("batch", F.lit(at).cast(batches.schema["batch"].dataType)).write.parquet(paths[-1])
    kinds = T.StructType([T.StructField("scenario", scenarios.schema["scenario"].dataType), T.StructField("flow", T.LongType()), batches.schema["batch"]])
    return graph.spark.read.schema(kinds).parquet(*paths).select("scenario", "batch", "flow")


def min_cut(graph: Graph, flow: Flow, scenarios: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(scenario, src, dst): live edges leaving the set that the sources still reach in the final residual graph."""
    arcs, words = hint_small(settle(graph.edges.select("src", "dst"))), _words(scenarios)
    seeds = _packed(live_seeds(graph.spread(graph.sources, scenarios), removed), words, ["v"], "mask")
    flips = _packed(flow.used, words, ["src", "dst"], "flip").withColumn("busy", F.lit(False))
    gone = settle(_packed(removed, words, ["v"], "gone")) if removed is not None else None
    residual = _Residual(arcs.withColumn("busy", F.lit(False)), None, hint_small(store(flips)), gone, None)
    reached = reduce(DataFrame.unionByName, _levels(residual, seeds, None))
    reached = _bits(reached).join(words, ["word", "bit"]).select("scenario", "v")
    leaving = reached.select("scenario", F.col("v").alias("src")).join(arcs, "src")
    leaving = leaving.join(reached.withColumnRenamed("v", "dst"), ["scenario", "dst"], "left_anti")
    if removed is not None:
        leaving = live_seeds(leaving.withColumn("v", F.col("dst")), removed)
    return leaving.select("scenario", "src", "dst")


def route_load(flow: Flow) -> DataFrame:
    """(scenario, v, load): units through every vertex, counted on entering edges (leaving ones for pure sources)."""
    into = flow.used.groupBy("scenario", F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("units"))
    out = flow.used.groupBy("scenario", F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("units"))
    return into.unionByName(out).groupBy("scenario", "v").agg(F.max("units").alias("load"))
