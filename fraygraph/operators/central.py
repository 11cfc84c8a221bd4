"""Centralities as DataFrame supersteps: PageRank, (restricted) betweenness, coreness, score tables."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.operators.graph_build import Graph, degrees
from fraygraph.operators.ranking import random_key, unit_uniform, with_percentile
from fraygraph.operators.reach import MERGE_SHARE, MERGE_STEPS, intact_scenario, live_seeds
from fraygraph.session import dealt, held, hint_small, settle, store


def pagerank(
    graph: Graph, scenarios: DataFrame | None = None, removed: DataFrame | None = None,
    damping: float = 0.85, iterations: int | None = None, tolerance: float = 1e-9, most: int = 1000,
) -> DataFrame:
    """(scenario, v, score): weighted, directed; dangling mass and restarts spread evenly over present vertices.

    The mass of dangling vertices and the vertex count are per-scenario sums, one row each, joined back broadcast-sized.
    Scores sum to 1 per scenario. It stops when no scenario moves more than ``tolerance`` in total; not getting there in
    ``most`` steps is an error. With ``iterations`` exactly so many steps are taken.

    As dangling mass goes where restarts go, the scores are in proportion to what walks from everywhere bring along, and these are
    summed by length: each step reads only the vertices that the last one reached. Where walks go round, only what lies on circles or
    behind them is read again.
    """
    scenarios = intact_scenario(graph) if scenarios is None else scenarios
    present = settle(live_seeds(graph.spread(graph.vertices.select("v"), scenarios), removed))
    arcs = graph.edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    # Two exchanges of the arcs: by their ends, and by their starts, where the shares are made.
    live = present.select("scenario", F.col("v").alias("dst")).distinct().join(hint_small(arcs), "dst")
    live = live.join(present.select("scenario", F.col("v").alias("src")), ["scenario", "src"])
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("scenario", "src"))
    links = store(live.select("scenario", "src", "dst", share.alias("share")))
    counts = present.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    sinks = links.select("scenario", F.col("src").alias("v"), F.lit(False).alias("sink")).distinct()
    base = settle(present.join(sinks, ["scenario", "v"], "left").na.fill(True, ["sink"]).join(counts, "scenario"))
    linked = hint_small(links)
    if linked is links:
        linked, _ = held(links, ["scenario", "src"])
    state = base.withColumn("score", F.lit(1.0) / F.col("n"))
    if iterations is None:
        state = _walks(state, linked, damping, tolerance, most)
    for _ in range(iterations or 0):
        given = state.select("scenario", F.col("v").alias("src"), "score").join(linked, ["scenario", "src"])
        given = given.select("scenario", F.col("dst").alias("v"), (F.col("score") * F.col("share")).alias("in"))
        stuck = state.groupBy("scenario").agg(F.sum(F.when(F.col("sink"), F.col("score")).otherwise(0.0)).alias("stuck"))
        gathered = given.groupBy("scenario", "v").agg(F.sum("in").alias("in"))
        nxt = state.join(gathered, ["scenario", "v"], "left").join(stuck, "scenario")
        score = (F.lit(1 - damping) + F.lit(damping) * F.col("stuck")) / F.col("n") + F.lit(damping) * F.coalesce("in", F.lit(0.0))
        state = settle(nxt.select("scenario", "v", "n", "sink", score.alias("score")))
    linked.unpersist()
    return state.select("scenario", "v", "score")


def _walks(state: DataFrame, links: DataFrame, damping: float, tolerance: float, most: int) -> DataFrame:
    """``state`` with scores from the damped sums over the walks of length 0, 1, 2, ... to v.

    Lengths are added while each reaches fewer vertices than the one before; once two reach the same, all longer ones do, and the links of
    these vertices are all that is read until the walks still to come bring no scenario more than ``tolerance``. The sums y solve
    y = 1/n + damping * (what the links bring of y); times (1 - damping) / (1 - damping * y of the dangling) they are the scores.
    """
    on = ["scenario", "v"]
    places = state.select(*on)
    here, waves, rows = state.select(*on, "score"), [], state.count()
    brings = F.sum(F.lit(damping) * F.col("score") * F.col("share")).alias("score")
    still = damping / (1 - damping)

    def going(reached: DataFrame) -> float:
        """What the walks still to come bring at most to a scenario."""
        return (reached.groupBy("scenario").agg(F.sum("score").alias("mass")).agg(F.max("mass")).first()[0] or 0.0) * still

    while rows:
        sent = here.select("scenario", F.col("v").alias("src"), "score").join(links, ["scenario", "src"])
        wave = settle(sent.groupBy("scenario", F.col("dst").alias("v")).agg(brings))
        here, before = settle(places.join(wave, on)), rows
        rows = here.count()
        waves.append(wave)
        if rows == before or rows and going(here) <= tolerance:
            break
    if rows and going(here) > tolerance:
        # Vertices listed more than once send as often.
        round_ = settle(here.groupBy(*on).agg(F.count(F.lit(1)).alias("times"), F.first("score").alias("score")).withColumn("brought", F.lit(0.0)))
        near = links.join(round_.select("scenario", F.col("v").alias("src")), ["scenario", "src"], "left_semi")
        own = store(near)
        near = hint_small(own)
        if near is own:
            near, _ = held(own, ["scenario", "src"])
        for step in range(1, most + 1):
            sent = round_.select("scenario", F.col("v").alias("src"), (F.col("score") * F.col("times")).alias("score")).join(near, ["scenario", "src"])
            wave = sent.groupBy("scenario", F.col("dst").alias("v")).agg(brings)
            round_ = settle(round_.drop("score").join(wave, on).select(*on, "times", "score", (F.col("brought") + F.col("score")).alias("brought")))
            if going(round_.select("scenario", (F.col("score") * F.col("times")).alias("score"))) <= tolerance:
                break
        else:
            raise RuntimeError(f"walks still bring more than {tolerance} after {most} steps")
        near.unpersist()
        waves.append(round_.select(*on, F.col("brought").alias("score")))
    if not waves:
        return state
    brought = reduce(DataFrame.unionByName, waves).groupBy(*on).agg(F.sum("score").alias("brought"))
    sums = state.join(brought, on, "left").withColumn("score", F.col("score") + F.coalesce("brought", F.lit(0.0))).drop("brought")
    sums = settle(sums)
    stuck = sums.groupBy("scenario").agg(F.sum(F.when(F.col("sink"), F.col("score")).otherwise(0.0)).alias("stuck"))
    scaled = sums.join(hint_small(settle(stuck)), "scenario").withColumn("score", F.col("score") * (1 - damping) / (1 - damping * F.col("stuck")))
    return settle(scaled.drop("stuck"))


# Rows of (start, vertex) that one pass of path counting may hold by the counts of starts and vertices.
STATE_ROWS = 200_000_000


def path_levels(arcs: DataFrame, starts: DataFrame, removed: DataFrame | None = None) -> list[DataFrame]:
    """Numbers of shortest paths from starts (scenario, v): one settled (scenario, s, v, sigma) per distance 0, 1, 2, ...

    A step extends the last level only. What was met before lies dealt by its keys and is looked up there; levels are written
    once and never again. A level is summed as a whole, so its counts are exact (up to 2^53 paths).
    """
    on = ["scenario", "s", "v"]
    level = settle(live_seeds(starts, removed).select("scenario", F.col("v").alias("s"), "v", F.lit(1.0).alias("sigma")))
    (met, size), recent, changed = dealt(level.select(*on), on), [], 0
    levels, rows = [], size
    while rows:
        levels.append(level)
        ahead = level.select("scenario", "s", F.col("v").alias("src"), "sigma").join(arcs, "src")
        ahead = live_seeds(ahead.select("scenario", "s", F.col("dst").alias("v"), "sigma"), removed)
        ahead = ahead.groupBy(*on).agg(F.sum("sigma").alias("sigma")).join(met, on, "left_anti")
        if recent:
            ahead = ahead.join(reduce(DataFrame.unionByName, recent), on, "left_anti")
        level = settle(ahead)
        rows = level.count()
        recent.append(level.select(*on))
        changed += rows
        if len(recent) == MERGE_STEPS or changed > MERGE_SHARE * size:
            before = met
            (met, size), recent, changed = dealt(reduce(DataFrame.unionByName, recent, met), on), [], 0
            before.unpersist()
    met.unpersist()
    return levels


def dependencies(arcs: DataFrame, starts: DataFrame, removed: DataFrame | None = None, goals: DataFrame | None = None) -> DataFrame:
    """(scenario, s, v, delta): share of the shortest paths from s to every vertex (or goal (v)) that run through v, ends excluded.

    From the last level back, a level needs the shares of the next one only: one table per level, each written once.
    """
    levels = path_levels(arcs, starts, removed)
    if goals is not None:
        goals = hint_small(settle(goals.select("v", F.lit(1.0).alias("goal"))))
    own = lambda level: level.withColumn("goal", F.lit(1.0)) if goals is None else level.join(goals, "v", "left").na.fill(0.0, ["goal"])
    deltas, below = [], None
    for depth in range(len(levels) - 1, 0, -1):
        here = own(levels[depth])
        here = here.withColumn("delta", F.lit(0.0)) if below is None else here.join(below, ["scenario", "s", "v"], "left").na.fill(0.0, ["delta"])
        unit = here.select("scenario", "s", F.col("v").alias("dst"), ((F.col("goal") + F.col("delta")) / F.col("sigma")).alias("unit"))
        up = unit.filter("unit > 0").join(arcs, "dst").groupBy("scenario", "s", F.col("src").alias("v")).agg(F.sum("unit").alias("unit"))
        # Only predecessors one level up lie on a shortest path.
        up = levels[depth - 1].join(up, ["scenario", "s", "v"])
        below = settle(up.select("scenario", "s", "v", (F.col("sigma") * F.col("unit")).alias("delta")))
        if depth > 1:
            deltas.append(below)
    if not deltas:
        return starts.select("scenario", F.col("v").alias("s"), "v", F.lit(0.0).alias("delta")).limit(0)
    return reduce(DataFrame.unionByName, deltas)


def betweenness(
    graph: Graph, scenarios: DataFrame | None = None, removed: DataFrame | None = None,
    restricted: bool = False, source_blocks: int | None = None,
) -> DataFrame:
    """(scenario, v, score): shortest hop paths through v, ends excluded; zeros kept for present vertices.

    ``restricted`` counts only paths from sources to targets. There is a row per (start, vertex) reached; the starts run in
    as many passes as keep that below ``STATE_ROWS``, or in ``source_blocks`` passes.
    """
    scenarios = intact_scenario(graph) if scenarios is None else scenarios
    arcs = graph.arcs()
    starts = graph.sources if restricted else graph.vertices.select("v")
    if source_blocks is None:
        source_blocks = max(1, -(-starts.count() * graph.size * scenarios.count() // STATE_ROWS))
    parts = []
    for block in range(source_blocks):
        chosen = starts if source_blocks == 1 else starts.filter(F.pmod(F.xxhash64("v"), F.lit(source_blocks)) == block)
        part = dependencies(arcs, graph.spread(chosen.select("v"), scenarios), removed, graph.targets if restricted else None)
        part = part.groupBy("scenario", "v").agg(F.sum("delta").alias("score"))
        parts.append(part if source_blocks == 1 else settle(part))
    total = reduce(DataFrame.unionByName, parts).groupBy("scenario", "v").agg(F.sum("score").alias("score"))
    present = live_seeds(graph.spread(graph.vertices.select("v"), scenarios), removed)
    return present.join(total, ["scenario", "v"], "left").select("scenario", "v", F.coalesce("score", F.lit(0.0)).alias("score"))


def betweenness_estimate(graph: Graph, error: float, confidence: float = 0.95, seed: int = 0, first: int = 64) -> DataFrame:
    """(v, score, bound, starts): betweenness from drawn starts; with ``confidence`` no vertex is off by more than its bound.

    ``error`` is a share of the (n - 1)(n - 2) ordered pairs a vertex can lie between. Starts come in md5 order in parts of doubling
    size until the empirical Bernstein bound of every vertex, shared among vertices and rounds, is at most ``error``; once all
    vertices have started the scores are exact and the bound is 0. ``first`` is the expected size of the first part.
    """
    n, arcs = graph.size, graph.arcs()
    vertices = graph.vertices.select("v").withColumn("u", unit_uniform(random_key(seed, "v")))
    rounds = max(1, math.ceil(math.log2(max(2.0, n / first))) + 1)
    log = math.log(3 * max(1, n) * rounds / (1 - confidence))
    sums, done, used, part = [], 0.0, 0, first / max(1, n)
    while done < 1.0:
        upto = 1.0 if part >= 1.0 or len(sums) + 1 >= rounds else part
        chosen = settle(vertices.filter((F.col("u") >= done) & ((F.col("u") < upto) | F.lit(upto == 1.0))).select("v"))
        used, done, part = used + chosen.count(), upto, upto * 2
        share = F.col("delta") / F.lit(float(max(1, n - 2)))
        got = dependencies(arcs, graph.spread(chosen, intact_scenario(graph)))
        sums.append(settle(got.groupBy("v").agg(F.sum(share).alias("a"), F.sum(share * share).alias("b"))))
        if used == 0:
            continue
        total = reduce(DataFrame.unionByName, sums).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        table = graph.vertices.select("v").join(total, "v", "left").na.fill(0.0, ["a", "b"])
        variance = F.greatest(F.lit(0.0), F.col("b") / used - F.pow(F.col("a") / used, 2))
        bound = F.lit(0.0) if done == 1.0 else F.sqrt(2 * variance * log / used) + 3 * log / used
        table = table.select("v", (F.col("a") / used).alias("mean"), bound.alias("bound"))
        if done == 1.0 or table.filter(F.col("bound") > error).isEmpty():
            break
    # The mean over starts is a mean of sums over ends: times n starts and n - 2 inner places of each.
    scale = F.lit(float(n * max(1, n - 2)))
    return settle(table.select("v", (F.col("mean") * scale).alias("score"), (F.col("bound") * scale).alias("bound"), F.lit(used).cast("long").alias("starts")))


# Links (both directions of an edge) that a block of the coreness steps holds on average.
BLOCK_LINKS = 2_000_000
_PLACES = 1 << 32


def _row(names: list[str], kinds: list[pa.DataType], *rows: tuple) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names) if rows else pa.table([pa.array([], k) for k in kinds], names=names)


def _link_block(table: pa.Table) -> pa.Table:
    """One row (block, begins, links, beyond) of the links (block, place, u): ``beyond`` are the distinct u in order, ``links`` the
    positions in it of the neighbours of place 0, 1, ..., which begin at ``begins``. Repeated links count once."""
    beyond, at = np.unique(table.column("u").to_numpy(), return_inverse=True)
    keys = np.unique(table.column("place").to_numpy() * beyond.size + at)
    places = keys // beyond.size
    begins = np.searchsorted(places, np.arange(places[-1] + 2))
    row = (table.column("block")[0].as_py(), begins.astype(np.int64).tobytes(), (keys % beyond.size).astype(np.int32).tobytes(), beyond.tobytes())
    return _row(["block", "begins", "links", "beyond"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()], row)


def _h_values(links: np.ndarray, sizes: np.ndarray, own: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """The largest h <= own of which at least h neighbours are not below h, by vertex; ``links`` are the neighbours' positions in ``theirs``."""
    begin, top = np.cumsum(sizes) - sizes, int(own.max()) + 1
    vertex = np.repeat(np.arange(sizes.size), sizes)
    keys = np.sort(vertex * top + (top - 1 - np.minimum(theirs[links], own[vertex])))
    place = np.arange(1, links.size + 1) - begin[vertex]
    return np.maximum.reduceat(np.minimum(top - 1 - keys % top, place), begin)


def _core_step(block: pa.Table, come: pa.Table) -> pa.Table:
    """Rows (block, origin, places, vals) after a step of one block: its own state (origin -1: values of its vertices and of what lies
    ``beyond``) and, for every block with a neighbour of a vertex whose value fell, the places and values of those vertices.

    ``come`` are such rows of the step before; without any, values are the degrees and everyone is told.
    """
    own_name = block.column("block")[0].as_py()
    begins, links, beyond = (np.frombuffer(block.column(c)[0].as_py(), k) for c, k in (("begins", np.int64), ("links", np.int32), ("beyond", np.int64)))
    sizes = np.diff(begins)
    if come.num_rows == 0:
        own, theirs, fell = sizes.astype(np.int32), np.zeros(beyond.size, np.int32), np.arange(sizes.size)
    else:
        news = dict(zip(come.column("origin").to_pylist(), zip(come.column("places").to_pylist(), come.column("vals").to_pylist())))
        own, theirs = (np.frombuffer(x, np.int32).copy() for x in news.pop(-1))
        told = np.zeros(beyond.size, bool)
        for origin, (places, vals) in news.items():
            at = np.searchsorted(beyond, np.frombuffer(places, np.int32) + np.int64(origin) * _PLACES)
            theirs[at], told[at] = np.frombuffer(vals, np.int32), True
        fell = np.zeros(0, np.int64)
        if news:
            met = told[links] & (theirs[links] < np.repeat(own, sizes))
            some = np.flatnonzero(np.logical_or.reduceat(met, begins[:-1]))
            if some.size:
                mine = np.repeat(begins[some] - (np.cumsum(sizes[some]) - sizes[some]), sizes[some]) + np.arange(sizes[some].sum())
                now = _h_values(links[mine], sizes[some], own[some], theirs)
                fell = some[now < own[some]]
                own[some] = now
    rows = [(own_name, -1, own.tobytes(), theirs.tobytes())]
    if fell.size:
        mine = np.repeat(begins[fell] - (np.cumsum(sizes[fell]) - sizes[fell]), sizes[fell]) + np.arange(sizes[fell].sum())
        pairs = np.unique((beyond // _PLACES)[links[mine]] * _PLACES + np.repeat(fell, sizes[fell]))
        ends, places = pairs // _PLACES, (pairs % _PLACES).astype(np.int32)
        names, first = np.unique(ends, return_index=True)
        for name, part in zip(names.tolist(), np.split(places, first[1:])):
            rows.append((name, own_name, part.tobytes(), own[part].tobytes()))
    return _row(["block", "origin", "places", "vals"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()], *rows)


def _core_values(batches):
    """(block, place, coreness) of states."""
    for batch in batches:
        for block, state in zip(batch.column("block").to_pylist(), batch.column("places").to_pylist()):
            vals = np.frombuffer(state, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(vals.size, block, np.int32)), pa.array(np.arange(vals.size)), pa.array(vals)], names=["block", "place", "coreness"]
            )


def coreness(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, coreness) of the undirected simple projection: fixpoint of the h-index of the neighbours' values.

    Vertices are numbered and dealt to blocks by a hash; a block of about ``BLOCK_LINKS`` links lies with its task as arrays. A step shuffles
    the values that fell, once for every block that knows them, and the values a block knows; it looks at the vertices beside a fall below
    their own value only, and at all of a block at once. A block holds all links of its vertices.
    """
    plain = edges.filter("src <> dst").select("src", "dst")
    blocks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * plain.count() // BLOCK_LINKS))
    ends = plain.select(F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    order = Window.partitionBy("block").orderBy("v")
    names = store(ends.withColumn("place", F.row_number().over(order).cast("long") - 1))
    number = (F.col("block") * F.lit(_PLACES) + F.col("place")).alias("id")
    coded = plain.join(names.select(F.col("v").alias("src"), number.alias("a")), "src").join(names.select(F.col("v").alias("dst"), number.alias("b")), "dst")
    both = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u"))))
    rows = coded.select(both.alias("e")).select(F.floor(F.col("e.v") / F.lit(_PLACES)).cast("int").alias("block"), F.pmod("e.v", F.lit(_PLACES)).alias("place"), "e.u")
    built = store(rows.groupBy("block").applyInArrow(_link_block, "block int, begins binary, links binary, beyond binary"))
    lying = built.repartition(blocks, "block").persist(StorageLevel.MEMORY_AND_DISK)
    lying.count()
    schema = "block int, origin int, places binary, vals binary"
    state = edges.sparkSession.createDataFrame([], schema)
    while True:
        state = store(lying.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(_core_step, schema))
        if state.filter("origin >= 0").isEmpty():
            break
    lying.unpersist()
    cores = state.filter("origin < 0").mapInArrow(_core_values, "block int, place long, coreness int").join(names, ["block", "place"])
    return vertices.select("v").join(cores.select("v", "coreness"), "v", "left").na.fill(0, ["coreness"])


def coreness_histogram(cores: DataFrame) -> DataFrame:
    """(coreness, vertices, deepest)."""
    counts = cores.groupBy("coreness").agg(F.count(F.lit(1)).alias("vertices"))
    top = F.max("coreness").over(Window.partitionBy(F.lit(0)))  # one row per core level
    return counts.select("coreness", "vertices", (F.col("coreness") == top).alias("deepest"))


def out_strength(graph, scenarios=None, removed=None) -> DataFrame:
    return _strength(graph, scenarios, removed, "src")


def in_strength(graph, scenarios=None, removed=None) -> DataFrame:
    return _strength(graph, scenarios, removed, "dst")


def _strength(graph, scenarios, removed, end):
    """Intact strength minus the weight of edges to removed vertices: only edges next to a removal are read per scenario."""
    scenarios = intact_scenario(graph) if scenarios is None else scenarios
    other = "dst" if end == "src" else "src"
    whole = graph.edges.groupBy(F.col(end).alias("v")).agg(F.sum("weight").alias("score"))
    table = live_seeds(graph.spread(graph.vertices.select("v").join(whole, "v", "left").na.fill(0, ["score"]), scenarios), removed)
    if removed is None:
        return table.select("scenario", "v", "score")
    lost = removed.select("scenario", F.col("v").alias(other)).join(graph.edges.select("src", "dst", "weight"), other)
    lost = lost.groupBy("scenario", F.col(end).alias("v")).agg(F.sum("weight").alias("lost"))
    return table.join(lost, ["scenario", "v"], "left").select("scenario", "v", (F.col("score") - F.coalesce("lost", F.lit(0))).alias("score"))


STRATEGIES = {
    "out_strength": out_strength,
    "in_strength": in_strength,
    "betweenness": lambda g, scenarios=None, removed=None: betweenness(g, scenarios, removed),
    "pagerank": lambda g, scenarios=None, removed=None: pagerank(g, scenarios, removed),
    "sm_betweenness": lambda g, scenarios=None, removed=None: betweenness(g, scenarios, removed, restricted=True),
}


def strategy_scores(name: str, graph: Graph, scenarios: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """(scenario, v, score) of a registered strategy; ``random`` scores are equal, so that the random tie key decides."""
    if name == "random":
        scenarios = intact_scenario(graph) if scenarios is None else scenarios
        return live_seeds(graph.spread(graph.vertices.select("v", F.lit(0).alias("score")), scenarios), removed)
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: random, {', '.join(STRATEGIES)}")
    return STRATEGIES[name](graph, scenarios, removed)


def score_table(graph: Graph, include_betweenness: bool = True, tolerance: float = 1e-9) -> DataFrame:
    """One row per vertex with degrees, strengths, PageRank and restricted (and full) betweenness."""
    table = degrees(graph.edges, graph.vertices)
    columns = {"pagerank": pagerank(graph, tolerance=tolerance), "sm_betweenness": betweenness(graph, restricted=True)}
    if include_betweenness:
        columns["betweenness"] = betweenness(graph)
    for name, scores in columns.items():
        table = table.join(scores.select("v", F.col("score").alias(name)), "v")
    return table


def percentile_table(scores: DataFrame, columns: list[str]) -> DataFrame:
    for column in columns:
        scores = with_percentile(scores, column, f"{column}_pct")
    return scores


def bottleneck_candidates(percentiles: DataFrame, low: float = 50.0, high: float = 99.0) -> DataFrame:
    """Below ``low`` by degree and PageRank yet at or above ``high`` by restricted betweenness, most extreme first."""
    keep = (F.col("degree_pct") < low) & (F.col("pagerank_pct") < low) & (F.col("sm_betweenness_pct") >= high)
    return percentiles.filter(keep).orderBy(F.desc("sm_betweenness"), F.asc("degree"))
