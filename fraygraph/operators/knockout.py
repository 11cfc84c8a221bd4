"""Knock-out scans: single vertices, pairs, groups, two-sided labels, and what exactly is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.functions.scalars import ratio
from fraygraph.operators import central, dominators, flow, reach
from fraygraph.operators.curves import upper_p
from fraygraph.operators.graph_build import Graph, degrees, top_partners
from fraygraph.operators.ranking import competition_rank, number_within, permuted
from fraygraph.session import hint_small, replicate, settle


def each_vertex(vertices: DataFrame) -> DataFrame:
    """One scenario per vertex, named after it."""
    return vertices.select(F.col("v").alias("scenario"), "v")


def intact_flow(graph: Graph, layered: bool | None = None) -> int:
    return flow.flow_values(graph, reach.intact_scenario(graph), layered=layered).first()["flow"]


def flow_drops(graph: Graph, removals: DataFrame, layered: bool | None = None) -> DataFrame:
    """(scenario, flow, flow_drop) for scenarios (scenario, v).

    On general graphs a scenario is solved only if it removes a vertex that carries a unit of one intact flow: the
    others leave that flow untouched and cannot lower it. Those that are start from the intact flow without the unit paths
    through what they remove, so they augment what they lost and nothing else.
    """
    layered = flow.use_layers(graph, layered)
    names = removals.select("scenario").distinct()
    if layered:
        values = flow.flow_values(graph, names, removals, True)
        return values.withColumn("flow_drop", F.lit(intact_flow(graph, True)) - F.col("flow"))
    solved = flow.max_flow(graph, reach.intact_scenario(graph))
    whole = solved.value.first()["flow"]
    base = flow.unit_paths(graph, solved)
    busy = base.paths.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    touched = settle(removals.join(busy, "v", "left_semi").select("scenario").distinct())
    if touched.isEmpty():
        return names.select("scenario", F.lit(whole).alias("flow"), F.lit(0).cast("long").alias("flow_drop"))
    relevant = removals.join(touched, "scenario", "left_semi")
    values = flow.max_flow(graph, touched, relevant, base=base).value
    table = names.join(values, "scenario", "left").select("scenario", F.coalesce("flow", F.lit(whole)).alias("flow"))
    return table.withColumn("flow_drop", F.lit(whole) - F.col("flow"))


def lost_pairs(graph: Graph, candidates: DataFrame | None = None) -> DataFrame:
    """(v, s, m): pairs that lose every path when v, another vertex, goes: v is a dominator of m as seen from s."""
    losses = dominators.losses_of_chains(graph, dominators.dominator_chains(graph))
    return losses if candidates is None else losses.join(hint_small(settle(candidates.select("v").distinct())), "v", "left_semi")


def deletion_losses(graph: Graph, candidates: DataFrame) -> DataFrame:
    """(v, s, m): every pair lost when v goes, v itself as an end included, straight from the reach relation."""
    scenarios = candidates.select(F.col("v").alias("scenario"))
    full = reach.reach_relation(graph, reach.intact_scenario(graph)).select("s", "m")
    kept = reach.reach_relation(graph, scenarios, each_vertex(candidates))
    return replicate(full, scenarios).join(kept, ["scenario", "s", "m"], "left_anti").select(F.col("scenario").alias("v"), "s", "m")


def own_losses(graph: Graph, relation: DataFrame) -> DataFrame:
    """(v, s, m): pairs that v is an end of."""
    ends = F.explode(F.array("s", "m"))
    return relation.select(ends.alias("v"), "s", "m")


def cross_check(graph: Graph, losses: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows in which listed losses plus own pairs differ from deletion; must be empty."""
    relation = settle(reach.reach_relation(graph, reach.intact_scenario(graph)).select("s", "m"))
    listed = losses.join(candidates.select("v"), "v", "left_semi").unionByName(
        own_losses(graph, relation).join(candidates.select("v"), "v", "left_semi")
    )
    direct = deletion_losses(graph, candidates)
    return listed.exceptAll(direct).withColumn("side", F.lit("listed only")).unionByName(
        direct.exceptAll(listed).withColumn("side", F.lit("deletion only"))
    )


def loss_counts_twice(graph: Graph, losses: DataFrame, relation: DataFrame, candidates: DataFrame) -> DataFrame:
    """(v, listed, deleted) of every candidate: pairs lost by the listed losses and own pairs, and by deleting the vertex."""
    listed = losses.unionByName(own_losses(graph, relation)).groupBy("v").agg(F.count(F.lit(1)).alias("listed"))
    deleted = deletion_losses(graph, candidates).groupBy("v").agg(F.count(F.lit(1)).alias("deleted"))
    return candidates.select("v").join(listed, "v", "left").join(deleted, "v", "left").na.fill(0, ["listed", "deleted"])


def loss_summary(graph: Graph, losses: DataFrame, relation: DataFrame) -> DataFrame:
    """(v, role, pairs_lost, own_pairs, other_pairs, sources_cut, targets_cut) for every vertex that costs a pair."""
    others = losses.groupBy("v").agg(
        F.count(F.lit(1)).alias("other_pairs"), F.countDistinct("s").alias("sources_cut"), F.countDistinct("m").alias("targets_cut")
    )
    own = own_losses(graph, relation).groupBy("v").agg(F.count(F.lit(1)).alias("own_pairs"))
    table = own.join(others, "v", "full").na.fill(0)
    role = F.when(F.col("role") == "S", "source").when(F.col("role") == "M", "target").otherwise("other")
    return table.join(hint_small(settle(graph.terminals)), "v", "left").select(
        "v", role.alias("role"), (F.col("own_pairs") + F.col("other_pairs")).alias("pairs_lost"), "own_pairs", "other_pairs", "sources_cut", "targets_cut"
    )


def grouped_losses(losses: DataFrame, relation: DataFrame, target_rank: DataFrame, limit: int = 12) -> DataFrame:
    """(v, s, reach, lost, shown): per removed vertex and source the first ``limit`` lost targets in display order.

    ``target_rank`` is (m, rank). The list length is the report's own limit; ``lost`` counts all of them.
    """
    reach_of = relation.groupBy("s").agg(F.count(F.lit(1)).alias("reach"))
    ranked = losses.join(target_rank, "m")
    salted = ranked.withColumn("_salt", F.pmod(F.xxhash64("m"), F.lit(16)))
    first = salted.withColumn("_rn", F.row_number().over(Window.partitionBy("v", "s", "_salt").orderBy("rank"))).filter(F.col("_rn") <= limit)
    first = first.withColumn("_rn", F.row_number().over(Window.partitionBy("v", "s").orderBy("rank"))).filter(F.col("_rn") <= limit)
    lists = first.groupBy("v", "s").agg(F.array_sort(F.collect_list(F.struct("rank", "m"))).alias("_l"))
    totals = losses.groupBy("v", "s").agg(F.count(F.lit(1)).alias("lost"))
    return totals.join(lists, ["v", "s"]).join(reach_of, "s").select("v", "s", "reach", "lost", F.col("_l.m").alias("shown"))


def target_order(graph: Graph, classes: DataFrame, class_order: list[str]) -> DataFrame:
    """(m, rank): targets by class in the given order (others last), then name; display rank from 0."""
    place = F.coalesce(*[F.when(F.col("class") == c, F.lit(i)) for i, c in enumerate(class_order)], F.lit(len(class_order)))
    rows = graph.targets.join(classes.select("v", "class"), "v", "left").withColumn("_place", place)
    sizes = rows.groupBy("_place").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_place", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_place").orderBy("v")
    return rows.join(F.broadcast(offsets), "_place").select(
        F.col("v").alias("m"), (F.row_number().over(within) - 1 + F.col("_before")).cast("int").alias("rank")
    )


def single_scan(graph: Graph, layered: bool | None = None) -> DataFrame:
    """(v, flow, flow_drop, reachable_pairs, pairs_lost) for the removal of every vertex."""
    drops = flow_drops(graph, each_vertex(graph.vertices), layered).withColumnRenamed("scenario", "v")
    relation = settle(reach.reach_relation(graph, reach.intact_scenario(graph)).select("s", "m"))
    lost = loss_summary(graph, lost_pairs(graph), relation).select("v", "pairs_lost")
    total = relation.count()
    return drops.join(lost, "v", "left").na.fill(0, ["pairs_lost"]).select(
        "v", "flow", "flow_drop", (F.lit(total) - F.col("pairs_lost")).alias("reachable_pairs"), "pairs_lost"
    )


def candidate_pool(scores: DataFrame, size: int) -> DataFrame:
    """(v, flow_drop, impact_per_edge, sm_betweenness, pool_rank): the ``size`` vertices that cost most per incident edge."""
    per_edge = F.when(F.col("degree") > 0, F.col("flow_drop") / F.col("degree")).otherwise(F.lit(0.0))
    rows = scores.withColumn("impact_per_edge", per_edge)
    order = [F.desc("impact_per_edge"), F.desc("sm_betweenness"), F.asc("v")]
    top = rows.orderBy(*order).limit(size)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return top.select("v", "flow_drop", "impact_per_edge", "sm_betweenness", rank.alias("pool_rank"))


def pool_pairs(pool: DataFrame, size: int) -> DataFrame:
    """(a, b, drop_a, drop_b): unordered pairs of a pool of at most ``size`` members, which the pair report lists in full.

    Each member names the ranks behind its own and an equi-join looks them up.
    """
    left = pool.filter(F.col("pool_rank") < size).select(
        F.col("v").alias("a"), F.col("flow_drop").alias("drop_a"), F.explode(F.sequence(F.col("pool_rank") + 1, F.lit(size))).alias("pool_rank")
    )
    right = pool.select(F.col("v").alias("b"), F.col("flow_drop").alias("drop_b"), "pool_rank")
    return left.join(right, "pool_rank").select("a", "b", "drop_a", "drop_b")


def pair_synergy(graph: Graph, pool: DataFrame, size: int, layered: bool | None = None) -> DataFrame:
    """(a, b, drop_a, drop_b, flow_after, joint_impact, synergy) over the pool."""
    pairs = settle(pool_pairs(pool, size).withColumn("scenario", F.struct("a", "b")))
    removals = pairs.select("scenario", F.explode(F.array("a", "b")).alias("v"))
    joint = flow_drops(graph, removals, layered)
    return pairs.join(joint, "scenario").select(
        "a", "b", "drop_a", "drop_b", F.col("flow").alias("flow_after"), F.col("flow_drop").alias("joint_impact"),
        (F.col("flow_drop") - F.col("drop_a") - F.col("drop_b")).alias("synergy"),
    )


def same_size_draws(vertices: DataFrame, sizes: DataFrame | list[int], draws: int, seed: int, total: int) -> DataFrame:
    """(size, draw, v): ``draws`` random sets without replacement of every distinct ``size`` (all vertices if it is larger).

    A draw of k vertices is the image of the numbers 0 .. k - 1 under a permutation of its own, so a set costs its own rows
    and nothing for the vertices it leaves.
    """
    if not isinstance(sizes, DataFrame):
        sizes = vertices.sparkSession.createDataFrame([(k,) for k in sizes], "size int")
    if not total:
        return sizes.select("size", F.lit(0).alias("draw"), F.lit(None).cast(vertices.schema["v"].dataType).alias("v")).limit(0)
    asked = sizes.select(F.col("size").cast("int").alias("size")).filter("size > 0").distinct()
    asked = asked.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    asked = asked.withColumn("place", F.explode(F.sequence(F.lit(0), F.least(F.col("size"), F.lit(total)) - 1)))
    numbers = number_within(vertices.select("v", F.lit(0).alias("all")), ["all"], ["v"], "n", group_rows=total)
    numbers = numbers.select((F.col("n") - 1).cast("long").alias("place"), "v")
    return settle(permuted(asked, "place", total, seed, "size", "draw").join(numbers, "place").select("size", "draw", "v"))


def group_impact(graph: Graph, groups: DataFrame, draws: int, seed: int, layered: bool | None = None) -> DataFrame:
    """Removal of whole groups (group, v) against same-size random sets; draws are shared by groups of equal size.

    Without any intact flow no share of it can be lost: shares are NaN and all tie.
    """
    members = settle(groups.join(graph.vertices.select("v"), "v", "left_semi").select("group", "v"))
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).cast("int").alias("size"))
    random = same_size_draws(graph.vertices, sizes, draws, seed, graph.size)
    name = lambda kind, *c: F.concat_ws("|", F.lit(kind), *c)
    scenarios = members.select(name("group", "group").alias("scenario"), "v").unionByName(
        random.select(name("draw", "size", "draw").alias("scenario"), "v")
    )
    intact = intact_flow(graph, layered)
    drops = settle(flow_drops(graph, scenarios, layered).withColumn("share", F.lit(1.0) - ratio(F.col("flow"), F.lit(intact))))
    seen = members.join(hint_small(settle(graph.terminals)), "v", "left").groupBy("group").agg(
        F.count_if(F.col("role") == "S").alias("n_sources"), F.count_if(F.col("role") == "M").alias("n_targets")
    )
    observed = sizes.join(seen, "group").withColumn("scenario", name("group", "group")).join(drops, "scenario")
    observed = observed.select("group", "size", "n_sources", "n_targets", F.col("flow").alias("flow_after"), F.col("share").alias("flow_drop"))
    nulls = random.select("size", "draw").distinct().withColumn("scenario", name("draw", "size", "draw")).join(drops, "scenario")
    result = upper_p(observed, nulls.select("size", F.col("share").alias("flow_drop")), ["size"], "flow_drop")
    return result.withColumn("excess", F.col("flow_drop") - F.col("random_mean"))


def two_sided_labels(vertices: DataFrame) -> DataFrame:
    """Labels with both an L and an R vertex, from vertices (v, label, side)."""
    sides = vertices.groupBy("label").agg(F.count_if(F.col("side") == "L").alias("l"), F.count_if(F.col("side") == "R").alias("r"))
    return sides.filter("l > 0 and r > 0").select("label")


def bilateral_impact(graph: Graph, sided: DataFrame, layered: bool | None = None) -> DataFrame:
    """(label, impact_left, impact_right, impact_both, single_mean, superadditivity) for vertices (v, label, side)."""
    labels = two_sided_labels(sided)
    rows = sided.filter("side in ('L', 'R')").join(labels, "label", "left_semi")
    which = F.explode(F.array(F.col("side"), F.lit("both")))
    removals = settle(rows.select("label", which.alias("kind"), "v").select(F.struct("label", "kind").alias("scenario"), "v"))
    drops = flow_drops(graph, removals, layered).select("scenario.label", "scenario.kind", "flow_drop")
    table = drops.groupBy("label").pivot("kind", ["L", "R", "both"]).agg(F.first("flow_drop"))
    return table.select(
        "label", F.col("L").alias("impact_left"), F.col("R").alias("impact_right"), F.col("both").alias("impact_both"),
        ((F.col("L") + F.col("R")) / 2).alias("single_mean"), (F.col("both") - F.col("L") - F.col("R")).alias("superadditivity"),
    )


def informative(table: DataFrame) -> DataFrame:
    return table.filter("impact_left <> 0 or impact_right <> 0 or impact_both <> 0")


def additivity_counts(table: DataFrame) -> DataFrame:
    """Counts over informative labels; insured labels lose nothing on either side alone but something with both gone."""
    return informative(table).agg(
        F.count(F.lit(1)).alias("informative"), F.count_if(F.col("superadditivity") > 0).alias("superadditive"),
        F.count_if(F.col("superadditivity") == 0).alias("additive"), F.count_if(F.col("superadditivity") < 0).alias("subadditive"),
        F.count_if((F.col("impact_left") == 0) & (F.col("impact_right") == 0) & (F.col("impact_both") > 0)).alias("insured"),
    )


def detour_detail(graph: Graph, removals: DataFrame) -> DataFrame:
    """(scenario, pairs, pairs_lost, pairs_longer) per removal scenario, from distances before and after.

    A pair is lost when no distance is left, so lost pairs are counted, not listed: all pairs less those still joined.
    Pairs of a removed terminal are lost; without any pair all counts are 0.
    """
    scenarios = settle(removals.select("scenario").distinct())
    targets = hint_small(settle(graph.targets))
    before = settle(reach.distances(graph, reach.intact_scenario(graph)).join(targets, "v").select("s", "v", F.col("dist").alias("near")))
    after = reach.distances(graph, scenarios, removals).join(targets, "v").select("scenario", "s", "v", F.col("dist").alias("far"))
    still = after.join(hint_small(before), ["s", "v"]).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("joined"), F.count_if(F.col("far") > F.col("near")).alias("pairs_longer")
    )
    pairs = F.lit(before.count()).cast("long")
    table = scenarios.join(still, "scenario", "left").na.fill(0, ["joined", "pairs_longer"])
    return table.select("scenario", pairs.alias("pairs"), (pairs - F.col("joined")).alias("pairs_lost"), "pairs_longer")


def knockout_detail(graph: Graph, candidates: DataFrame, strongest: int = 5, layered: bool | None = None, restricted: DataFrame | None = None) -> DataFrame:
    """What hangs on each of a few vertices (v), one row per candidate in the graph, repeated ones once.

    (v, in_degree, out_degree, degree, sm_betweenness, sm_betweenness_rank, reachable_pairs, share_of_shortest_routes, pairs_lost,
    pairs_longer, intact_flow, flow_after, strongest_inputs, strongest_outputs). The share is the part of all shortest
    source-target routes that run through v (restricted betweenness over reachable pairs, each pair counted once; 0 without pairs); the rank is
    among all vertices, equal scores share the better rank. Partners are arrays of (partner, class, weight), heaviest first.
    ``restricted`` is a table (v, sm_betweenness) that is at hand already.
    """
    chosen = settle(candidates.select("v").distinct().join(graph.vertices.select("v"), "v", "left_semi"))
    if restricted is None:
        restricted = central.betweenness(graph, restricted=True).select("v", F.col("score").alias("sm_betweenness"))
    ranked = competition_rank(restricted.select("v", "sm_betweenness"), "sm_betweenness").withColumnRenamed("rank", "sm_betweenness_rank")
    scenarios = settle(each_vertex(chosen))
    detours = detour_detail(graph, scenarios).withColumnRenamed("scenario", "v").withColumnRenamed("pairs", "reachable_pairs")
    drops = flow_drops(graph, scenarios, layered).select(F.col("scenario").alias("v"), (F.col("flow") + F.col("flow_drop")).alias("intact_flow"), F.col("flow").alias("flow_after"))
    table = degrees(graph.edges, graph.vertices).select("v", "in_degree", "out_degree", "degree").join(hint_small(chosen), "v")
    table = table.join(ranked.select("v", "sm_betweenness", "sm_betweenness_rank"), "v").join(detours, "v").join(drops, "v")
    share = F.when(F.col("reachable_pairs") > 0, F.col("sm_betweenness") / F.col("reachable_pairs")).otherwise(0.0)
    table = table.withColumn("share_of_shortest_routes", share)
    attributes = graph.vertices if "class" in graph.vertices.columns else graph.vertices.select("v", F.lit(None).cast("string").alias("class"))
    for name, side, end in (("strongest_inputs", "in", "dst"), ("strongest_outputs", "out", "src")):
        near = graph.edges.join(hint_small(chosen.withColumnRenamed("v", end)), end, "left_semi")
        best = top_partners(near, attributes, side, strongest)  # at most ``strongest`` rows a vertex
        lists = best.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("rank", "partner", "class", "weight"))).alias("p"))
        shown = F.transform("p", lambda x: F.struct(x["partner"].alias("partner"), x["class"].alias("class"), x["weight"].alias("weight")))
        lists = lists.select("v", shown.alias(name))
        nothing = F.from_json(F.lit("[]"), lists.schema[name].dataType)
        table = table.join(lists, "v", "left").withColumn(name, F.coalesce(name, nothing))
    return table.select(
        "v", "in_degree", "out_degree", "degree", "sm_betweenness", "sm_betweenness_rank", "reachable_pairs", "share_of_shortest_routes",
        "pairs_lost", "pairs_longer", "intact_flow", "flow_after", "strongest_inputs", "strongest_outputs",
    )
