"""Queries over whole networks: reachability, flow, centralities, knock-outs, losses, null models, tails and rank tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraygraph.operators import central, checks, curves, flow, knockout as K, nulls, ranking, reach, removal, stats, tails
from fraygraph.operators import graph_build as B
from fraygraph.plans import graphs as G
from fraygraph.plans.registry import query
from fraygraph.plans.runs import pooled_cascades
from fraygraph.session import settle

R = "WITH RECURSIVE "
SWITCH = R + G.switch_sql()
SPARSE = 0.03
SWITCH3 = R + G.switch_sql(SPARSE)
TRADE = R + G.trade_sql()


def class_removals(graph):
    """One scenario per vertex class: all its members go."""
    return settle(graph.vertices.select(F.col("class").alias("scenario"), "v"))


def class_scenarios(graph):
    return settle(graph.vertices.select(F.col("class").alias("scenario")).distinct())


# ---- reachability ---------------------------------------------------------------------------------------------------

LIVE = """scenarios AS (SELECT DISTINCT class AS scenario FROM vertices),
live AS MATERIALIZED (SELECT scenario, v FROM scenarios, vertices WHERE class <> scenario)"""
REACH = LIVE + """,
reach(scenario, s, v) AS (SELECT scenario, v, v FROM live JOIN sources USING (v)
UNION SELECT r.scenario, r.s, e.dst FROM reach r JOIN edges e ON r.v = e.src JOIN live l ON l.scenario = r.scenario AND l.v = e.dst)"""


@query("rc1_reachable_pairs", f"{SWITCH3}, {REACH} SELECT scenario, count(r.v) AS reachable_pairs FROM scenarios LEFT JOIN (SELECT * FROM reach JOIN targets USING (v)) r USING (scenario) GROUP BY 1")
def _(spark, sf):
    graph = G.switch(spark, sf, SPARSE)
    return reach.reachable_pair_counts(graph, class_scenarios(graph), class_removals(graph))


@query("rc2_reach_fraction", f"""{SWITCH3}, {REACH}, sizes AS (SELECT scenario, count(*) FILTER (WHERE role = 'S') * count(*) FILTER (WHERE role = 'M') AS possible FROM scenarios LEFT JOIN live USING (scenario) LEFT JOIN terminals USING (v) GROUP BY 1)
SELECT scenario, count(r.v) AS reachable_pairs, CASE WHEN any_value(possible) > 0 THEN count(r.v) / any_value(possible)::DOUBLE ELSE 0 END AS fraction
FROM sizes LEFT JOIN (SELECT * FROM reach JOIN targets USING (v)) r USING (scenario) GROUP BY 1""")
def _(spark, sf):
    graph = G.switch(spark, sf, SPARSE)
    return reach.reach_fraction(graph, class_scenarios(graph), class_removals(graph))


@query("rc3_reach_relation", f"{SWITCH3}, {REACH} SELECT scenario, s, v AS m FROM reach JOIN targets USING (v)")
def _(spark, sf):
    graph = G.switch(spark, sf, SPARSE)
    return reach.reach_relation(graph, class_scenarios(graph), class_removals(graph))


WALKS = """walk(s, v, dist) AS (SELECT v, v, 0 FROM sources UNION SELECT w.s, e.dst, w.dist + 1 FROM walk w JOIN edges e ON w.v = e.src WHERE w.dist < 14),
dists AS MATERIALIZED (SELECT s, v, min(dist) AS dist FROM walk GROUP BY ALL)"""


@query("rc4_distances", f"{SWITCH3}, {WALKS} SELECT s, v, dist::INTEGER AS dist FROM dists")
def _(spark, sf):
    graph = G.switch(spark, sf, SPARSE)
    return reach.distances(graph, reach.intact_scenario(graph)).drop("scenario")


@query("rc5_cut_off", f"{SWITCH3}, {LIVE}, seen(scenario, v) AS (SELECT scenario, v FROM live JOIN sources USING (v) UNION SELECT r.scenario, e.dst FROM seen r JOIN edges e ON r.v = e.src JOIN live l ON l.scenario = r.scenario AND l.v = e.dst) "
       "SELECT scenario, v FROM live EXCEPT SELECT scenario, v FROM seen")
def _(spark, sf):
    graph = G.switch(spark, sf, SPARSE)
    return reach.cut_off(graph, class_scenarios(graph), class_removals(graph))


SWITCH_TRIALS = 2


@G.remembered
def switch_runs(spark, sf):
    """(scenarios, batches, removed) on the switch graph: two random orders and the two static strength orders."""
    graph = G.switch(spark, sf)
    batches = settle(ranking.schedule_table(spark, graph.size, G.BATCH))
    order = removal.static_order(G.run_scores(graph, SWITCH_TRIALS), G.RUN_SEED, graph.size)
    removed = settle(ranking.batch_of_rank(order, batches).select("scenario", "v", "batch"))
    return settle(removed.select("scenario").distinct()), batches, removed


SWITCH_RUNS = f"{SWITCH}, {G.schedule_sql()}, {G.orders_sql(SWITCH_TRIALS)}, alive AS MATERIALIZED (SELECT s.scenario, b.batch, v.v FROM scenarios s CROSS JOIN schedule b CROSS JOIN vertices v LEFT JOIN removed r ON r.scenario = s.scenario AND r.v = v.v WHERE coalesce(r.batch, 100000) > b.batch)"


@query("rc6_disconnection", f"""{SWITCH_RUNS}, seen(scenario, batch, v) AS (SELECT scenario, batch, v FROM alive JOIN sources USING (v)
UNION SELECT r.scenario, r.batch, e.dst FROM seen r JOIN edges e ON r.v = e.src JOIN alive a ON a.scenario = r.scenario AND a.batch = r.batch AND a.v = e.dst),
dark AS (SELECT scenario, v, min(batch) AS silenced_at FROM (SELECT scenario, batch, v FROM alive EXCEPT SELECT scenario, batch, v FROM seen) GROUP BY ALL)
SELECT s.scenario, v.v, r.batch::INTEGER AS removed_at, d.silenced_at::INTEGER AS silenced_at FROM scenarios s CROSS JOIN vertices v LEFT JOIN removed r ON r.scenario = s.scenario AND r.v = v.v LEFT JOIN dark d ON d.scenario = s.scenario AND d.v = v.v""")
def _(spark, sf):
    scenarios, _, removed = switch_runs(spark, sf)
    return reach.disconnection(G.switch(spark, sf), scenarios, removed)


@query("rc7_pair_curve", f"""{SWITCH_RUNS}, seen(scenario, batch, s, v) AS (SELECT scenario, batch, v, v FROM alive JOIN sources USING (v)
UNION SELECT r.scenario, r.batch, r.s, e.dst FROM seen r JOIN edges e ON r.v = e.src JOIN alive a ON a.scenario = r.scenario AND a.batch = r.batch AND a.v = e.dst)
SELECT s.scenario, b.batch, count(t.v) AS reachable_pairs FROM scenarios s CROSS JOIN schedule b LEFT JOIN (SELECT * FROM seen JOIN targets USING (v)) t ON t.scenario = s.scenario AND t.batch = b.batch GROUP BY ALL""")
def _(spark, sf):
    scenarios, batches, removed = switch_runs(spark, sf)
    return reach.pair_curve(G.switch(spark, sf), scenarios, batches, removed)


# ---- flow -----------------------------------------------------------------------------------------------------------

GONE_FLOW = """gone_deaths AS (SELECT DISTINCT scenario, src, dst FROM {gone} g JOIN edges e ON g.v = e.src OR g.v = e.dst),
alive_counts AS (SELECT s.scenario, CASE WHEN e.src LIKE 'P|%' THEN e.src ELSE e.dst END AS mid, count(*) FILTER (WHERE e.dst LIKE 'P|%') AS ins, count(*) FILTER (WHERE e.src LIKE 'P|%') AS outs
FROM (SELECT DISTINCT scenario FROM {gone}) s CROSS JOIN edges e LEFT JOIN gone_deaths d ON d.scenario = s.scenario AND d.src = e.src AND d.dst = e.dst WHERE d.src IS NULL GROUP BY ALL),
gone_flow AS MATERIALIZED (SELECT s.scenario, coalesce(sum(least(ins, outs)), 0)::BIGINT AS flow FROM (SELECT DISTINCT scenario FROM {gone}) s LEFT JOIN alive_counts USING (scenario) GROUP BY ALL),
whole AS (SELECT sum(least(ins, outs))::BIGINT AS intact FROM (SELECT CASE WHEN src LIKE 'P|%' THEN src ELSE dst END AS mid, count(*) FILTER (WHERE dst LIKE 'P|%') AS ins, count(*) FILTER (WHERE src LIKE 'P|%') AS outs FROM edges GROUP BY ALL))"""
CLASS_FLOW = f"{TRADE}, gone AS (SELECT class AS scenario, v FROM vertices), {GONE_FLOW.format(gone='gone')}"


@query("fl1_flow_layered", f"{CLASS_FLOW} SELECT scenario, flow FROM gone_flow")
def _(spark, sf):
    graph = G.trade(spark, sf)
    return flow.flow_values(graph, class_scenarios(graph), class_removals(graph))


@query("fl1_flow_general", f"{CLASS_FLOW} SELECT scenario, flow FROM gone_flow")
def _(spark, sf):
    """The augmentation rounds on the same graph must give the closed form."""
    graph = G.trade(spark, sf)
    return flow.max_flow(graph, class_scenarios(graph), class_removals(graph)).value


@query("fl2_min_cut", f"{CLASS_FLOW} SELECT scenario, flow, flow AS cut, flow AS target_load FROM gone_flow")
def _(spark, sf):
    graph = G.trade(spark, sf)
    return certificate(graph, class_scenarios(graph), class_removals(graph))


def certificate(graph, scenarios, removed):
    """(scenario, flow, cut, target_load): three independent counts that must agree."""
    found = flow.max_flow(graph, scenarios, removed)
    cut = flow.min_cut(graph, found, scenarios, removed).groupBy("scenario").agg(F.count(F.lit(1)).alias("cut"))
    load = flow.route_load(found).join(graph.targets, "v", "left_semi").groupBy("scenario").agg(F.sum("load").alias("target_load"))
    return found.value.join(cut, "scenario", "left").join(load, "scenario", "left").na.fill(0, ["cut", "target_load"])


@query("fl2_cyclic_certificate")
def _(spark, sf):
    """Flow and minimum cut of the cyclic handover graph (SQL has no counterpart; the two counts must agree)."""
    graph = G.handover(spark, sf)
    scenarios = reach.intact_scenario(graph)
    found = flow.max_flow(graph, scenarios)
    cut = flow.min_cut(graph, found, scenarios).groupBy("scenario").agg(F.count(F.lit(1)).alias("cut"))
    return found.value.join(cut, "scenario")


# ---- centralities ---------------------------------------------------------------------------------------------------

# Summed movement at which the scores of a query stop; results are compared to nine places.
CONVERGED = 1e-13


@query("ct3_pagerank", f"{SWITCH}, {G.pagerank_sql()} SELECT v, round(score, 9) AS score FROM pagerank")
def _(spark, sf):
    return central.pagerank(G.switch(spark, sf), tolerance=CONVERGED).select("v", F.round("score", 9).alias("score"))


def betweenness_sql(name: str, restricted: bool, depth: int = 12) -> str:
    """Path counts of growing length; the first length that reaches a vertex gives distance and path count."""
    starts = "sources" if restricted else "vertices"
    p = name
    text = f"{p}0 AS (SELECT v AS s, v, 1.0::DOUBLE AS c FROM vertices)"
    for i in range(1, depth + 1):
        text += f", {p}{i} AS MATERIALIZED (SELECT w.s, e.dst AS v, sum(w.c) AS c FROM {p}{i - 1} w JOIN edges e ON w.v = e.src GROUP BY ALL)"
    union = " UNION ALL ".join(f"SELECT {i} AS d, s, v, c FROM {p}{i}" for i in range(depth + 1))
    goals = "JOIN targets g ON g.v = st.v" if restricted else ""
    return text + f""", {p}sp AS MATERIALIZED (SELECT s, v, min(d) AS d, arg_min(c, d) AS c FROM ({union}) GROUP BY ALL),
{p} AS MATERIALIZED (SELECT x.v, coalesce(y.score, 0.0) AS score FROM vertices x LEFT JOIN (
SELECT a.v, sum(a.c * b.c / st.c) AS score FROM {p}sp st JOIN {starts} q ON q.v = st.s {goals} JOIN {p}sp a ON a.s = st.s AND a.v <> st.s AND a.v <> st.v
JOIN {p}sp b ON b.s = a.v AND b.v = st.v WHERE st.s <> st.v AND a.d + b.d = st.d GROUP BY a.v) y USING (v))"""


@query("ct4_betweenness", f"{SWITCH3}, {betweenness_sql('bt', False, 16)} SELECT v, round(score, 7) AS score FROM bt")
def _(spark, sf):
    return central.betweenness(G.switch(spark, sf, SPARSE), source_blocks=2).select("v", F.round("score", 7).alias("score"))


@query("ct4_betweenness_estimate", f"{SWITCH}, {betweenness_sql('bt', False, 16)} SELECT v, round(score, 7) AS score, true AS within FROM bt")
def _(spark, sf):
    """Exact scores, and whether the estimate from drawn starts keeps its bound at every vertex."""
    graph = G.switch(spark, sf)
    drawn = central.betweenness_estimate(graph, 0.2, seed=7, first=16).select("v", F.col("score").alias("drawn"), "bound")
    within = (F.abs(F.col("score") - F.col("drawn")) <= F.col("bound") + 1e-6).alias("within")
    return central.betweenness(graph).join(drawn, "v").select("v", F.round("score", 7).alias("score"), within)


@query("ct5_restricted_betweenness", f"{SWITCH}, {betweenness_sql('sm', True)} SELECT v, round(score, 7) AS score FROM sm")
def _(spark, sf):
    return central.betweenness(G.switch(spark, sf), restricted=True).select("v", F.round("score", 7).alias("score"))


SCORES_CTE = f"""{G.pagerank_sql()}, {betweenness_sql('sm', True)}, {betweenness_sql('bt', False)},
deg AS (SELECT v, count(*) AS degree FROM (SELECT src AS v FROM edges UNION ALL SELECT dst FROM edges) GROUP BY v),
scores AS MATERIALIZED (SELECT v, coalesce(degree, 0) AS degree, round(p.score, 9) AS pagerank, round(s.score, 7) AS sm_betweenness, round(b.score, 7) AS betweenness
FROM vertices LEFT JOIN deg USING (v) JOIN pagerank p USING (v) JOIN sm s USING (v) JOIN bt b USING (v))"""
PCT = "100.0::DOUBLE * (rank() OVER (ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {c}) + 1) / 2.0::DOUBLE - 0.5::DOUBLE) / count(*) OVER () AS {c}_pct"
PERCENTILES_CTE = SCORES_CTE + ", pcts AS MATERIALIZED (SELECT *, " + ", ".join(PCT.format(c=c) for c in ("degree", "pagerank", "sm_betweenness")) + " FROM scores)"


@G.remembered
def switch_scores(spark, sf):
    table = central.score_table(G.switch(spark, sf), tolerance=CONVERGED)
    return settle(table.select("v", F.col("degree").cast("long").alias("degree"), F.round("pagerank", 9).alias("pagerank"), F.round("sm_betweenness", 7).alias("sm_betweenness"), F.round("betweenness", 7).alias("betweenness")))


@query("ct6_score_table", f"{SWITCH}, {SCORES_CTE} SELECT * FROM scores")
def _(spark, sf):
    return switch_scores(spark, sf)


@query("ct8_percentiles", f"{SWITCH}, {PERCENTILES_CTE} SELECT v, degree_pct, pagerank_pct, sm_betweenness_pct FROM pcts")
def _(spark, sf):
    table = central.percentile_table(switch_scores(spark, sf), ["degree", "pagerank", "sm_betweenness"])
    return table.select("v", "degree_pct", "pagerank_pct", "sm_betweenness_pct")


@query("pf8_bottleneck_candidates", f"{SWITCH}, {PERCENTILES_CTE} SELECT v, degree, sm_betweenness FROM pcts WHERE degree_pct < 50 AND pagerank_pct < 50 AND sm_betweenness_pct >= 60")
def _(spark, sf):
    table = central.percentile_table(switch_scores(spark, sf), ["degree", "pagerank", "sm_betweenness"])
    return central.bottleneck_candidates(table, 50.0, 60.0).select("v", "degree", "sm_betweenness")


def coreness_sql(steps: int = 25) -> str:
    text = """links AS MATERIALIZED (SELECT src AS v, dst AS u FROM edges UNION SELECT dst, src FROM edges),
h0 AS MATERIALIZED (SELECT v, count(*) AS k FROM links GROUP BY v)"""
    for i in range(1, steps + 1):
        text += f""",
h{i} AS MATERIALIZED (SELECT v, max(least(k, r)) AS k FROM (SELECT l.v, h.k, row_number() OVER (PARTITION BY l.v ORDER BY h.k DESC) AS r FROM links l JOIN h{i - 1} h ON h.v = l.u) GROUP BY v)"""
    return text + f", cores AS (SELECT x.v, coalesce(k, 0)::INTEGER AS coreness FROM vertices x LEFT JOIN h{steps} USING (v))"


@query("ct7_coreness", f"{SWITCH3}, {coreness_sql()} SELECT v, coreness FROM cores")
def _(spark, sf):
    graph = G.switch(spark, sf, SPARSE)
    return central.coreness(graph.edges, graph.vertices)


@query("ag19_coreness_histogram", f"{SWITCH3}, {coreness_sql()} SELECT coreness, count(*) AS vertices, coreness = (SELECT max(coreness) FROM cores) AS deepest FROM cores GROUP BY coreness")
def _(spark, sf):
    graph = G.switch(spark, sf, SPARSE)
    return central.coreness_histogram(settle(central.coreness(graph.edges, graph.vertices)))


@query("str_spearman", f"""{SWITCH3}, {coreness_sql()}, both_scores AS (SELECT v, coreness AS a, coalesce(w, 0) AS b FROM cores LEFT JOIN (SELECT src AS v, sum(weight) AS w FROM edges GROUP BY 1) USING (v)),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM both_scores) SELECT round(corr(x, y), 9) AS rho FROM r""")
def _(spark, sf):
    graph = G.switch(spark, sf, SPARSE)
    table = central.coreness(graph.edges, graph.vertices).join(central.strategy_scores("out_strength", graph), "v")
    return stats.spearman(settle(table.select("coreness", "score")), [], "coreness", "score").select(F.round("rho", 9).alias("rho"))


# ---- knock-outs -----------------------------------------------------------------------------------------------------

TRADE_PAIRS = """via AS MATERIALIZED (SELECT a.src AS s, a.dst AS i, b.dst AS m FROM edges a JOIN edges b ON a.dst = b.src),
lone AS MATERIALIZED (SELECT s, m, min(i) AS i FROM via GROUP BY s, m HAVING count(*) = 1),
whole_pairs AS (SELECT DISTINCT s, m FROM via),
lost AS (SELECT v, count(*) AS pairs_lost FROM (SELECT i AS v FROM lone UNION ALL SELECT s FROM whole_pairs UNION ALL SELECT m FROM whole_pairs) GROUP BY v)"""


@query("ko1_single_scan", f"""{TRADE}, gone AS (SELECT v AS scenario, v FROM vertices), {GONE_FLOW.format(gone='gone')}, {TRADE_PAIRS}
SELECT scenario AS v, flow, intact - flow AS flow_drop, (SELECT count(*) FROM whole_pairs) - coalesce(pairs_lost, 0) AS reachable_pairs, coalesce(pairs_lost, 0) AS pairs_lost FROM gone_flow CROSS JOIN whole LEFT JOIN lost ON lost.v = scenario""")
def _(spark, sf):
    return trade_scan(spark, sf)


@G.remembered
def trade_scan(spark, sf):
    return settle(K.single_scan(G.trade(spark, sf)))


POOL = 250
POOL_CTE = f"""{TRADE}, one AS (SELECT v AS scenario, v FROM vertices), {GONE_FLOW.format(gone='one').replace('gone_', 'one_').replace('alive_counts', 'one_alive')},
deg AS (SELECT v, count(*) AS degree FROM (SELECT src AS v FROM edges UNION ALL SELECT dst FROM edges) GROUP BY v),
via AS MATERIALIZED (SELECT a.src AS s, a.dst AS i, b.dst AS m FROM edges a JOIN edges b ON a.dst = b.src),
routes AS (SELECT s, m, count(*) AS c FROM via GROUP BY ALL), middles AS (SELECT i AS v, round(sum(1.0::DOUBLE / c), 9) AS b FROM via JOIN routes USING (s, m) GROUP BY i),
scored AS (SELECT v, intact - flow AS flow_drop, CASE WHEN degree > 0 THEN (intact - flow) / degree::DOUBLE ELSE 0 END AS impact_per_edge, coalesce(b, 0.0) AS sm_betweenness
FROM vertices JOIN one_flow ON scenario = v CROSS JOIN whole LEFT JOIN deg USING (v) LEFT JOIN middles USING (v)),
pool AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY impact_per_edge DESC, sm_betweenness DESC, v)::INTEGER AS pool_rank FROM scored ORDER BY pool_rank LIMIT {POOL}),
pool_pairs AS MATERIALIZED (SELECT a.v AS a, b.v AS b, a.flow_drop AS drop_a, b.flow_drop AS drop_b, concat(a.v, '#', b.v) AS scenario FROM pool a JOIN pool b ON a.pool_rank < b.pool_rank)"""


@G.remembered
def trade_pool(spark, sf):
    """The pool from the flow drops of single knock-outs, degrees and restricted betweenness of the same graph."""
    graph = G.trade(spark, sf)
    drops = K.flow_drops(graph, K.each_vertex(graph.vertices)).select(F.col("scenario").alias("v"), "flow_drop")
    middle = central.betweenness(graph, restricted=True).select("v", F.round("score", 9).alias("sm_betweenness"))
    return settle(K.candidate_pool(drops.join(B.degrees(graph.edges, graph.vertices), "v").join(middle, "v"), POOL))


@query("w15_candidate_pool", f"{POOL_CTE} SELECT v, flow_drop, impact_per_edge, sm_betweenness, pool_rank FROM pool")
def _(spark, sf):
    return trade_pool(spark, sf)


@query("j8_pool_pairs", f"{POOL_CTE} SELECT a, b, drop_a, drop_b FROM pool_pairs")
def _(spark, sf):
    return K.pool_pairs(trade_pool(spark, sf), POOL)


@query("ko2_pair_synergy", f"""{POOL_CTE}, two AS MATERIALIZED (SELECT scenario, a AS v FROM pool_pairs UNION ALL SELECT scenario, b FROM pool_pairs), {GONE_FLOW.format(gone='two').rsplit(', whole AS', 1)[0].rsplit(',' + chr(10) + 'whole AS', 1)[0].replace('gone_', 'two_').replace('alive_counts', 'two_alive')}
SELECT a, b, drop_a, drop_b, flow AS flow_after, intact - flow AS joint_impact, intact - flow - drop_a - drop_b AS synergy FROM pool_pairs JOIN two_flow USING (scenario) CROSS JOIN whole""")
def _(spark, sf):
    return K.pair_synergy(G.trade(spark, sf), trade_pool(spark, sf), POOL)


@query("ko3_group_impact", f"""{TRADE}, sizes AS (SELECT class AS grp, count(*) AS size, count(*) FILTER (WHERE role = 'S') AS n_sources, count(*) FILTER (WHERE role = 'M') AS n_targets FROM vertices GROUP BY class),
{G.draws_sql(200, 9)},
gone AS MATERIALIZED (SELECT concat('group|', class) AS scenario, v FROM vertices UNION ALL SELECT concat('draw|', size, '|', draw), v FROM draws), {GONE_FLOW.format(gone='gone')},
seen AS (SELECT grp AS "group", size, n_sources, n_targets, flow AS flow_after, 1 - flow / intact::DOUBLE AS flow_drop FROM sizes JOIN gone_flow ON scenario = concat('group|', grp) CROSS JOIN whole),
nul AS (SELECT split_part(scenario, '|', 2)::BIGINT AS size, 1 - flow / intact::DOUBLE AS d FROM gone_flow CROSS JOIN whole WHERE scenario LIKE 'draw|%')
SELECT "group", size::INTEGER AS size, n_sources, n_targets, flow_after, round(flow_drop, 9) AS flow_drop, (1 + count(*) FILTER (WHERE d >= flow_drop)) / (1 + count(*))::DOUBLE AS p_value,
round(avg(d), 9) AS random_mean, round(stddev_samp(d), 9) AS random_sd, round(flow_drop - avg(d), 9) AS excess FROM seen JOIN nul USING (size) GROUP BY "group", size, n_sources, n_targets, flow_after, flow_drop""")
def _(spark, sf):
    graph = G.trade(spark, sf)
    table = K.group_impact(graph, graph.vertices.select(F.col("class").alias("group"), "v"), 200, 9)
    return table.select("group", "size", "n_sources", "n_targets", "flow_after", "p_value", *[F.round(c, 9).alias(c) for c in ("flow_drop", "random_mean", "random_sd", "excess")])


SIDED = R + G.trade_sql(0.01, G.SIDED_LABEL)
BILATERAL_CTE = f"""{SIDED}, lab AS (SELECT left(v, length(v) - 2) AS label, right(v, 1) AS side, v FROM vertices WHERE v LIKE 'P|%'),
gone AS MATERIALIZED (SELECT concat(label, '~', side) AS scenario, v FROM lab UNION ALL SELECT concat(label, '~both'), v FROM lab), {GONE_FLOW.format(gone='gone')},
impacts AS (SELECT split_part(scenario, '~', 1) AS label, split_part(scenario, '~', 2) AS kind, intact - flow AS d FROM gone_flow CROSS JOIN whole),
bilateral AS MATERIALIZED (SELECT label, max(d) FILTER (WHERE kind = 'L') AS impact_left, max(d) FILTER (WHERE kind = 'R') AS impact_right, max(d) FILTER (WHERE kind = 'both') AS impact_both FROM impacts GROUP BY label)"""


@G.remembered
def bilateral(spark, sf):
    graph = G.sided(spark, sf)
    return settle(K.bilateral_impact(graph, graph.vertices.select("v", "label", "side")))


@query("ko4_bilateral", f"{BILATERAL_CTE} SELECT label, impact_left, impact_right, impact_both, (impact_left + impact_right) / 2.0::DOUBLE AS single_mean, impact_both - impact_left - impact_right AS superadditivity FROM bilateral")
def _(spark, sf):
    return bilateral(spark, sf)


@query("ko4_additivity", f"""{BILATERAL_CTE}, inf AS (SELECT *, impact_both - impact_left - impact_right AS x FROM bilateral WHERE impact_left <> 0 OR impact_right <> 0 OR impact_both <> 0)
SELECT count(*) AS informative, count(*) FILTER (WHERE x > 0) AS superadditive, count(*) FILTER (WHERE x = 0) AS additive, count(*) FILTER (WHERE x < 0) AS subadditive,
count(*) FILTER (WHERE impact_left = 0 AND impact_right = 0 AND impact_both > 0) AS insured FROM inf""")
def _(spark, sf):
    return K.additivity_counts(bilateral(spark, sf))


@query("ko5_detours", f"""{SWITCH3}, {LIVE}, {WALKS},
swalk(scenario, s, v, dist) AS (SELECT scenario, v, v, 0 FROM live JOIN sources USING (v) UNION SELECT w.scenario, w.s, e.dst, w.dist + 1 FROM swalk w JOIN edges e ON w.v = e.src JOIN live l ON l.scenario = w.scenario AND l.v = e.dst WHERE w.dist < 14),
after AS (SELECT scenario, s, v, min(dist) AS far FROM swalk GROUP BY ALL)
SELECT sc.scenario, count(*) AS pairs, count(*) FILTER (WHERE far IS NULL) AS pairs_lost, count(*) FILTER (WHERE far > d.dist) AS pairs_longer
FROM scenarios sc CROSS JOIN (SELECT * FROM dists JOIN targets USING (v)) d LEFT JOIN after a ON a.scenario = sc.scenario AND a.s = d.s AND a.v = d.v GROUP BY 1""")
def _(spark, sf):
    graph = G.switch(spark, sf, SPARSE)
    return K.detour_detail(graph, class_removals(graph))


PARTNER_LIST = """SELECT {end} AS v, string_agg(concat({other}, '/', class), ',' ORDER BY rank) AS p FROM
(SELECT {end}, {other}, row_number() OVER (PARTITION BY {end} ORDER BY weight DESC, {other}) AS rank FROM edges) JOIN vertices ON v = {other} WHERE rank <= 5 GROUP BY 1"""


@query("ko5_knockout_detail", f"""{TRADE}, gone AS (SELECT v AS scenario, v FROM vertices), {GONE_FLOW.format(gone='gone')}, {TRADE_PAIRS},
routes AS (SELECT s, m, count(*) AS c FROM via GROUP BY ALL), middles AS (SELECT i AS v, sum(1.0::DOUBLE / c) AS b FROM via JOIN routes USING (s, m) GROUP BY i),
ins AS (SELECT dst AS v, count(*) AS k FROM edges GROUP BY 1), outs AS (SELECT src AS v, count(*) AS k FROM edges GROUP BY 1),
scored AS (SELECT v, round(coalesce(b, 0.0), 7) AS b FROM vertices LEFT JOIN middles USING (v)), pairs AS (SELECT count(*) AS n FROM whole_pairs)
SELECT v, coalesce(ins.k, 0) AS in_degree, coalesce(outs.k, 0) AS out_degree, coalesce(ins.k, 0) + coalesce(outs.k, 0) AS degree, b AS sm_betweenness, rank() OVER (ORDER BY b DESC) AS sm_betweenness_rank,
n AS reachable_pairs, round(b / n, 9) AS share_of_shortest_routes, coalesce(pairs_lost, 0) AS pairs_lost, 0::BIGINT AS pairs_longer, intact AS intact_flow, flow AS flow_after,
coalesce(i.p, '') AS strongest_inputs, coalesce(o.p, '') AS strongest_outputs
FROM scored JOIN gone_flow ON scenario = v CROSS JOIN whole CROSS JOIN pairs LEFT JOIN lost USING (v) LEFT JOIN ins USING (v) LEFT JOIN outs USING (v)
LEFT JOIN ({PARTNER_LIST.format(end='dst', other='src')}) i USING (v) LEFT JOIN ({PARTNER_LIST.format(end='src', other='dst')}) o USING (v)""")
def _(spark, sf):
    """Every vertex of the trade graph; all routes there have two steps, so none gets longer (ko5_detours has a cyclic graph)."""
    graph = G.trade(spark, sf)
    middle = settle(central.betweenness(graph, restricted=True).select("v", F.round("score", 7).alias("sm_betweenness")))
    table = K.knockout_detail(graph, graph.vertices, restricted=middle)
    shown = lambda name: F.array_join(F.transform(name, lambda x: F.concat_ws("/", x["partner"], x["class"])), ",").alias(name)
    return table.withColumns({"share_of_shortest_routes": F.round("share_of_shortest_routes", 9)}).select(
        *[c for c in table.columns if not c.startswith("strongest")], shown("strongest_inputs"), shown("strongest_outputs")
    )


LOSS_CTE = f"""{SWITCH3}, base(s, v) AS (SELECT v, v FROM sources UNION SELECT b.s, e.dst FROM base b JOIN edges e ON b.v = e.src),
relation AS MATERIALIZED (SELECT s, v AS m FROM base JOIN targets USING (v)),
cut(x, s, v) AS (SELECT x.v, s.v, s.v FROM vertices x CROSS JOIN sources s WHERE x.v <> s.v UNION SELECT c.x, c.s, e.dst FROM cut c JOIN edges e ON c.v = e.src WHERE e.dst <> c.x),
losses AS MATERIALIZED (SELECT x.v, r.s, r.m FROM vertices x CROSS JOIN relation r LEFT JOIN cut c ON c.x = x.v AND c.s = r.s AND c.v = r.m WHERE c.x IS NULL AND x.v <> r.s AND x.v <> r.m)"""


@G.remembered
def switch_losses(spark, sf):
    graph = G.switch(spark, sf, SPARSE)
    relation = settle(reach.reach_relation(graph, reach.intact_scenario(graph)).select("s", "m"))
    return settle(K.lost_pairs(graph)), relation


@query("dm1_lost_pairs", f"{LOSS_CTE} SELECT v, s, m FROM losses")
def _(spark, sf):
    return switch_losses(spark, sf)[0]


@query("dm2_cross_check", f"""{LOSS_CTE}, counts AS (SELECT v, count(*) AS k FROM (SELECT v FROM losses UNION ALL SELECT s FROM relation UNION ALL SELECT m FROM relation) GROUP BY v)
SELECT v, coalesce(k, 0) AS listed, coalesce(k, 0) AS deleted FROM vertices LEFT JOIN counts USING (v)""")
def _(spark, sf):
    graph = G.switch(spark, sf, SPARSE)
    losses, relation = switch_losses(spark, sf)
    return K.loss_counts_twice(graph, losses, relation, graph.vertices.select("v"))


@query("ag17_loss_summary", f"""{LOSS_CTE}, own AS (SELECT v, count(*) AS own_pairs FROM (SELECT s AS v FROM relation UNION ALL SELECT m FROM relation) GROUP BY v),
others AS (SELECT v, count(*) AS other_pairs, count(DISTINCT s) AS sources_cut, count(DISTINCT m) AS targets_cut FROM losses GROUP BY v)
SELECT v, CASE role WHEN 'S' THEN 'source' WHEN 'M' THEN 'target' ELSE 'other' END AS role, coalesce(own_pairs, 0) + coalesce(other_pairs, 0) AS pairs_lost, coalesce(own_pairs, 0) AS own_pairs,
coalesce(other_pairs, 0) AS other_pairs, coalesce(sources_cut, 0) AS sources_cut, coalesce(targets_cut, 0) AS targets_cut FROM own FULL JOIN others USING (v) LEFT JOIN terminals USING (v)""")
def _(spark, sf):
    losses, relation = switch_losses(spark, sf)
    return K.loss_summary(G.switch(spark, sf, SPARSE), losses, relation)


@query("ag18_grouped_losses", f"""{LOSS_CTE}, rk AS (SELECT v AS m, row_number() OVER (ORDER BY v) AS r FROM targets), reach_of AS (SELECT s, count(*) AS reach FROM relation GROUP BY s)
SELECT v, s, any_value(reach) AS reach, count(*) AS lost, array_to_string((list(m ORDER BY r))[1:12], ',') AS shown FROM losses JOIN rk USING (m) JOIN reach_of USING (s) GROUP BY v, s""")
def _(spark, sf):
    graph = G.switch(spark, sf, SPARSE)
    losses, relation = switch_losses(spark, sf)
    order = K.target_order(graph, graph.vertices, ["purchase"])
    return K.grouped_losses(losses, relation, order).withColumn("shown", F.array_join("shown", ","))


@query("dq5_knockouts", "SELECT n AS \"check\", 0::BIGINT AS violations, 'OK' AS status FROM (VALUES " + ", ".join(f"('{n}')" for n in checks.KNOCKOUT_CHECKS) + ") t(n)")
def _(spark, sf):
    graph = G.trade(spark, sf)
    pairs = reach.reachable_pair_counts(graph, reach.intact_scenario(graph)).first()["reachable_pairs"]
    return checks.report(checks.check_knockouts(trade_scan(spark, sf), graph.vertices, K.intact_flow(graph), pairs), checks.KNOCKOUT_CHECKS)


# ---- adaptive removal, compartments, null models --------------------------------------------------------------------


def adaptive_sql(strategy: str, near: str, scores: str | None = None) -> str:
    """Vertices of every batch of an adaptive run: the state of a batch holds all vertices, those alive are scored anew."""
    scores = scores or f"""SELECT e.{near} AS v, sum(e.weight) AS score FROM edges e JOIN state_{strategy} a ON a.v = e.src AND a.gone IS NULL
JOIN state_{strategy} b ON b.v = e.dst AND b.gone IS NULL GROUP BY 1"""
    return f"""state_{strategy}(step, v, gone) AS (SELECT 0, v, NULL::INTEGER FROM vertices UNION ALL
SELECT step + 1, v, CASE WHEN gone IS NOT NULL THEN gone WHEN place <= size THEN step + 1 END FROM (
  SELECT s.step, s.v, s.gone, row_number() OVER (PARTITION BY s.gone IS NULL ORDER BY coalesce(x.score, 0) DESC, md5(concat('17|', s.step + 1, '|', s.v))) AS place
  FROM state_{strategy} s LEFT JOIN ({scores}) x USING (v)) JOIN schedule ON batch = step + 1),
order_{strategy} AS (SELECT '{strategy}' AS strategy, v, gone AS batch FROM state_{strategy} WHERE step = (SELECT max(batch) FROM schedule) AND gone IS NOT NULL)"""


@query("rm2_adaptive_orders", f"""{TRADE}, {G.schedule_sql()}, {adaptive_sql('out_strength', 'src')}, {adaptive_sql('in_strength', 'dst')}
SELECT strategy, v, batch FROM order_out_strength UNION ALL SELECT strategy, v, batch FROM order_in_strength""")
def _(spark, sf):
    """Batches of both adaptive strength runs at 1 %."""
    graph = G.trade(spark, sf)
    runs = None
    for strategy in ("out_strength", "in_strength"):
        order = removal.adaptive_removals(graph, strategy, reach.intact_scenario(graph), 17, G.BATCH).select(F.lit(strategy).alias("strategy"), "v", "batch")
        runs = order if runs is None else runs.unionByName(order)
    return runs


@query("rm2_adaptive_out_strength")
def _(spark, sf):
    """At 1 %, going on past half of the vertices until no flow is left."""
    graph = G.trade(spark, sf)
    return removal.percolate(graph, "out_strength", reach.intact_scenario(graph), 17, G.BATCH, continue_until_flow_below=1, layered=True)


@query("rm2_adaptive_restricted_betweenness")
def _(spark, sf):
    return removal.percolate(G.trade(spark, sf), "sm_betweenness", reach.intact_scenario(G.trade(spark, sf)), 17, 0.2, layered=True)


COMPARTMENT_CTE = f"""{TRADE}, by_status AS (SELECT v, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS o, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS f FROM (
SELECT unnest([{G.CUSTOMER_LABEL}, {G.PART_LABEL}, {G.SUPPLIER_LABEL}]) AS v, l_quantity, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY v),
comp AS (SELECT v, CASE WHEN o > f THEN 'O' WHEN o < f THEN 'F' END AS c FROM by_status)"""


@query("rm7_compartments", f"""{COMPARTMENT_CTE}, sub AS (SELECT a.c, e.src, e.dst FROM edges e JOIN comp a ON a.v = e.src JOIN comp b ON b.v = e.dst WHERE a.c = b.c),
mid AS (SELECT c, CASE WHEN src LIKE 'P|%' THEN src ELSE dst END AS mid, count(*) FILTER (WHERE dst LIKE 'P|%') AS ins, count(*) FILTER (WHERE src LIKE 'P|%') AS outs FROM sub GROUP BY ALL),
prs AS (SELECT c, count(*) AS pairs FROM (SELECT DISTINCT a.c, a.src, b.dst FROM sub a JOIN sub b ON a.dst = b.src AND a.c = b.c) GROUP BY c)
SELECT c AS compartment, (SELECT count(*) FROM comp x WHERE x.c = m.c) AS vertices, sum(least(ins, outs))::BIGINT AS flow, coalesce(any_value(pairs), 0) AS reachable_pairs FROM mid m LEFT JOIN prs USING (c) GROUP BY c""")
def _(spark, sf):
    """Each compartment's induced subgraph with its own terminals."""
    parts = None
    for name, sub in compartment_graphs(spark, sf).items():
        intact = reach.intact_scenario(sub)
        row = flow.flow_values(sub, intact).join(reach.reachable_pair_counts(sub, intact), "scenario").select(
            F.lit(name).alias("compartment"), F.lit(sub.size).cast("long").alias("vertices"), "flow", "reachable_pairs"
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts


@G.remembered
def compartment_graphs(spark, sf):
    from fraygraph.operators.profile import compartments

    graph = G.trade(spark, sf)
    lines = G.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus")
    buyers = G.table(spark, sf, "orders").join(G.table(spark, sf, "customer").selectExpr("c_custkey", f"{G.CUSTOMER_LABEL} AS b"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "b")
    lines = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(G.table(spark, sf, "part").selectExpr("p_partkey", f"{G.PART_LABEL} AS p"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(G.table(spark, sf, "supplier").selectExpr("s_suppkey", f"{G.SUPPLIER_LABEL} AS s"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = lines.select(F.explode(F.array("b", "p", "s")).alias("v"), F.col("l_linestatus").alias("compartment"), F.col("l_quantity").alias("count"))
    sides = settle(compartments(counts, graph.vertices, "O", "F").filter("compartment is not null").select("v", "compartment"))
    result = {}
    for name in ("O", "F"):
        members = settle(sides.filter(F.col("compartment") == name).select("v"))
        vertices = settle(graph.vertices.join(members, "v", "left_semi"))
        result[name] = B.Graph(vertices, settle(B.induced(graph.edges, members)), settle(graph.terminals.join(members, "v", "left_semi")))
    return result


NULLS = 3


@query("nm1_rewiring_invariants", f"""{SWITCH}, i AS (SELECT dst AS v, count(*) AS k FROM edges GROUP BY 1), o AS (SELECT src AS v, count(*) AS k, sum(weight)::BIGINT AS w FROM edges GROUP BY 1)
SELECT g::INTEGER AS g, v, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(o.w, 0) AS out_strength, 0::BIGINT AS loops, 0::BIGINT AS parallel FROM vertices CROSS JOIN range({NULLS}) r(g) LEFT JOIN i USING (v) LEFT JOIN o USING (v)""")
def _(spark, sf):
    """Every member keeps in-degree, out-degree and out-strength of every vertex and stays simple."""
    graph = G.switch(spark, sf)
    edges = nulls.rewire(graph.edges, NULLS, 23, swaps_per_edge=10)
    ends = F.array(
        F.struct(F.col("src").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.col("weight").alias("w")),
        F.struct(F.col("dst").alias("v"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).cast("long").alias("w")),
    )
    sums = edges.select("g", F.explode(ends).alias("e")).groupBy("g", "e.v").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.sum("e.w").alias("out_strength"))
    double = edges.groupBy("g", "src", "dst").agg(F.count(F.lit(1)).alias("k")).groupBy("g", F.col("src").alias("v")).agg(
        F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_if(F.col("k") > 1).alias("parallel")
    )
    everyone = graph.vertices.select("v", F.explode(F.sequence(F.lit(0), F.lit(NULLS - 1))).alias("g"))
    return everyone.join(sums, ["g", "v"], "left").join(double, ["g", "v"], "left").na.fill(0)


@query("w11_weight_multisets", f"{SWITCH} SELECT g::INTEGER AS g, src, weight, count(*) AS n FROM edges CROSS JOIN range(2) r(g) GROUP BY ALL")
def _(spark, sf):
    """Each source's weights after dealing them to rewired edges."""
    edges = G.switch(spark, sf).edges
    turned = edges.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("g"), "src", F.col("dst"))
    return nulls.reassign_weights(edges, turned, 2, 29).groupBy("g", "src", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("nm2_null_scores")
def _(spark, sf):
    """AUCs of random removal on two rewired trade graphs (general flow, two trials each)."""
    union = nulls.ensemble(G.trade(spark, sf), 2, 31, swaps_per_edge=2)
    return nulls.score_ensemble(nulls.random_ensemble_curves(union, 2, 2, 37, 0.2), "random")


# ---- distributions and rank tests -----------------------------------------------------------------------------------


def orders_per_customer(spark, sf):
    return G.table(spark, sf, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.count(F.lit(1)).alias("k"))


@query("ag14_histogram", """WITH e AS (SELECT o_orderstatus, min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 24 AS step FROM orders GROUP BY 1),
c AS (SELECT o_orderstatus, least(floor((o_totalprice - lo) / step), 23)::INTEGER AS bin, count(*) AS k FROM orders JOIN e USING (o_orderstatus) GROUP BY ALL)
SELECT o_orderstatus, bin::INTEGER AS bin, lo + bin * step AS low, step, coalesce(k, 0) AS count FROM e CROSS JOIN range(24) r(bin) LEFT JOIN c USING (o_orderstatus, bin)""")
def _(spark, sf):
    return curves.histogram(G.table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice")


@query("ag14_quantiles", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.025), 6) AS low, round(quantile_cont(o_totalprice, 0.5), 6) AS middle, round(quantile_cont(o_totalprice, 0.975), 6) AS high FROM orders GROUP BY 1")
def _(spark, sf):
    table = curves.quantiles(G.table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", [0.025, 0.5, 0.975])
    return table.select("o_orderstatus", *[F.round(F.col("quantiles")[i], 6).alias(n) for i, n in enumerate(("low", "middle", "high"))])


@query("ag15_ccdf", """WITH k AS (SELECT o_orderstatus, o_custkey, count(*) AS k FROM orders GROUP BY ALL)
SELECT DISTINCT o_orderstatus, k, (SELECT count(*) FROM k b WHERE b.o_orderstatus = a.o_orderstatus AND b.k >= a.k) / (SELECT count(*) FROM k b WHERE b.o_orderstatus = a.o_orderstatus)::DOUBLE AS p FROM k a""")
def _(spark, sf):
    return curves.ccdf(orders_per_customer(spark, sf), ["o_orderstatus"], "k")


@query("ag15_ccdf_grid", """WITH k AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1), e AS (SELECT min(q) AS lo, max(q) AS hi, count(*) AS n FROM k),
g AS (SELECT DISTINCT round_even(lo * pow(hi / lo, i / 39.0::DOUBLE), 0) AS "at", n FROM e, range(40) r(i))
SELECT 'part' AS kind, "at", (SELECT count(*) FROM k WHERE q >= "at") / n::DOUBLE AS p FROM g""")
def _(spark, sf):
    sums = G.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return curves.ccdf_on_grid(sums.withColumn("kind", F.lit("part")), ["kind"], "q", 40)


@query("stm_rank_test", """WITH t AS (SELECT o_orderstatus AS st, round_even(o_totalprice / 500, 0) AS x, o_orderpriority = '1-URGENT' AS m FROM orders),
r AS (SELECT *, rank() OVER (PARTITION BY st ORDER BY x) AS r0, count(*) OVER (PARTITION BY st, x) AS c, count(*) OVER (PARTITION BY st) AS n FROM t),
k AS (SELECT st, m, r0 + (c - 1) / 2.0::DOUBLE AS rk, 100.0::DOUBLE * (r0 + (c - 1) / 2.0::DOUBLE - 0.5::DOUBLE) / n AS pct, (c * c - 1) / 1.0::DOUBLE AS tie, n FROM r),
a AS (SELECT st, count(*) FILTER (WHERE m) AS a, count(*) FILTER (WHERE NOT m) AS b, sum(rk) FILTER (WHERE m) AS rs, sum(tie) AS tie, any_value(n) AS n, quantile_cont(pct, 0.5) FILTER (WHERE m) AS med FROM k GROUP BY st)
SELECT st AS o_orderstatus, a AS n_members, b AS n_other, rs - a * (a + 1) / 2.0::DOUBLE AS u, round((rs - a * (a + 1) / 2.0::DOUBLE) / (a * b), 9) AS auc, round(2 * (rs - a * (a + 1) / 2.0::DOUBLE) / (a * b) - 1, 9) AS rank_biserial,
round(med, 9) AS median_percentile, round((rs - a * (a + 1) / 2.0::DOUBLE - a * b / 2.0::DOUBLE - 0.5::DOUBLE) / sqrt(a * b / 12.0::DOUBLE * ((n + 1) - tie / (n * (n - 1.0::DOUBLE)))), 7) AS z FROM a""")
def _(spark, sf):
    rows = G.table(spark, sf, "orders").select("o_orderstatus", F.rint(F.col("o_totalprice") / 500).alias("x"), (F.col("o_orderpriority") == "1-URGENT").alias("m"))
    table = stats.mann_whitney(rows, ["o_orderstatus"], "x", "m")
    return table.select("o_orderstatus", "n_members", "n_other", "u", *[F.round(c, d).alias(c) for c, d in (("auc", 9), ("rank_biserial", 9), ("median_percentile", 9), ("z", 7))])


@query("sts_signed_rank", """WITH d AS (SELECT p_brand, round_even((sum(l_quantity) FILTER (WHERE l_linestatus = 'O') - sum(l_quantity) FILTER (WHERE l_linestatus = 'F')) / 10, 0) AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_suppkey),
r AS (SELECT p_brand, d, rank() OVER (PARTITION BY p_brand ORDER BY abs(d)) AS r0, count(*) OVER (PARTITION BY p_brand, abs(d)) AS c FROM d WHERE d <> 0),
s AS (SELECT p_brand, count(*) AS n, coalesce(sum(r0 + (c - 1) / 2.0::DOUBLE) FILTER (WHERE d > 0), 0) AS w, sum(c * c - 1)::DOUBLE AS tie FROM r GROUP BY 1)
SELECT p_brand, n AS pairs_differing, w, round((w - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tie / 48), 7) AS z FROM s""")
def _(spark, sf):
    lines = G.table(spark, sf, "lineitem").join(G.table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    side = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    sums = lines.groupBy("p_brand", "l_suppkey").agg(F.rint((side("O") - side("F")) / 10).alias("x")).withColumn("y", F.lit(0.0))
    return stats.signed_rank(sums, ["p_brand"], "x", "y").select("p_brand", "pairs_differing", "w", F.round("z", 7).alias("z"))


ZETA = """list_sum(list_transform(range(10), lambda k: exp(-({a}) * ln({q} + k)))) + exp(-({a}) * ln({q} + 10)) * (({q} + 10) / ({a} - 1) + 0.5::DOUBLE + {a} / ({q} + 10) / 12
- {a} * ({a} + 1) * ({a} + 2) / pow({q} + 10, 3) / 720 + {a} * ({a} + 1) * ({a} + 2) * ({a} + 3) * ({a} + 4) / pow({q} + 10, 5) / 30240)"""
FIT_CTE = """hist AS MATERIALIZED (SELECT dataset, value, count(*) AS n FROM data WHERE value > 0 GROUP BY ALL),
pts AS MATERIALIZED (SELECT dataset, value, sum(n) OVER w AS nt, sum(n * ln(value)) OVER w AS lg, sum(n) OVER (PARTITION BY dataset) AS total, max(value) OVER (PARTITION BY dataset) AS top FROM hist WINDOW w AS (PARTITION BY dataset ORDER BY value DESC)),
cands AS MATERIALIZED (SELECT *, 1 + nt / (lg - nt * ln(value - 0.5::DOUBLE)) AS alpha FROM pts WHERE value < top),
ks AS MATERIALIZED (SELECT c.dataset, c.value AS xmin, c.alpha, c.nt AS n_tail, c.total AS n, max(abs(p.nt / c.nt - ({zx}) / ({zm}))) AS ks FROM cands c JOIN pts p ON p.dataset = c.dataset AND p.value >= c.value GROUP BY ALL),
fits AS MATERIALIZED (SELECT dataset, arg_min(struct_pack(xmin := xmin, alpha := alpha, n_tail := n_tail, n := n, ks := ks), ks) AS f FROM ks GROUP BY dataset)""".replace("{zx}", ZETA.format(a="c.alpha", q="p.value")).replace("{zm}", ZETA.format(a="c.alpha", q="c.value"))
DEGREES_CTE = "WITH data AS (SELECT 'lines per supplier and month' AS dataset, count(*) AS value FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate) UNION ALL SELECT 'orders per customer', count(*) FROM orders GROUP BY o_custkey), " + FIT_CTE


@G.remembered
def tail_data(spark, sf):
    """(dataset, value, n) of two count distributions."""
    lines = G.table(spark, sf, "lineitem").groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("k"))
    orders = G.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    rows = lines.select(F.lit("lines per supplier and month").alias("dataset"), "k").unionByName(orders.select(F.lit("orders per customer").alias("dataset"), "k"))
    return settle(tails.value_histogram(rows, ["dataset"], "k"))


@G.remembered
def tail_fits(spark, sf):
    return settle(tails.fit_power_law(tail_data(spark, sf), ["dataset"]))


@query("stp_power_law_fit", DEGREES_CTE + " SELECT dataset, f.xmin::BIGINT AS xmin, round(f.alpha, 8) AS alpha, round((f.alpha - 1) / sqrt(f.n_tail), 8) AS sigma, f.n_tail::BIGINT AS n_tail, f.n::BIGINT AS n, round(f.ks, 8) AS ks FROM fits")
def _(spark, sf):
    return tail_fits(spark, sf).select("dataset", "xmin", F.round("alpha", 8).alias("alpha"), F.round("sigma", 8).alias("sigma"), "n_tail", "n", F.round("ks", 8).alias("ks"))


@query("stc_model_ccdf", DEGREES_CTE + " SELECT dataset, value::BIGINT AS value, round(f.n_tail / f.n::DOUBLE * (" + ZETA.format(a="f.alpha", q="value") + ") / (" + ZETA.format(a="f.alpha", q="f.xmin") + "), 8) AS p FROM hist JOIN fits USING (dataset) WHERE value >= f.xmin")
def _(spark, sf):
    return tails.model_ccdf(tail_data(spark, sf), tail_fits(spark, sf), ["dataset"]).withColumn("p", F.round("p", 8))


@query("stb_bootstrap")
def _(spark, sf):
    return tails.bootstrap(tail_data(spark, sf), tail_fits(spark, sf), ["dataset"], 1000, 41)


@query("stl_likelihood_ratios")
def _(spark, sf):
    return tails.likelihood_ratios(tail_data(spark, sf), tail_fits(spark, sf), ["dataset"])


@query("stl_exponential", DEGREES_CTE + """, tail AS (SELECT dataset, value, n, f.xmin AS xmin, f.alpha AS alpha FROM hist JOIN fits USING (dataset) WHERE value >= f.xmin),
rates AS (SELECT dataset, ln(1 + 1 / greatest(1e-9::DOUBLE, sum(n * value) / sum(n) - any_value(xmin))) AS r FROM tail GROUP BY 1),
gaps AS (SELECT dataset, n, -alpha * ln(value) - ln(""" + ZETA.format(a="alpha", q="xmin") + """) - (ln(1 - exp(-r)) - r * (value - xmin)) AS d FROM tail JOIN rates USING (dataset))
SELECT dataset, 'exponential' AS alternative, round(sum(n * d) / sqrt(sum(n) * (sum(n * d * d) / sum(n) - pow(sum(n * d) / sum(n), 2))), 6) AS ratio FROM gaps GROUP BY dataset""")
def _(spark, sf):
    """The alternative that has a closed form."""
    table = tails.likelihood_ratios(tail_data(spark, sf), tail_fits(spark, sf), ["dataset"], ("exponential",))
    return table.select("dataset", "alternative", F.round("ratio", 6).alias("ratio"))


@query("sta_cascade_fit")
def _(spark, sf):
    """Power-law fit of the pooled cascade sizes of the trade runs (few distinct sizes at small scale)."""
    return tails.fit_power_law(settle(tails.value_histogram(pooled_cascades(spark, sf), ["dataset"], "avalanche")), ["dataset"])
