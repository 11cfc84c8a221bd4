"""Queries over removal runs: curve algebra, protocols, thresholds, statistics of runs, consistency checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fraygraph.functions import scalars
from fraygraph.operators import checks, curves, reach, removal, stats
from fraygraph.plans import graphs as G
from fraygraph.plans.registry import query
from fraygraph.session import checkpoint_folder, settle
from fraygraph.sources import tables as S

R = "WITH RECURSIVE "
FLOWS = R + G.flows_sql()
RUNS = R + G.runs_sql()
RUN = ["strategy", "trial"]

AUC_CTE = """win AS (SELECT c.* FROM curves c JOIN (SELECT strategy, trial, min(batch) AS last FROM curves WHERE fraction_removed >= 0.5 GROUP BY ALL) w USING (strategy, trial) WHERE batch <= last),
trap AS (SELECT *, fraction_removed - lag(fraction_removed) OVER r AS dx, lag(flow) OVER r AS flow0 FROM win WINDOW r AS (PARTITION BY strategy, trial ORDER BY batch)),
aucs AS (SELECT strategy, trial, sum(dx * (flow + flow0) / 2) / max(flow) FILTER (WHERE batch = 0) / (max(fraction_removed) - min(fraction_removed)) AS auc_flow FROM trap GROUP BY ALL)"""
CRITICAL_CTE = """lagged AS (SELECT *, lag(fraction_removed) OVER r AS x0, lag(flow) OVER r AS y0, first_value(flow) OVER r * 0.5::DOUBLE AS half FROM curves
WINDOW r AS (PARTITION BY strategy, trial ORDER BY batch)),
hits AS (SELECT strategy, trial, min(batch) FILTER (WHERE flow < half) AS batch FROM lagged GROUP BY ALL),
critical AS (SELECT h.strategy, h.trial, h.batch, x0 + (fraction_removed - x0) * (y0 - half) / (y0 - flow) AS f_c, fraction_removed AS f_c_batch
FROM hits h LEFT JOIN lagged l ON l.strategy = h.strategy AND l.trial = h.trial AND l.batch = h.batch)"""


def flow_aucs(spark, sf):
    return curves.normalized_auc(curves.auc_window(G.trade_flows(spark, sf), RUN), RUN, "fraction_removed", {"flow": "auc_flow"})


def critical(spark, sf):
    return curves.critical_fractions(G.trade_flows(spark, sf), RUN, "fraction_removed", "flow")


@query("fl3_flow_curves", FLOWS + " SELECT * FROM curves")
def _(spark, sf):
    return G.trade_flows(spark, sf)


@query("rm3_random_percolation", RUNS + " SELECT trial, batch, fraction_removed, flow, reachable_pairs, avalanche FROM curves WHERE strategy = 'random'")
def _(spark, sf):
    return G.trade_runs(spark, sf).filter("strategy = 'random'").drop("strategy")


@query("rm1_static_strategies", RUNS + " SELECT strategy, batch, fraction_removed, flow, reachable_pairs, avalanche FROM curves WHERE strategy <> 'random'")
def _(spark, sf):
    return G.trade_runs(spark, sf).filter("strategy <> 'random'").drop("trial")


@query("w5_auc_window", FLOWS + f", {AUC_CTE} SELECT strategy, trial, batch, flow FROM win")
def _(spark, sf):
    return curves.auc_window(G.trade_flows(spark, sf), RUN).select(*RUN, "batch", "flow")


@query("w6_normalized_auc", FLOWS + f", {AUC_CTE} SELECT strategy, trial, round(auc_flow, 9) AS auc_flow FROM aucs")
def _(spark, sf):
    return flow_aucs(spark, sf).select(*RUN, F.round("auc_flow", 9).alias("auc_flow"))


@query("w7_critical_fractions", FLOWS + f", {CRITICAL_CTE} SELECT strategy, trial, batch, round(f_c, 9) AS f_c, f_c_batch FROM critical")
def _(spark, sf):
    return critical(spark, sf).select(*RUN, "batch", F.round("f_c", 9).alias("f_c"), "f_c_batch")


@query("w8_half_flow_batch", FLOWS + f", {CRITICAL_CTE} SELECT strategy, trial, batch FROM hits")
def _(spark, sf):
    return curves.first_batch_below(G.trade_flows(spark, sf), RUN, "flow")


@query("w12_newly_cut", RUNS + " SELECT strategy, trial, batch, avalanche FROM curves WHERE batch > 0")
def _(spark, sf):
    scenarios, batches, removed = G.trade_run_removals(spark, sf)
    found = reach.avalanches(reach.disconnection(G.trade(spark, sf), scenarios, removed), batches).filter("batch > 0")
    return found.select(
        F.substring_index("scenario", "|", 1).alias("strategy"), F.substring_index("scenario", "|", -1).cast("int").alias("trial"),
        "batch", F.col("newly_cut").cast("long").alias("avalanche"),
    )


def _value_sql(points: str, scale: str = "1") -> str:
    return f"""points AS ({points}), seg AS (SELECT *, lead(fraction_removed) OVER r AS x1, lead(flow) OVER r AS y1, first_value(flow) OVER r AS start FROM curves
WINDOW r AS (PARTITION BY strategy, trial ORDER BY batch))
SELECT s.strategy, s.trial, p.at AS "at", round(CASE WHEN x1 IS NULL THEN flow ELSE flow + (y1 - flow) * (p.at - fraction_removed) / (x1 - fraction_removed) END / {scale}, 9) AS value
FROM seg s JOIN points p ON s.strategy = p.strategy AND s.trial = p.trial AND p.at >= fraction_removed AND (x1 IS NULL OR p.at < x1)"""


@query("pf11_value_at", FLOWS + ", " + _value_sql("SELECT DISTINCT strategy, trial, i / 16.0::DOUBLE AS at FROM curves, range(10) r(i)"))
def _(spark, sf):
    flows = G.trade_flows(spark, sf)
    points = flows.select(*RUN).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(*RUN, (F.col("i") / 16.0).alias("at"))
    return curves.value_at(flows, points, RUN, "fraction_removed", "flow").withColumn("value", F.round("value", 9))


@query("pf12_resampled", FLOWS + ", " + _value_sql("SELECT strategy, trial, fraction_removed * 0.75::DOUBLE AS at FROM curves", "start"))
def _(spark, sf):
    flows = G.trade_flows(spark, sf)
    points = flows.select(*RUN, (F.col("fraction_removed") * 0.75).alias("at"))
    return curves.resample(flows, points, RUN, "fraction_removed", "flow", "flow").withColumn("value", F.round("value", 9))


@query("ag10_band", FLOWS + " SELECT strategy, batch, round(avg(flow), 9) AS mean, min(flow) AS low, max(flow) AS high, count(*) AS trials FROM curves GROUP BY ALL")
def _(spark, sf):
    return curves.band(G.trade_flows(spark, sf), ["strategy", "batch"], "flow").withColumn("mean", F.round("mean", 9))


# Two-sided 95% Student-t quantile at 29 degrees of freedom, the thirty random trials.
T29 = "2.0452296421327034::DOUBLE"


def _ci_sql(source: str, by: str, value: str) -> str:
    key = f"{by}, " if by else ""
    return f"""SELECT {key}count({value}) AS n, round(avg({value}), 9) AS mean, round(stddev_samp({value}), 9) AS sd, round(avg({value}) - {T29} * stddev_samp({value}) / sqrt(count({value})), 7) AS low,
round(avg({value}) + {T29} * stddev_samp({value}) / sqrt(count({value})), 7) AS high FROM {source}""" + (f" GROUP BY {by}" if by else "")


def _rounded_ci(df):
    for column, digits in (("mean", 9), ("sd", 9), ("low", 7), ("high", 7)):
        df = df.withColumn(column, F.round(column, digits))
    return df


@query("ag11_mean_ci", FLOWS + f", {AUC_CTE} " + _ci_sql("aucs WHERE strategy = 'random'", "", "auc_flow"))
def _(spark, sf):
    return _rounded_ci(curves.mean_ci(flow_aucs(spark, sf).filter("strategy = 'random'"), [], "auc_flow"))


@query("ag12_normalized_band", FLOWS + ", norm AS (SELECT batch, flow / first_value(flow) OVER (PARTITION BY trial ORDER BY batch)::DOUBLE AS y FROM curves WHERE strategy = 'random') " + _ci_sql("norm", "batch", "y"))
def _(spark, sf):
    flows = G.trade_flows(spark, sf).filter("strategy = 'random'")
    start = flows.filter("batch = 0").select("trial", F.col("flow").alias("start"))
    return _rounded_ci(curves.mean_ci(flows.join(start, "trial").withColumn("y", scalars.ratio(F.col("flow"), F.col("start"))), ["batch"], "y"))


NULL_CTE = AUC_CTE + """, test AS (SELECT r.strategy, r.auc_flow AS real, avg(n.auc_flow) AS null_mean, stddev_samp(n.auc_flow) AS null_sd, min(n.auc_flow) AS null_min, max(n.auc_flow) AS null_max,
count(*) FILTER (WHERE n.auc_flow <= r.auc_flow) AS at_or_below, count(*) AS n FROM aucs r, aucs n WHERE r.strategy <> 'random' AND n.strategy = 'random' GROUP BY ALL)"""


def null_test(spark, sf):
    """The static strategies against the random trials as their null draws."""
    aucs = settle(flow_aucs(spark, sf))
    real = aucs.filter("strategy <> 'random'").select("strategy", "auc_flow")
    nulls = aucs.filter("strategy = 'random'").select(F.explode(F.array(F.lit("out_strength"), F.lit("in_strength"))).alias("strategy"), "auc_flow")
    return curves.null_summary(real, nulls, ["strategy"], "auc_flow", 0.0083)


@query("ag13_null_summary", FLOWS + f", {NULL_CTE} SELECT strategy, round(real, 9) AS real, round(null_mean, 9) AS null_mean, round(null_sd, 9) AS null_sd, at_or_below, n, (1 + at_or_below) / (1 + n)::DOUBLE AS p_value, "
       "round((real - null_mean) / null_sd, 6) AS z, (1 + at_or_below) / (1 + n)::DOUBLE < 0.0083 AS significant FROM test")
def _(spark, sf):
    table = null_test(spark, sf)
    return table.select("strategy", *[F.round(c, 9).alias(c) for c in ("real", "null_mean", "null_sd")], "at_or_below", "n", "p_value", F.round("z", 6).alias("z"), "significant")


@query("pf13_verdicts", FLOWS + f", {NULL_CTE} SELECT strategy, CASE WHEN (1 + at_or_below) / (1 + n)::DOUBLE < 0.0083 THEN 'more_fragile' WHEN real > null_mean THEN 'above_null_mean' ELSE 'not_significant' END AS verdict, "
       "CASE WHEN (1 + at_or_below) / (1 + n)::DOUBLE >= 0.1 THEN 'plausible' ELSE 'rejected' END AS reading FROM test")
def _(spark, sf):
    verdict = scalars.fragility_verdict(F.col("significant"), F.col("real"), F.col("null_mean")).alias("verdict")
    return null_test(spark, sf).select("strategy", verdict, scalars.plausible(F.col("p_value")).alias("reading"))


@query("nm3_lower_p", FLOWS + f", {NULL_CTE} SELECT strategy, at_or_below, (1 + at_or_below) / (1 + n)::DOUBLE AS p_value FROM test")
def _(spark, sf):
    return null_test(spark, sf).select("strategy", "at_or_below", "p_value")


@query("ag16_trial_summary", FLOWS + f", {CRITICAL_CTE} SELECT strategy, count(*) AS trials, CASE WHEN bool_and(f_c IS NOT NULL) THEN round(avg(f_c), 9) END AS mean, CASE WHEN bool_and(f_c IS NOT NULL) THEN round(min(f_c), 9) END AS low, "
       "CASE WHEN bool_and(f_c IS NOT NULL) THEN round(max(f_c), 9) END AS high FROM critical GROUP BY strategy")
def _(spark, sf):
    table = curves.trial_summary(critical(spark, sf), ["strategy"], "f_c")
    return table.select("strategy", "trials", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query("ag20_cascades", RUNS + " SELECT strategy, count(*) AS batches, count(*) FILTER (WHERE avalanche = 0) AS zero_batches, max(avalanche) AS max_size, sum(avalanche)::BIGINT AS total_cut FROM curves WHERE batch > 0 GROUP BY 1")
def _(spark, sf):
    return curves.cascade_summary(G.trade_runs(spark, sf), ["strategy"])


@query("ag21_headline", RUNS + f", {AUC_CTE}, {CRITICAL_CTE} SELECT (SELECT arg_min(strategy, (auc_flow, strategy)) FROM aucs) AS worst_order, (SELECT max(avalanche) FROM curves) AS largest_cascade, "
       "(SELECT arg_max(concat(strategy, '|', trial, '|', batch), (avalanche, concat(strategy, '|', trial, '|', batch))) FROM curves WHERE batch > 0) AS largest_at, "
       "(SELECT sum(avalanche)::BIGINT FROM curves c JOIN hits h USING (strategy, trial) WHERE c.batch <= h.batch AND strategy = 'out_strength') AS silenced_at_half")
def _(spark, sf):
    runs = G.trade_runs(spark, sf)
    place = F.concat_ws("|", *RUN, "batch")
    half = critical(spark, sf).filter("strategy = 'out_strength'").select("strategy", "trial", F.col("batch").alias("half"))
    worst = flow_aucs(spark, sf).agg(F.min_by("strategy", F.struct("auc_flow", "strategy")).alias("worst_order"))
    biggest = runs.filter("batch > 0").agg(F.max("avalanche").alias("largest_cascade"), F.max_by(place, F.struct("avalanche", place)).alias("largest_at"))
    silent = runs.join(half, RUN).filter("batch <= half").agg(F.sum("avalanche").alias("silenced_at_half"))
    rows = worst.unionByName(biggest, True).unionByName(silent, True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


@query("rm5_fragility_scores", RUNS + f", {AUC_CTE}, pairs AS (SELECT strategy, trial, batch, fraction_removed, reachable_pairs AS flow FROM curves), "
       + AUC_CTE.replace("win AS", "pwin AS").replace("FROM curves c", "FROM pairs c").replace("FROM curves WHERE", "FROM pairs WHERE").replace("trap AS", "ptrap AS").replace("FROM win", "FROM pwin").replace("aucs AS", "paucs AS").replace("FROM trap", "FROM ptrap")
       + " SELECT a.strategy, count(*) AS trials, round(avg(a.auc_flow), 9) AS auc_flow, round(avg(p.auc_flow), 9) AS auc_reachability FROM aucs a JOIN paucs p USING (strategy, trial) GROUP BY ALL")
def _(spark, sf):
    window = curves.auc_window(G.trade_runs(spark, sf), RUN)
    aucs = curves.normalized_auc(window, RUN, "fraction_removed", {"flow": "f", "reachable_pairs": "r"})
    return aucs.groupBy("strategy").agg(F.count(F.lit(1)).alias("trials"), F.round(F.avg("f"), 9).alias("auc_flow"), F.round(F.avg("r"), 9).alias("auc_reachability"))


@query("rm6_thresholds", FLOWS + f""", {CRITICAL_CTE}, rnd AS (SELECT avg(f_c) AS mean, avg(f_c) - {T29} * stddev_samp(f_c) / sqrt(count(f_c)) AS low FROM critical WHERE strategy = 'random')
SELECT strategy, round(f_c, 9) AS f_c, f_c_batch, round(rnd.mean, 9) AS random_mean, round(low, 7) AS random_low, f_c < low AS below_random,
strategy = (SELECT arg_min(strategy, (f_c, strategy)) FROM critical WHERE strategy <> 'random') AS most_damaging FROM critical, rnd WHERE strategy <> 'random'""")
def _(spark, sf):
    table = curves.threshold_table(critical(spark, sf))
    return table.select("strategy", F.round("f_c", 9).alias("f_c"), "f_c_batch", F.round("random_mean", 9).alias("random_mean"), F.round("random_low", 7).alias("random_low"), "below_random", "most_damaging")


# ---- edge attack ----------------------------------------------------------------------------------------------------

EDGE_CTE = f"""WITH RECURSIVE {G.trade_sql()},
total AS MATERIALIZED (SELECT count(*)::BIGINT AS n, greatest(1, round_even(0.01::DOUBLE * count(*), 0))::BIGINT AS size FROM edges),
schedule AS MATERIALIZED (SELECT b AS batch, b * size / n::DOUBLE AS fraction_removed FROM total, range(1000) r(b) WHERE b <= (0.5::DOUBLE * n)::BIGINT // size AND b * size <= floor(0.5::DOUBLE * n)),
scenarios AS MATERIALIZED (SELECT concat(o, '|', t) AS scenario, o, sign FROM (VALUES ('strongest', 1), ('weakest', -1), ('random', 0)) x(o, sign), range(5) t(t)),
ranked AS (SELECT scenario, src, dst, row_number() OVER (PARTITION BY scenario ORDER BY weight * sign DESC, md5(concat('13|', scenario, '|', src, '|', dst))) AS rank FROM edges, scenarios),
{G.layered_flow_sql(edge_deaths="SELECT scenario, src, dst, (rank + size - 1) // size AS k FROM ranked, total")}"""


@G.remembered
def trade_edge_runs(spark, sf):
    return settle(removal.edge_attack(G.trade(spark, sf), 5, 13, 0.01, layered=True))


@query("rm4_edge_attack", EDGE_CTE + """, pair_deaths AS (SELECT a.scenario, a.src AS s, b.dst AS m, max(least(a.k, b.k)) AS k FROM deaths a JOIN deaths b ON a.scenario = b.scenario AND a.dst = b.src GROUP BY ALL),
pair_counts AS (SELECT scenario, batch, count(*) AS reachable_pairs FROM pair_deaths JOIN schedule ON k > batch GROUP BY ALL)
SELECT f.scenario, f.batch, fraction_removed, flow, coalesce(reachable_pairs, 0)::BIGINT AS reachable_pairs FROM flows f JOIN schedule USING (batch) LEFT JOIN pair_counts p ON p.scenario = f.scenario AND p.batch = f.batch""")
def _(spark, sf):
    return trade_edge_runs(spark, sf)


@query("io5_edge_trials", EDGE_CTE + " SELECT split_part(scenario, '|', 1) AS \"order\", split_part(scenario, '|', 2)::INTEGER AS trial, batch::INTEGER AS batch, fraction_removed, flow FROM flows JOIN schedule USING (batch)")
def _(spark, sf):
    path = f"{checkpoint_folder(spark)}/edge-{uuid.uuid4().hex}"
    rows = trade_edge_runs(spark, sf).select(
        F.substring_index("scenario", "|", 1).alias("order"), F.substring_index("scenario", "|", -1).cast("int").alias("trial"), "fraction_removed", "flow", "reachable_pairs"
    )
    S.write_csv(rows, path, {"fraction_removed": 6})
    return S.load_edge_trials(spark, path, G.trade(spark, sf).edges.count()).select("order", "trial", "batch", "fraction_removed", "flow")


# ---- statistics of runs ---------------------------------------------------------------------------------------------


@query("sta_pooled_cascades", RUNS + """, last AS (SELECT strategy, trial, min(batch) AS last FROM curves WHERE fraction_removed >= 0.5 GROUP BY ALL), inside AS (SELECT * FROM curves JOIN last USING (strategy, trial) WHERE batch BETWEEN 1 AND last)
SELECT 'primary' AS dataset, avalanche, count(*) AS n FROM inside WHERE trial = 0 GROUP BY ALL UNION ALL SELECT 'sensitivity', avalanche, count(*) FROM inside GROUP BY ALL""")
def _(spark, sf):
    return pooled_cascades(spark, sf).groupBy("dataset", "avalanche").agg(F.count(F.lit(1)).alias("n"))


def pooled_cascades(spark, sf):
    """(dataset, avalanche): primary pools one run per strategy, sensitivity every trial."""
    inside = curves.auc_window(G.trade_runs(spark, sf), RUN).filter("batch > 0")
    sets = F.when(F.col("trial") == 0, F.array(F.lit("primary"), F.lit("sensitivity"))).otherwise(F.array(F.lit("sensitivity")))
    return inside.select(F.explode(sets).alias("dataset"), "avalanche")


@query("stw_welch", FLOWS + f""", g AS (SELECT strategy, trial, flow, CASE WHEN trial < 5 THEN 'a' ELSE 'b' END AS half FROM curves WHERE strategy = 'random' AND batch = 10),
s AS (SELECT avg(flow) FILTER (WHERE half = 'a') AS m1, var_samp(flow) FILTER (WHERE half = 'a') / count(*) FILTER (WHERE half = 'a') AS a, count(*) FILTER (WHERE half = 'a') AS n1,
avg(flow) FILTER (WHERE half = 'b') AS m2, var_samp(flow) FILTER (WHERE half = 'b') / count(*) FILTER (WHERE half = 'b') AS b, count(*) FILTER (WHERE half = 'b') AS n2 FROM g)
SELECT round((m1 - m2) / sqrt(a + b), 8) AS t, round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)), 8) AS df FROM s""")
def _(spark, sf):
    half = F.when(F.col("trial") < 5, "a").otherwise("b")
    rows = G.trade_flows(spark, sf).filter("strategy = 'random' and batch = 10").withColumn("half", half)
    return stats.welch(rows, [], "half", "a", "b", "flow").select(F.round("t", 8).alias("t"), F.round("df", 8).alias("df"))


# ---- consistency ----------------------------------------------------------------------------------------------------


def _ok(names):
    rows = ", ".join(f"('{n}')" for n in names)
    return f"SELECT n AS \"check\", 0::BIGINT AS violations, 'OK' AS status FROM (VALUES {rows}) t(n)"


@query("dq1_curves", _ok(checks.CURVE_CHECKS))
def _(spark, sf):
    return checks.report(checks.check_curves(G.trade_runs(spark, sf), RUN), checks.CURVE_CHECKS)


@query("dq2_graph", _ok(checks.GRAPH_CHECKS))
def _(spark, sf):
    graph = G.trade(spark, sf)
    return checks.report(checks.check_graph(graph.vertices, graph.edges, graph.terminals, 0.01), checks.GRAPH_CHECKS)


@query("dq3_thresholds", _ok(["threshold from curve", "threshold between points"]))
def _(spark, sf):
    found = critical(spark, sf)
    flows = G.trade_flows(spark, sf).select(*RUN, "batch", "fraction_removed", "flow")
    start = flows.filter("batch = 0").select(*RUN, F.col("flow").alias("start"))
    at = found.join(flows, [*RUN, "batch"]).join(start, RUN)
    bad = checks.together(
        checks.violations(at, "threshold from curve", (F.col("flow") * 2 >= F.col("start")) | (F.col("fraction_removed") != F.col("f_c_batch")), *RUN),
        checks.violations(at, "threshold between points", (F.col("f_c") > F.col("f_c_batch")) | (F.col("f_c") < 0), *RUN),
    )
    return checks.report(bad, ["threshold from curve", "threshold between points"])


@query("dq5_cascades_match_curves", _ok(["cascade totals", "edge runs monotone"]))
def _(spark, sf):
    """Cascade summaries recomputed from the timeline; edge-attack curves never rise."""
    from pyspark.sql import Window

    scenarios, batches, removed = G.trade_run_removals(spark, sf)
    line = reach.disconnection(G.trade(spark, sf), scenarios, removed).filter("silenced_at > 0")
    counts = line.groupBy(F.substring_index("scenario", "|", 1).alias("strategy")).agg(F.count(F.lit(1)).alias("from_timeline"))
    both = curves.cascade_summary(G.trade_runs(spark, sf), ["strategy"]).join(counts, "strategy", "left")
    run = Window.partitionBy("scenario").orderBy("batch")
    edges = trade_edge_runs(spark, sf).withColumn("was", F.lag("flow").over(run))
    bad = checks.together(
        checks.violations(both, "cascade totals", F.col("total_cut") != F.coalesce("from_timeline", F.lit(0)), "strategy"),
        checks.violations(edges, "edge runs monotone", F.col("flow") > F.col("was"), "scenario", "batch"),
    )
    return checks.report(bad, ["cascade totals", "edge runs monotone"])


@query("dq6_terminals", _ok(["disjoint", "both roles present", "fields present"]))
def _(spark, sf):
    graph = G.handover(spark, sf)
    roles = graph.terminals.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    kinds = roles.agg(F.count(F.lit(1)).alias("kinds"), F.lit("roles").alias("what"))
    missing = spark.createDataFrame([(c,) for c in checks.missing_fields(graph.vertices, ["v", "class", "n"])], "field string")
    bad = checks.together(
        checks.violations(graph.overlapping_terminals(), "disjoint", F.lit(True), "v"),
        checks.violations(kinds, "both roles present", F.col("kinds") != 2, "what"),
        checks.violations(missing, "fields present", F.lit(True), "field"),
    )
    return checks.report(bad, ["disjoint", "both roles present", "fields present"])


@query("dq7_table_differences", """SELECT c_custkey, 'c_acctbal' AS "column" FROM customer WHERE c_nationkey = 3 AND abs(c_acctbal * 1e-3) > greatest(1e-9, 1e-6 * abs(c_acctbal * 1.001))
UNION ALL SELECT c_custkey, 'c_mktsegment' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 4""")
def _(spark, sf):
    left = G.table(spark, sf, "customer")
    changed = left.withColumn("c_acctbal", F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") * 1.001).otherwise(F.col("c_acctbal") * (1 + 1e-9)))
    changed = changed.withColumn("c_mktsegment", F.when((F.col("c_nationkey") == 4) & (F.col("c_mktsegment") == "BUILDING"), "X").otherwise(F.col("c_mktsegment")))
    return checks.table_differences(left, changed, ["c_custkey"], ["c_acctbal"], ["c_mktsegment"]).select("c_custkey", "column")


@query("dq8_export_matches", "SELECT 0::BIGINT AS differences")
def _(spark, sf):
    vertices = G.trade(spark, sf).vertices
    documents = S.column_document(vertices, "v", ["v", "n", "class"], rows_per_part=50)
    back = documents.select(F.explode(F.arrays_zip("v", "n", "class")).alias("r")).select("r.v", "r.n", "r.class")
    return checks.table_differences(vertices, back, ["v"], ["n"], ["class"]).agg(F.count(F.lit(1)).alias("differences"))
