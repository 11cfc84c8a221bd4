"""Graphs derived from the driver tables, and the same graphs as SQL common table expressions.

trade    customer groups -> part groups -> supplier nations, weight = quantity (layered)
sided    the same with part groups split in two by line status (layered, two-sided labels)
switch   value k of an event -> value k of the user's next event (cyclic)
handover user -> user of the next event in time (cyclic)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraygraph.operators.graph_build import Graph, aggregate_edges, degrees, majority, threshold_edges
from fraygraph.operators.flow import layered_curve
from fraygraph.operators.ranking import PERMUTATION_ROUNDS, batch_of_rank, schedule_table
from fraygraph.operators.removal import measure, static_order
from fraygraph.session import settle

_MEMO: dict = {}


def forget() -> None:
    """Drop remembered graphs, so that the next query builds its own."""
    _MEMO.clear()


def remembered(function):
    """Build once per session, table folder and parameters; results are settled tables."""

    def call(spark: SparkSession, sf: str, *args):
        key = (spark.sparkContext.applicationId, function.__name__, sf, args)
        if key not in _MEMO:
            _MEMO[key] = function(spark, sf, *args)
        return _MEMO[key]

    call.__name__ = function.__name__
    return call


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Column expressions shared by Spark (expr) and SQL; both engines read these strings.
CUSTOMER_LABEL = "concat('C|', c_nationkey, '|', c_mktsegment)"
PART_LABEL = "concat('P|', p_brand)"
SIZED_LABEL = "concat('P|', p_brand, '|', p_size)"
SIDED_LABEL = "concat('P|', p_brand, '|', CASE WHEN l_linestatus = 'O' THEN 'L' ELSE 'R' END)"
SUPPLIER_LABEL = "concat('S|', s_nationkey)"


def trade_connections(spark: SparkSession, sf: str, middle: str = PART_LABEL) -> DataFrame:
    """Two labelled connections per order line. Only the key and label columns are read of each table."""
    buyers = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(
        table(spark, sf, "customer").selectExpr("c_custkey", f"{CUSTOMER_LABEL} AS buyer"), F.col("o_custkey") == F.col("c_custkey")
    )
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus")
    lines = lines.join(buyers.select("o_orderkey", "buyer"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(table(spark, sf, "supplier").selectExpr("s_suppkey", f"{SUPPLIER_LABEL} AS seller"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.withColumn("goods", F.expr(middle))
    # The line is counted once per (buyer, goods, seller) before it becomes two connections.
    summed = lines.groupBy("buyer", "goods", "seller").agg(F.sum("l_quantity").alias("weight"), F.count(F.lit(1)).alias("n"))
    ends = F.array(
        F.struct(F.col("buyer").alias("src"), F.col("goods").alias("dst")), F.struct(F.col("goods").alias("src"), F.col("seller").alias("dst"))
    )
    return summed.select(F.explode(ends).alias("e"), "weight", "n").select("e.src", "e.dst", "weight", "n")


def trade_edges(spark: SparkSession, sf: str, middle: str = PART_LABEL) -> DataFrame:
    return trade_connections(spark, sf, middle).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def trade_vertices(spark: SparkSession, sf: str, middle: str = PART_LABEL) -> DataFrame:
    """(v, n, class, role): buyers by market segment, goods by their most frequent type, sellers by region."""
    buyers = table(spark, sf, "customer").selectExpr(f"{CUSTOMER_LABEL} AS v", "c_mktsegment AS class").groupBy("v", "class").agg(F.count(F.lit(1)).alias("n"))
    parts = table(spark, sf, "part").selectExpr(f"{middle} AS v", "p_type")
    goods = parts.groupBy("v").agg(F.count(F.lit(1)).alias("n")).join(majority(parts, "v", "p_type").selectExpr("v", "p_type AS class"), "v")
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    sellers = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    sellers = sellers.selectExpr(f"{SUPPLIER_LABEL} AS v", "r_name AS class").groupBy("v", "class").agg(F.count(F.lit(1)).alias("n"))
    rows = [buyers.select("v", "n", "class", F.lit("S").alias("role")), goods.select("v", "n", "class", F.lit(None).cast("string").alias("role"))]
    rows.append(sellers.select("v", "n", "class", F.lit("M").alias("role")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@remembered
def trade(spark: SparkSession, sf: str, tau: float = 0.01, middle: str = PART_LABEL) -> Graph:
    vertices = settle(trade_vertices(spark, sf, middle))
    edges = settle(threshold_edges(trade_edges(spark, sf, middle), tau))
    return Graph(vertices, edges, vertices.filter("role is not null").select("v", "role"))


@remembered
def sided(spark: SparkSession, sf: str, tau: float = 0.01) -> Graph:
    edges = settle(threshold_edges(trade_edges(spark, sf, SIDED_LABEL), tau))
    plain = trade_vertices(spark, sf)
    goods = plain.filter("role is null").withColumn("side", F.explode(F.array(F.lit("L"), F.lit("R"))))
    goods = goods.select(F.concat_ws("|", "v", "side").alias("v"), F.col("v").alias("label"), "side", "role")
    others = plain.filter("role is not null").select("v", F.col("v").alias("label"), F.lit("M").alias("side"), "role")
    vertices = settle(goods.unionByName(others))
    return Graph(vertices, edges, vertices.filter("role is not null").select("v", "role"))


def successor_pairs(df: DataFrame, keys: list[str], time: str, ident: str, value: str, slot: str = "day") -> DataFrame:
    """(value, next_value) of consecutive rows per key group in (time, ident) order.

    Rows look ahead inside their time slot; only the first row of every slot is ordered across slots. A key that holds
    a third of all rows, or no key at all, is therefore spread over its slots.
    """
    cut = df.withColumn("_slot", F.date_trunc(slot, time))
    row = F.struct(F.col(time).alias("t"), F.col(ident).alias("i"), F.col(value).alias("x"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(time, ident)
    looked = cut.select(*keys, "_slot", F.col(value).alias("value"), F.lead(value).over(inside).alias("_next"), F.lead(ident).over(inside).alias("_more"))
    firsts = cut.groupBy(*keys, "_slot").agg(F.min(row).alias("_first"))
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_slot")
    following = firsts.select(*keys, "_slot", F.lead("_first.x").over(across).alias("_after"))
    joined = looked.join(following, [*keys, "_slot"])
    nxt = F.when(F.col("_more").isNotNull(), F.col("_next")).otherwise(F.col("_after"))
    return joined.select("value", nxt.alias("next_value")).filter("next_value is not null")


def switch_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", k.alias("k"))


def _event_graph(pairs: DataFrame, kinds: DataFrame, tau: float) -> Graph:
    links = pairs.select(F.col("value").cast("string").alias("src"), F.col("next_value").cast("string").alias("dst"), F.lit(1).cast("long").alias("weight"))
    edges = settle(threshold_edges(aggregate_edges(links), tau))
    vertices = settle(majority(kinds, "v", "event_type").select("v", F.col("event_type").alias("class"), F.col("total").alias("n")))
    role = F.when(F.col("class") == "signup", "S").when(F.col("class") == "purchase", "M")
    return Graph(vertices, edges, vertices.select("v", role.alias("role")).filter("role is not null"))


@remembered
def switch(spark: SparkSession, sf: str, tau: float = 0.02) -> Graph:
    events = switch_events(spark, sf)
    return _event_graph(successor_pairs(events, ["user_id"], "ts", "event_id", "k"), events.select(F.col("k").cast("string").alias("v"), "event_type"), tau)


@remembered
def handover(spark: SparkSession, sf: str, tau: float = 0.02) -> Graph:
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return _event_graph(successor_pairs(events, [], "ts", "event_id", "user_id"), events.select(F.col("user_id").cast("string").alias("v"), "event_type"), tau)


# ---- the same graphs in SQL ------------------------------------------------------------------------------------------


def trade_sql(tau: float = 0.01, middle: str = PART_LABEL) -> str:
    """conn, raw, shares, edges(src, dst, weight, share), vertices(v, n, class, role)."""
    goods_class = f"""goods AS (SELECT v, sum(k)::BIGINT AS n, arg_min(p_type, (-k, p_type)) AS class
  FROM (SELECT {middle} AS v, p_type, count(*) AS k FROM part GROUP BY ALL) GROUP BY v)""" if middle != SIDED_LABEL else f"""
goods AS (SELECT concat(v, '|', side) AS v, n, class FROM (SELECT v, sum(k)::BIGINT AS n, arg_min(p_type, (-k, p_type)) AS class
  FROM (SELECT {PART_LABEL} AS v, p_type, count(*) AS k FROM part GROUP BY ALL) GROUP BY v), (VALUES ('L'), ('R')) t(side))"""
    return f"""lines AS (SELECT {CUSTOMER_LABEL} AS buyer, {middle} AS goods, {SUPPLIER_LABEL} AS seller, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
conn AS (SELECT buyer AS src, goods AS dst, l_quantity AS weight FROM lines UNION ALL SELECT goods, seller, l_quantity FROM lines),
raw AS (SELECT src, dst, sum(weight) AS weight, count(*) AS n FROM conn GROUP BY src, dst),
shares AS (SELECT *, weight / sum(weight) OVER (PARTITION BY dst) AS share FROM raw),
edges AS MATERIALIZED (SELECT src, dst, weight, share FROM shares WHERE share >= {tau}::DOUBLE AND src <> dst),
{goods_class},
vertices AS MATERIALIZED (
  SELECT {CUSTOMER_LABEL} AS v, count(*) AS n, c_mktsegment AS class, 'S' AS role FROM customer GROUP BY ALL
  UNION ALL SELECT v, n, class, NULL FROM goods
  UNION ALL SELECT {SUPPLIER_LABEL}, count(*), r_name, 'M' FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
terminals AS (SELECT v, role FROM vertices WHERE role IS NOT NULL)"""


def _event_sql(pairs: str, label: str, tau: float) -> str:
    return f"""pairs AS ({pairs}),
raw AS (SELECT src, dst, count(*)::BIGINT AS weight FROM pairs WHERE dst IS NOT NULL GROUP BY src, dst),
shares AS (SELECT *, weight / sum(weight) OVER (PARTITION BY dst) AS share FROM raw),
edges AS MATERIALIZED (SELECT src, dst, weight, share FROM shares WHERE share >= {tau}::DOUBLE AND src <> dst),
kinds AS (SELECT v, event_type, count(*) AS k FROM (SELECT {label} AS v, event_type FROM events) GROUP BY ALL),
vertices AS MATERIALIZED (SELECT v, arg_min(event_type, (-k, event_type)) AS class, sum(k)::BIGINT AS n FROM kinds GROUP BY v),
terminals AS MATERIALIZED (SELECT v, CASE class WHEN 'signup' THEN 'S' ELSE 'M' END AS role FROM vertices WHERE class IN ('signup', 'purchase')),
sources AS (SELECT v FROM terminals WHERE role = 'S'), targets AS (SELECT v FROM terminals WHERE role = 'M')"""


K_SQL = "json_extract_string(props, '$.k')"


def switch_sql(tau: float = 0.02) -> str:
    pairs = f"SELECT {K_SQL} AS src, lead({K_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"
    return _event_sql(pairs, K_SQL, tau)


def handover_sql(tau: float = 0.02) -> str:
    pairs = "SELECT user_id::VARCHAR AS src, lead(user_id::VARCHAR) OVER (ORDER BY ts, event_id) AS dst FROM events"
    return _event_sql(pairs, "user_id::VARCHAR", tau)


# ---- removal runs on the trade graph ---------------------------------------------------------------------------------

RUN_SEED = 11
TRIALS = 30
BATCH = 0.01


def run_scores(graph: Graph, trials: int = TRIALS) -> DataFrame:
    """(scenario, v, score): 'random|t' with equal scores, 'out_strength|0' and 'in_strength|0' from the intact graph."""
    strength = degrees(graph.edges, graph.vertices)
    orders = F.array(
        *[F.struct(F.lit(f"random|{t}").alias("scenario"), F.lit(0.0).alias("score")) for t in range(trials)],
        F.struct(F.lit("out_strength|0").alias("scenario"), F.col("out_strength").cast("double").alias("score")),
        F.struct(F.lit("in_strength|0").alias("scenario"), F.col("in_strength").cast("double").alias("score")),
    )
    return strength.select("v", F.explode(orders).alias("o")).select("o.scenario", "v", "o.score")


@remembered
def trade_run_removals(spark: SparkSession, sf: str, trials: int = TRIALS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scenarios, batches, removed) of the runs."""
    graph = trade(spark, sf)
    batches = settle(schedule_table(spark, graph.size, BATCH))
    removed = settle(batch_of_rank(static_order(run_scores(graph, trials), RUN_SEED, graph.size), batches).select("scenario", "v", "batch"))
    return settle(removed.select("scenario").distinct()), batches, removed


@remembered
def trade_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Full curves of the runs: (strategy, trial, batch, fraction_removed, flow, reachable_pairs, avalanche)."""
    scenarios, batches, removed = trade_run_removals(spark, sf)
    curves = measure(trade(spark, sf), scenarios, batches, removed, layered=True)
    return settle(
        curves.select(
            F.substring_index("scenario", "|", 1).alias("strategy"), F.substring_index("scenario", "|", -1).cast("int").alias("trial"),
            "batch", "fraction_removed", "flow", "reachable_pairs", "avalanche",
        )
    )


@remembered
def trade_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flow curves only: one aggregation for all runs and batches."""
    scenarios, batches, removed = trade_run_removals(spark, sf)
    curves = layered_curve(trade(spark, sf), scenarios, batches, removed).join(batches.select("batch", "fraction_removed"), "batch")
    return settle(
        curves.select(
            F.substring_index("scenario", "|", 1).alias("strategy"), F.substring_index("scenario", "|", -1).cast("int").alias("trial"),
            "batch", "fraction_removed", "flow",
        )
    )


def draws_sql(draws: int, seed: int) -> str:
    """draws(size, draw, v) of all sizes(size): images of 0 .. size - 1 under keyed permutations; under WITH RECURSIVE."""
    turn = "SELECT size, draw, k, turns, a, b, n, x // b AS l, x % b AS r FROM walk, dims WHERE turns = 0 OR x >= n"
    for k in range(PERMUTATION_ROUNDS):
        own, other, base = ("r", "l", "b") if k % 2 else ("l", "r", "a")
        moved = f"({own} + ('0x' || left(md5(concat('{seed}|', size, '|', draw, '|{k}|', {other})), 13))::BIGINT) % {base} AS {own}"
        turn = f"SELECT size, draw, k, turns, a, b, n, {moved}, {other} FROM ({turn})"
    return f"""dims AS MATERIALIZED (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*)::BIGINT AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM vertices)),
walk(size, draw, k, turns, x) AS (SELECT size, draw, k, 0, k FROM (SELECT DISTINCT size::BIGINT AS size FROM sizes), range({draws}) d(draw), range((SELECT max(size) FROM sizes)) q(k) WHERE k < size
UNION ALL SELECT size, draw, k, turns + 1, l * b + r FROM ({turn})),
draws AS MATERIALIZED (SELECT size, draw, v FROM walk JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS x FROM vertices) USING (x), dims WHERE turns > 0 AND x < n)"""


def pagerank_sql(steps: int = 150) -> str:
    """pagerank(v, score) over edges and vertices, recursed far beyond what doubles can tell apart; under WITH RECURSIVE."""
    return f"""outs AS MATERIALIZED (SELECT src, sum(weight) AS out FROM edges GROUP BY src),
links AS MATERIALIZED (SELECT e.src, e.dst, e.weight / out::DOUBLE AS share FROM edges e JOIN outs USING (src)),
places AS MATERIALIZED (SELECT v, (SELECT count(*) FROM vertices) AS n, v NOT IN (SELECT src FROM outs) AS stuck FROM vertices),
walked(step, v, score) AS (SELECT 0, v, 1.0::DOUBLE / n FROM places UNION ALL
SELECT any_value(step) + 1, p.v, (0.15::DOUBLE + 0.85::DOUBLE * sum(CASE WHEN stays THEN x ELSE 0 END)) / any_value(n) + 0.85::DOUBLE * sum(CASE WHEN stays THEN 0 ELSE x END)
FROM places p JOIN (SELECT step, false AS stays, dst AS v, score * share AS x FROM walked JOIN links ON v = src WHERE step < {steps}
  UNION ALL SELECT step, true, q.v, m FROM (SELECT any_value(step) AS step, coalesce(sum(CASE WHEN stuck THEN score END), 0) AS m FROM walked JOIN places USING (v) WHERE step < {steps} HAVING count(*) > 0)
  CROSS JOIN places q) USING (v) GROUP BY p.v),
pagerank AS (SELECT v, score FROM walked WHERE step = {steps})"""


def schedule_sql(batch: float = BATCH, limit: float = 0.5, count: str = "(SELECT count(*) FROM vertices)") -> str:
    """schedule(batch, size, first_rank, last_rank, fraction_removed); to be used under WITH RECURSIVE."""
    return f"""total AS MATERIALIZED (SELECT {count}::BIGINT AS n),
steps(batch, size, gone) AS (SELECT 0, 0::BIGINT, 0::BIGINT UNION ALL
  SELECT batch + 1, k, gone + k FROM (SELECT batch, gone, least(n - gone, greatest(1, ceil({batch}::DOUBLE * (n - gone))::BIGINT)) AS k
  FROM steps, total WHERE gone < {limit}::DOUBLE * n AND gone < n)),
schedule AS MATERIALIZED (SELECT batch, size, CASE WHEN batch = 0 THEN 0 ELSE gone - size + 1 END AS first_rank, gone AS last_rank,
  gone / n::DOUBLE AS fraction_removed FROM steps, total)"""


def orders_sql(trials: int = TRIALS) -> str:
    """run_scores, orders(scenario, v, rank), removed(scenario, v, batch)."""
    return f"""strengths AS (SELECT v, coalesce(o.w, 0) AS o, coalesce(i.w, 0) AS i FROM vertices
  LEFT JOIN (SELECT src, sum(weight) AS w FROM edges GROUP BY src) o ON v = o.src
  LEFT JOIN (SELECT dst, sum(weight) AS w FROM edges GROUP BY dst) i ON v = i.dst),
run_scores AS (SELECT concat('random|', t) AS scenario, v, 0.0::DOUBLE AS score FROM vertices, range({trials}) r(t)
  UNION ALL SELECT 'out_strength|0', v, o FROM strengths UNION ALL SELECT 'in_strength|0', v, i FROM strengths),
orders_ranked AS (SELECT scenario, v, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, md5(concat('{RUN_SEED}|', scenario, '|', v))) AS rank FROM run_scores),
removed AS MATERIALIZED (SELECT scenario, v, batch FROM orders_ranked JOIN schedule ON rank BETWEEN first_rank AND last_rank WHERE batch > 0),
scenarios AS MATERIALIZED (SELECT DISTINCT scenario FROM run_scores)"""


def layered_flow_sql(removed: str = "removed", edge_deaths: str | None = None) -> str:
    """deaths(scenario, src, dst, k) and flows(scenario, batch, flow) in closed form; needs scenarios and schedule."""
    deaths = edge_deaths or f"""SELECT s.scenario, e.src, e.dst, least(coalesce(a.batch, 1000000000), coalesce(b.batch, 1000000000)) AS k
  FROM scenarios s CROSS JOIN edges e LEFT JOIN {removed} a ON a.scenario = s.scenario AND a.v = e.src
  LEFT JOIN {removed} b ON b.scenario = s.scenario AND b.v = e.dst"""
    return f"""deaths AS MATERIALIZED ({deaths}),
mids AS (SELECT scenario, batch, CASE WHEN src LIKE 'P|%' THEN src ELSE dst END AS mid,
  count(*) FILTER (WHERE dst LIKE 'P|%') AS ins, count(*) FILTER (WHERE src LIKE 'P|%') AS outs
  FROM deaths JOIN schedule ON k > batch GROUP BY ALL),
flows AS MATERIALIZED (SELECT s.scenario, b.batch, coalesce(sum(least(ins, outs)), 0)::BIGINT AS flow
  FROM scenarios s CROSS JOIN schedule b LEFT JOIN mids m ON m.scenario = s.scenario AND m.batch = b.batch GROUP BY ALL)"""


RUN_KEYS = "split_part(scenario, '|', 1) AS strategy, split_part(scenario, '|', 2)::INTEGER AS trial"


def flows_sql(trials: int = TRIALS) -> str:
    """curves(strategy, trial, batch, fraction_removed, flow) of the runs; to be used under WITH RECURSIVE."""
    return f"""{trade_sql()},
{schedule_sql()},
{orders_sql(trials)},
{layered_flow_sql()},
curves AS MATERIALIZED (SELECT {RUN_KEYS}, batch, fraction_removed, flow FROM flows JOIN schedule USING (batch))"""


def labels_sql() -> str:
    """timeline(scenario, v, removed_at, silenced_at), pair_labels(scenario, s, m, k) of the layered runs in closed form."""
    far = 1000000000
    return f"""gone AS MATERIALIZED (SELECT s.scenario, v.v, coalesce(r.batch, {far}) AS died FROM scenarios s CROSS JOIN vertices v
  LEFT JOIN removed r ON r.scenario = s.scenario AND r.v = v.v),
mid_labels AS MATERIALIZED (SELECT i.scenario, i.v, least(i.died, max(s.died)) AS label FROM edges e JOIN gone i ON i.v = e.dst AND e.dst LIKE 'P|%'
  JOIN gone s ON s.v = e.src AND s.scenario = i.scenario GROUP BY i.scenario, i.v, i.died),
end_labels AS (SELECT m.scenario, m.v, least(m.died, max(i.label)) AS label FROM edges e JOIN gone m ON m.v = e.dst AND e.dst LIKE 'S|%'
  JOIN mid_labels i ON i.v = e.src AND i.scenario = m.scenario GROUP BY m.scenario, m.v, m.died),
all_labels AS (SELECT * FROM mid_labels UNION ALL SELECT * FROM end_labels UNION ALL SELECT scenario, v, died FROM gone WHERE v LIKE 'C|%'),
timeline AS MATERIALIZED (SELECT g.scenario, g.v, CASE WHEN g.died < {far} THEN g.died END AS removed_at,
  CASE WHEN coalesce(l.label, 0) < g.died THEN coalesce(l.label, 0) END AS silenced_at
  FROM gone g LEFT JOIN all_labels l ON l.scenario = g.scenario AND l.v = g.v),
pair_labels AS MATERIALIZED (SELECT s.scenario, s.v AS s, m.v AS m, least(s.died, m.died, max(i.died)) AS k
  FROM edges a JOIN edges b ON b.src = a.dst JOIN gone s ON s.v = a.src JOIN gone i ON i.v = a.dst AND i.scenario = s.scenario
  JOIN gone m ON m.v = b.dst AND m.scenario = s.scenario GROUP BY s.scenario, s.v, m.v, s.died, m.died)"""


def runs_sql() -> str:
    """curves(strategy, trial, batch, fraction_removed, flow, reachable_pairs, avalanche)."""
    base = flows_sql().rsplit("curves AS MATERIALIZED", 1)[0]
    return f"""{base}{labels_sql()},
pair_counts AS (SELECT scenario, batch, count(*) AS reachable_pairs FROM pair_labels JOIN schedule ON k > batch GROUP BY ALL),
cuts AS (SELECT scenario, silenced_at AS batch, count(*) AS newly FROM timeline WHERE silenced_at IS NOT NULL GROUP BY ALL),
curves AS MATERIALIZED (SELECT {RUN_KEYS.replace("scenario", "f.scenario")}, f.batch, fraction_removed, flow, coalesce(reachable_pairs, 0)::BIGINT AS reachable_pairs,
  CASE WHEN f.batch > 0 THEN coalesce(newly, 0) END::BIGINT AS avalanche
  FROM flows f JOIN schedule USING (batch) LEFT JOIN pair_counts p ON p.scenario = f.scenario AND p.batch = f.batch
  LEFT JOIN cuts c ON c.scenario = f.scenario AND c.batch = f.batch)"""
