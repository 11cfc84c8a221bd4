"""Queries for sources, projections, joins, aggregates and rankings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraygraph.functions import scalars
from fraygraph.operators import central, curves, graph_build as B, ranking
from fraygraph.plans import graphs as G
from fraygraph.plans.registry import query
from fraygraph.session import checkpoint_folder, settle
from fraygraph.sources import tables as S
from fraygraph.streaming.edges import stream_edges

R = "WITH RECURSIVE "
TRADE = f"WITH {G.trade_sql()}"
FLOWS = R + G.flows_sql()


def _folder(spark, name):
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks ----------------------------------------------------------------------------------------------

CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_nationkey", T.IntegerType()),
    T.StructField("c_mktsegment", T.StringType()), T.StructField("c_side", T.StringType()),
])


@query("io1_read_entities", "SELECT c_custkey, c_nationkey, c_mktsegment, NULL::VARCHAR AS c_side FROM customer")
def _(spark, sf):
    return S.read_table(spark, f"{sf}/customer.parquet", CUSTOMER, ["c_custkey", "c_nationkey", "c_mktsegment", "c_side"])


@query("io2_write_edges", TRADE + " SELECT src, dst, weight, n::BIGINT AS n, left(src, 1) AS layer FROM raw")
def _(spark, sf):
    path = _folder(spark, "edges")
    S.write_table(G.trade_edges(spark, sf).withColumn("layer", F.substring("src", 1, 1)), path, ["layer"])
    return S.read_table(spark, path).select("src", "dst", "weight", "n", F.col("layer").cast("string").alias("layer"))


@query("io3_csv_and_json", TRADE + " SELECT v, n::BIGINT AS n, class, coalesce(role, 'other') AS role, round(n / 7.0::DOUBLE, 3) AS scaled FROM vertices")
def _(spark, sf):
    table, documents = _folder(spark, "nodes"), _folder(spark, "nodes-json")
    nodes = G.trade(spark, sf).vertices.withColumn("scaled", F.col("n") / 7)
    S.write_csv(nodes, table, {"scaled": 3})
    schema = "v string, n long, class string, role string, scaled double"
    S.write_json(S.read_csv(spark, table, schema), documents)
    return S.read_json(spark, documents, schema).na.fill("other", ["role"])


@query("io4_runs_from_curves", FLOWS + """ SELECT strategy, trial, count(*) AS points, round(sum(fraction_removed * batch), 9) AS weighted, max(fraction_removed) AS last,
sum(flow * batch)::BIGINT AS moment FROM curves GROUP BY ALL""")
def _(spark, sf):
    path = _folder(spark, "curves")
    table = G.trade_flows(spark, sf).select("strategy", "trial", "batch", "fraction_removed", "flow", F.lit(None).cast("long").alias("reachable_pairs"), F.lit(None).cast("long").alias("avalanche"))
    S.write_csv(table, path, {"fraction_removed": 4})
    runs = curves.nested_runs(S.load_curves(spark, path, G.trade(spark, sf).size), ["strategy", "trial"], ["fraction_removed", "flow"])
    total = lambda c: f"aggregate(transform({c}, (x, i) -> x * i), cast(0 as double), (a, x) -> a + x)"
    return runs.select(
        "strategy", "trial", F.size("flow").cast("long").alias("points"), F.round(F.expr(total("fraction_removed")), 9).alias("weighted"),
        F.element_at("fraction_removed", -1).alias("last"), F.expr(total("flow")).cast("long").alias("moment"),
    )


@query("io6_chunked_ingest", "SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(spark, sf):
    path, orders = _folder(spark, "chunks"), G.table(spark, sf, "orders")
    orders.repartition(6, "o_orderkey").write.parquet(path)
    whole = S.ingest_chunks(spark, path, orders.schema, expected=orders.count())
    return whole.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def entity_connections(spark, sf):
    """(pre, post, weight) customer -> part, as negative and positive entity ids of one id space."""
    lines = G.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = G.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select((-F.col("o_custkey") - 1).alias("pre"), F.col("l_partkey").alias("post"), F.col("l_quantity").alias("weight"))


def entity_labels(spark, sf, sized=False):
    buyers = G.table(spark, sf, "customer").selectExpr("-c_custkey - 1 AS entity", f"{G.CUSTOMER_LABEL} AS label")
    parts = G.table(spark, sf, "part").selectExpr("p_partkey AS entity", f"{G.SIZED_LABEL if sized else G.PART_LABEL} AS label")
    return buyers.unionByName(parts)


def _entity_sql(label, tail):
    return f"SELECT {G.CUSTOMER_LABEL} AS src, {label} AS dst, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey{tail}"


@query("io7_two_granularities", f"""SELECT 'coarse' AS level, src, dst, sum(weight) AS weight, count(*) AS n FROM ({_entity_sql(G.PART_LABEL, '')}) GROUP BY ALL
UNION ALL SELECT 'fine', src, dst, sum(weight), count(*) FROM ({_entity_sql(G.SIZED_LABEL, '')}) GROUP BY ALL""")
def _(spark, sf):
    tables = S.ingest_edges(entity_connections(spark, sf), {"coarse": entity_labels(spark, sf), "fine": entity_labels(spark, sf, True)})
    first, second = (t.withColumn("level", F.lit(name)) for name, t in tables.items())
    return first.unionByName(second)


@query("io8_last_write_wins", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(spark, sf):
    rows = G.table(spark, sf, "events").withColumn("arrival", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type", "arrival")
    return S.last_writes(rows, ["user_id"], "arrival").drop("arrival")


@query("io8_pending", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def _(spark, sf):
    done = G.table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return S.pending(G.table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


@query("io9_resumed_runs", "SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def _(spark, sf):
    store, customers = _folder(spark, "runs"), G.table(spark, sf, "customer")

    def work(todo):
        found = customers.join(todo, "c_mktsegment", "left_semi").groupBy("c_mktsegment")
        return found.agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))

    segments = customers.select("c_mktsegment").distinct()
    S.run_missing(segments.filter("c_mktsegment > 'F'"), store, ["c_mktsegment"], work)
    return S.run_missing(segments, store, ["c_mktsegment"], work)


@query("io10_export", TRADE + """ SELECT section, rows, keys FROM (
SELECT 'nodes' AS section, count(*) AS rows, sum(length(v))::BIGINT AS keys FROM vertices
UNION ALL SELECT 'edges', count(*), sum(length(concat(src, '>', dst)))::BIGINT FROM edges
UNION ALL SELECT 'nulls', 0, 0)""")
def _(spark, sf):
    graph = G.trade(spark, sf)
    edges = graph.edges.withColumn("key", F.concat_ws(">", "src", "dst"))
    sections = {
        "nodes": (["vertices"], lambda v: S.column_document(v.withColumn("key", F.col("v")), "key", ["key", "n", "class", "role"])),
        "edges": (["edges"], lambda e: S.column_document(e, "key", ["key", "weight", "share"])),
        "nulls": (["null_scores"], lambda s: s),
    }
    documents, manifest = S.export_sections({"vertices": graph.vertices, "edges": edges}, sections)
    sizes = [d.select(F.lit(n).alias("section"), F.col("rows").cast("long").alias("rows"), F.expr("aggregate(key, 0L, (a, x) -> a + length(x))").alias("keys")) for n, d in documents.items()]
    total = sizes[0].unionByName(sizes[1]).groupBy("section").agg(F.sum("rows").alias("rows"), F.sum("keys").alias("keys"))
    return manifest.join(total, "section", "left").na.fill(0, ["rows", "keys"]).select("section", "rows", "keys")


@query("st1_streamed_edges", f"SELECT src, dst, sum(weight) AS weight, count(*) AS n FROM ({_entity_sql(G.PART_LABEL, '')}) GROUP BY ALL")
def _(spark, sf):
    connections = entity_connections(spark, sf)
    source = _folder(spark, "arriving")
    connections.repartition(4, "pre").write.parquet(source)
    labels = settle(entity_labels(spark, sf))
    prepare = lambda stream: B.require_labelled(B.label_connections(stream, labels))
    return stream_edges(spark, source, connections.schema, prepare, f"stream-{uuid.uuid4().hex}", files_per_trigger=2)


# ---- projections, filters, scalar functions -------------------------------------------------------------------------


@query("pf1_sides", """SELECT side, count(*) AS lines FROM (SELECT coalesce(CASE WHEN l_returnflag = 'A' THEN 'L' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'R' END,
CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 'R' END, 'unknown') AS side FROM lineitem) GROUP BY side""")
def _(spark, sf):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    primary = F.when(flag == "A", "L").when((flag == "R") & (status == "O"), "R").when(flag == "R", "X")
    fallback = F.when((status == "F") & (flag == "N"), "R").otherwise("unknown")
    rows = G.table(spark, sf, "lineitem").select(primary.alias("a"), fallback.alias("b"))
    return rows.groupBy(B.first_known_side("a", "b").alias("side")).agg(F.count(F.lit(1)).alias("lines"))


@query("pf2_composite_keys", "SELECT label, side, count(*) AS customers FROM (SELECT concat('C|', c_nationkey) AS label, c_mktsegment AS side FROM customer) GROUP BY ALL")
def _(spark, sf):
    rows = G.table(spark, sf, "customer").select(F.concat_ws("|", F.lit("C"), "c_nationkey").alias("label"), F.col("c_mktsegment").alias("side"))
    names = rows.select(B.composite("label", "side").alias("v")).select(*B.split_composite("v"))
    return names.groupBy("label", "side").agg(F.count(F.lit(1)).alias("customers"))


@query("pf3_suffixes", """SELECT CASE WHEN i IS NULL THEN 'none' WHEN i LIKE '%\\_L' ESCAPE '\\' THEN 'L' WHEN i LIKE '%\\_R' ESCAPE '\\' THEN 'R' WHEN i LIKE '%\\_M' ESCAPE '\\' THEN 'M' ELSE 'other' END AS suffix,
count(*) AS parts FROM (SELECT CASE WHEN p_size > 5 THEN concat(p_name, '_', left(p_type, 1)) END AS i FROM part) GROUP BY 1""")
def _(spark, sf):
    rows = G.table(spark, sf, "part").selectExpr("CASE WHEN p_size > 5 THEN concat(p_name, '_', left(p_type, 1)) END AS i")
    return rows.groupBy(B.suffix_class("i").alias("suffix")).agg(F.count(F.lit(1)).alias("parts"))


@query("pf4_threshold_edges", TRADE + " SELECT src, dst, weight, share FROM edges")
def _(spark, sf):
    return B.threshold_edges(G.trade_edges(spark, sf), 0.01)


@query("pf5_leaf_regions", """SELECT r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name NOT IN ('ASIA', 'AFRICA') AND NOT contains(r_name, 'MIDDLE') AND NOT contains(r_name, 'ROPE') GROUP BY 1""")
def _(spark, sf):
    nations = G.table(spark, sf, "nation").join(G.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = ~F.col("r_name").isin("ASIA", "AFRICA") & ~F.col("r_name").contains("MIDDLE") & ~F.col("r_name").contains("ROPE")
    suppliers = G.table(spark, sf, "supplier").join(nations.filter(leaf), F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.groupBy("r_name").agg(F.count(F.lit(1)).alias("suppliers"))


@query("pf6_codes", TRADE + """, words AS (SELECT class, (row_number() OVER (ORDER BY class) - 1)::INTEGER AS class_code FROM (SELECT DISTINCT class FROM vertices))
SELECT v, CASE role WHEN 'S' THEN 1 WHEN 'M' THEN 2 ELSE 0 END AS role_code, coalesce(class_code, -1)::INTEGER AS class_code FROM vertices LEFT JOIN words USING (class)""")
def _(spark, sf):
    rows = scalars.encode(G.trade(spark, sf).vertices, "class", "class_code")
    return rows.select("v", F.coalesce(scalars.role_code(F.col("role")), F.lit(0)).alias("role_code"), "class_code")


@query("pf7_rounding", """SELECT l_orderkey, l_linenumber, l_partkey, round_even(x * 1000, 0) / 1000 AS rounded, CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE
round_even(x * pow(10.0::DOUBLE, 3 - floor(log10(abs(x))) - 1), 0) / pow(10.0::DOUBLE, 3 - floor(log10(abs(x))) - 1) END AS three FROM
(SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * l_discount AS x FROM lineitem)""")
def _(spark, sf):
    x = F.col("l_extendedprice") * F.col("l_discount")
    return G.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.rounded(x, 3).alias("rounded"), scalars.significant(x, 3).alias("three"))


@query("pf9_informative_rows", """SELECT l_partkey, sum(l_discount * 100)::BIGINT AS a, sum(l_tax * 100)::BIGINT AS b FROM lineitem GROUP BY 1 HAVING a <> 0 OR b <> 0""")
def _(spark, sf):
    from fraygraph.operators.knockout import informative

    sums = G.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.rint(F.sum(F.col("l_discount") * 100)).cast("long").alias("impact_left"), F.rint(F.sum(F.col("l_tax") * 100)).cast("long").alias("impact_right")
    )
    kept = informative(sums.withColumn("impact_both", F.lit(0)))
    return kept.select("l_partkey", F.col("impact_left").alias("a"), F.col("impact_right").alias("b"))


@query("pf10_name_search", """SELECT p_name, hit_group::INTEGER AS hit_group, place::INTEGER AS place FROM (SELECT DISTINCT p_name, CASE WHEN instr(lower(p_name), 're') = 1 THEN 0 ELSE 1 END AS hit_group,
CASE WHEN instr(lower(p_name), 're') = 1 THEN length(p_name) ELSE instr(lower(p_name), 're') END AS place FROM part WHERE instr(lower(p_name), 're') > 0)
ORDER BY hit_group, place, length(p_name), p_name LIMIT 8""")
def _(spark, sf):
    return scalars.name_search(G.table(spark, sf, "part").select("p_name").distinct(), "p_name", "re", 8)


# ---- joins ----------------------------------------------------------------------------------------------------------


@query("j1_label_connections", f"""SELECT src, dst, count(*) AS n FROM (SELECT {G.CUSTOMER_LABEL} AS src, CASE WHEN p_partkey IS NOT NULL THEN {G.SIZED_LABEL} END AS dst
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey) GROUP BY ALL""")
def _(spark, sf):
    labelled = B.require_labelled(B.label_connections(entity_connections(spark, sf), entity_labels(spark, sf, True)))
    return B.aggregate_edges(labelled).select("src", "dst", "n")


@query("j1_unlabelled_ends", "SELECT DISTINCT l_partkey AS entity FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(spark, sf):
    connections = entity_connections(spark, sf)
    labels = entity_labels(spark, sf).join(G.table(spark, sf, "part").filter("p_size <= 10"), F.col("entity") == F.col("p_partkey"), "left_anti")
    return B.unlabelled_ends(connections, labels).select("entity")


@query("j2_region_counts", f"""SELECT {G.PART_LABEL} AS label, s_nationkey AS region, sum(l_quantity) AS pre, count(*) AS post FROM lineitem
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size <= 40 GROUP BY ALL""")
def _(spark, sf):
    return region_counts(spark, sf, "p_size <= 40").groupBy("label", "region").agg(F.sum("pre").alias("pre"), F.sum("post").alias("post"))


def region_counts(spark, sf, keep="true"):
    """(label, region, pre, post): counts per labelled part and supplier nation; parts outside ``keep`` have no label."""
    lines = G.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    counts = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("pre"), F.count(F.lit(1)).alias("post"))
    nations = G.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("region"))
    labels = G.table(spark, sf, "part").selectExpr("p_partkey", f"CASE WHEN {keep} THEN {G.PART_LABEL} END AS label").dropna(subset=["label"])
    return counts.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).join(labels, F.col("l_partkey") == F.col("p_partkey")).select("label", "region", "pre", "post")


ANCHOR_SQL = f"""anchor_sums AS (SELECT {G.PART_LABEL} AS v, s_nationkey AS region, sum(l_quantity) + count(*) AS total FROM lineitem
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
anchors AS (SELECT v, arg_min(region, (-total, region)) AS region FROM anchor_sums WHERE total > 0 GROUP BY v)"""


def anchors(spark, sf):
    from fraygraph.operators.profile import anchor_regions

    return anchor_regions(region_counts(spark, sf))


@query("j3_atlas", f"WITH {G.trade_sql()}, {ANCHOR_SQL} SELECT v, class, n, coalesce(degree, 0) AS degree, region FROM vertices LEFT JOIN "
       "(SELECT v, count(*) AS degree FROM (SELECT src AS v FROM edges UNION ALL SELECT dst FROM edges) GROUP BY v) USING (v) LEFT JOIN anchors USING (v)")
def _(spark, sf):
    graph = G.trade(spark, sf)
    degree = B.degrees(graph.edges, graph.vertices).select("v", F.col("degree").cast("long").alias("degree"))
    return graph.vertices.select("v", "class", "n").join(degree, "v", "left").join(anchors(spark, sf), "v", "left")


@query("j4_dangling_ends", TRADE + " SELECT DISTINCT dst AS v FROM edges WHERE dst NOT IN (SELECT v FROM vertices WHERE role IS NULL OR n > 3)")
def _(spark, sf):
    graph = G.trade(spark, sf)
    return B.dangling_ends(graph.edges.filter("src is not null"), graph.vertices.filter("role is null or role = 'S' or n > 3"))


@query("j5_induced", TRADE + ", keep AS (SELECT v FROM vertices WHERE n > 5) SELECT src, dst, weight, share FROM edges WHERE src IN (FROM keep) AND dst IN (FROM keep)")
def _(spark, sf):
    graph = G.trade(spark, sf)
    return B.induced(graph.edges, graph.vertices.filter("n > 5"))


@query("j6_vertex_deletion", TRADE + """
SELECT scenario, count(*) AS edges, sum(weight) AS weight FROM (SELECT DISTINCT class AS scenario FROM vertices), edges e
WHERE NOT EXISTS (SELECT 1 FROM vertices WHERE class = scenario AND (v = src OR v = dst)) GROUP BY 1""")
def _(spark, sf):
    from fraygraph.session import replicate

    graph = G.trade(spark, sf)
    removals = graph.vertices.select(F.col("class").alias("scenario"), "v")
    left = B.without_vertices(replicate(graph.edges, removals.select("scenario").distinct()), removals)
    return left.groupBy("scenario").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


@query("j7_edge_prefix", TRADE + """, ranked AS (SELECT *, row_number() OVER (ORDER BY weight DESC, md5(concat('5|strongest|0|', src, '|', dst))) AS r FROM edges)
SELECT src, dst, r::INTEGER AS rank FROM ranked WHERE r > (SELECT count(*) // 4 FROM edges)""")
def _(spark, sf):
    from fraygraph.operators.removal import edge_orders

    graph = G.trade(spark, sf)
    orders = edge_orders(graph, 1, 5).filter(F.col("order") == "strongest")
    return orders.filter(F.col("rank") > graph.edges.count() // 4).select("src", "dst", "rank")


@query("j9_partners", TRADE + """ SELECT dst AS v, src AS partner, class, weight, rank::INTEGER AS rank FROM
(SELECT dst, src, weight, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS rank FROM edges) JOIN vertices ON src = v WHERE rank <= 5""")
def _(spark, sf):
    graph = G.trade(spark, sf)
    return B.top_partners(graph.edges, graph.vertices, "in", 5)


@query("j10_reference_rows", TRADE + """ SELECT 'S' AS kind, class AS name, count(*) AS size, 'measured' AS origin FROM vertices WHERE role = 'S' GROUP BY class
UNION ALL SELECT 'other', class, count(*), 'measured' FROM vertices WHERE role IS NULL GROUP BY class
UNION ALL SELECT 'S', r_name, count(*), 'reference' FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def _(spark, sf):
    graph = G.trade(spark, sf)
    kind = F.when(F.col("role") == "S", "S").otherwise("other")
    own = graph.vertices.filter("role is null or role <> 'M'").groupBy(kind.alias("kind"), F.col("class").alias("name")).agg(F.count(F.lit(1)).alias("size"))
    nations = G.table(spark, sf, "nation").join(G.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    given = nations.groupBy(F.lit("S").alias("kind"), F.col("r_name").alias("name")).agg(F.count(F.lit(1)).alias("size"))
    return own.withColumn("origin", F.lit("measured")).unionByName(given.withColumn("origin", F.lit("reference")))


# ---- aggregates -----------------------------------------------------------------------------------------------------


@query("ag1_aggregate_edges", TRADE + " SELECT src, dst, weight, n::BIGINT AS n FROM raw")
def _(spark, sf):
    return G.trade_edges(spark, sf)


@query("ag2_merge_edges", TRADE + " SELECT src, dst, weight, n::BIGINT AS n FROM raw")
def _(spark, sf):
    rows = G.trade_connections(spark, sf)
    chunks = [rows.filter(F.pmod(F.xxhash64("src", "dst", "weight"), F.lit(2)) == part) for part in (0, 1)]
    return B.merge_edges(*[c.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")) for c in chunks])


ENTITY_SQL = f"""entities AS (SELECT {G.PART_LABEL} AS label, CASE WHEN p_size > 3 THEN p_type END AS class, p_size AS pre, p_size + 1 AS post FROM part)"""


def part_entities(spark, sf):
    return G.table(spark, sf, "part").selectExpr(f"{G.PART_LABEL} AS label", "CASE WHEN p_size > 3 THEN p_type END AS class", "p_size AS pre", "p_size + 1 AS post")


@query("ag3_node_summary", f"""WITH {ENTITY_SQL}, k AS (SELECT label, class, count(*) AS c FROM entities GROUP BY ALL)
SELECT label AS v, count(*) AS n, sum(pre)::BIGINT AS total_pre, sum(post)::BIGINT AS total_post,
coalesce((SELECT arg_min(class, (-c, class)) FROM k WHERE k.label = e.label AND class IS NOT NULL), 'unannotated') AS class FROM entities e GROUP BY label""")
def _(spark, sf):
    return B.summarize_nodes(part_entities(spark, sf))


@query("ag4_majority_share", """WITH k AS (SELECT o_custkey, coalesce(s, 'unannotated') AS status, count(*) AS c FROM (SELECT o_custkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderstatus END AS s FROM orders) GROUP BY ALL)
SELECT o_custkey, arg_min(status, (-c, status)) AS status, max(c) AS count, sum(c)::BIGINT AS total, max(c) / sum(c) AS share FROM k GROUP BY 1""")
def _(spark, sf):
    rows = G.table(spark, sf, "orders").selectExpr("o_custkey", "CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderstatus END AS status")
    return B.majority(rows, "o_custkey", "status", null_competes=True)


@query("ag5_terminals", f"WITH {G.handover_sql()} SELECT v, role FROM terminals")
def _(spark, sf):
    events = G.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("v"), F.col("event_type").alias("class"))
    return B.terminals_from_classes(B.majority(events, "v", "class"), ["signup"], ["purchase"])


@query("ag5_class_rollup", f"WITH {G.handover_sql()} SELECT class, count(*) AS labels, sum(n)::BIGINT AS entities FROM vertices GROUP BY class")
def _(spark, sf):
    return B.class_rollup(G.handover(spark, sf).vertices)


COMPARTMENT_SQL = f"""sides AS (SELECT {G.SIZED_LABEL} AS v, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS o, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS f
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'A' GROUP BY 1),
compartments AS (SELECT concat('P|', p_brand, '|', p_size) AS v, coalesce(any_value(o), 0) AS o, coalesce(any_value(f), 0) AS f FROM part LEFT JOIN sides ON v = concat('P|', p_brand, '|', p_size) GROUP BY 1)"""


@query("ag6_compartments", f"WITH {COMPARTMENT_SQL} SELECT v, o, f, CASE WHEN o + f > 0 THEN o / (o + f) END AS share, CASE WHEN o > f THEN 'O' WHEN o < f THEN 'F' END AS compartment FROM compartments")
def _(spark, sf):
    from fraygraph.operators.profile import compartments

    lines = G.table(spark, sf, "lineitem").filter("l_returnflag <> 'A'").groupBy("l_partkey", "l_linestatus").agg(F.sum("l_quantity").alias("count"))
    parts = G.table(spark, sf, "part").selectExpr("p_partkey", f"{G.SIZED_LABEL} AS v")
    counts = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("v", F.col("l_linestatus").alias("compartment"), "count")
    table = compartments(counts, parts.select("v").distinct(), "O", "F")
    return table.select("v", F.col("first").alias("o"), F.col("second").alias("f"), "share", "compartment")


@query("ag7_anchor_regions", f"WITH {ANCHOR_SQL} SELECT v, region FROM anchors")
def _(spark, sf):
    return anchors(spark, sf)


@query("ag8_schema_profile", """SELECT property, filled, values FROM (SELECT 'event_type' AS property, count(event_type) AS filled, count(DISTINCT event_type) AS values FROM events
UNION ALL SELECT 'user_id', count(user_id), count(DISTINCT user_id) FROM events
UNION ALL SELECT 'big_value', count(CASE WHEN value > 50 THEN value END), count(DISTINCT CASE WHEN value > 50 THEN value END) FROM events)""")
def _(spark, sf):
    from fraygraph.operators.profile import profile

    rows = G.table(spark, sf, "events").selectExpr("event_type", "user_id", "CASE WHEN value > 50 THEN value END AS big_value")
    return profile(rows, ["event_type", "user_id", "big_value"])


@query("ag9_laterality", """SELECT soma, root, suffix, count(*) AS n FROM (SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS soma, l_linestatus AS root,
CASE WHEN l_discount > 0.05 THEN 'R' WHEN l_discount IS NULL THEN 'none' ELSE 'other' END AS suffix FROM lineitem) GROUP BY ALL""")
def _(spark, sf):
    name = "CASE WHEN l_discount > 0.05D THEN 'x_R' ELSE 'x' END"
    rows = G.table(spark, sf, "lineitem").selectExpr("CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS soma", "l_linestatus AS root", f"{name} AS i")
    return rows.groupBy("soma", "root", B.suffix_class("i").alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


# ---- ranking and scores ---------------------------------------------------------------------------------------------


@query("w1_input_shares", TRADE + " SELECT src, dst, weight, share FROM shares")
def _(spark, sf):
    return B.input_shares(G.trade_edges(spark, sf)).select("src", "dst", "weight", "share")


@query("w2_select_top", TRADE + """, o AS (SELECT src AS v, sum(weight) AS w FROM edges GROUP BY 1)
SELECT class, v, rank::INTEGER AS rank FROM (SELECT class, v, row_number() OVER (PARTITION BY class ORDER BY coalesce(w, 0) DESC, md5(concat('3|', class, '|', v))) AS rank FROM vertices LEFT JOIN o USING (v)) WHERE rank <= 4""")
def _(spark, sf):
    graph = G.trade(spark, sf)
    scored = B.degrees(graph.edges, graph.vertices).join(graph.vertices.select("v", "class"), "v").withColumn("tie", ranking.random_key(3, "class", "v"))
    return ranking.top_k(scored, ["class"], "out_strength", "tie", 4).select("class", "v", "rank")


@query("w3_schedule", R + G.trade_sql() + ", " + G.schedule_sql(0.01) + " SELECT batch, size::INTEGER AS size, first_rank::INTEGER AS first_rank, last_rank::INTEGER AS last_rank, fraction_removed FROM schedule")
def _(spark, sf):
    return ranking.schedule_table(spark, G.trade(spark, sf).size, 0.01)


@query("w4_edge_orders", TRADE + """, o AS (SELECT * FROM edges, (VALUES ('strongest', 1), ('weakest', -1), ('random', 0)) x(ord, sign), range(2) t(trial))
SELECT ord AS "order", trial::INTEGER AS trial, src, dst, row_number() OVER (PARTITION BY ord, trial ORDER BY weight * sign DESC, md5(concat('5|', ord, '|', trial, '|', src, '|', dst)))::INTEGER AS rank FROM o""")
def _(spark, sf):
    from fraygraph.operators.removal import edge_orders

    return edge_orders(G.trade(spark, sf), 2, 5).select("order", "trial", "src", "dst", "rank")


@query("w4_exact_rank_large", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, md5(concat('1|', l_orderkey, '|', l_linenumber, '|', l_partkey, '|', l_suppkey, '|', floor(l_extendedprice)::BIGINT)))::INTEGER AS rank FROM lineitem""")
def _(spark, sf):
    lines = G.table(spark, sf, "lineitem").withColumn("price", F.floor("l_extendedprice"))
    lines = lines.withColumn("tie", ranking.random_key(1, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"))
    return ranking.exact_rank(lines, ["l_returnflag"], "l_quantity", "tie").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rank")


@query("w9_percentiles", """WITH t AS (SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_totalprice) AS c, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, 100.0::DOUBLE * (r - 1 + (c + 1) / 2.0::DOUBLE - 0.5::DOUBLE) / n AS pct FROM t""")
def _(spark, sf):
    return ranking.with_percentile(G.table(spark, sf, "orders"), "o_totalprice", "pct").select("o_orderkey", "pct")


@query("w10_competition_rank", "SELECT l_partkey, quantity, rank() OVER (ORDER BY quantity DESC) AS rank, count(*) OVER (PARTITION BY quantity) AS ties FROM (SELECT l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)")
def _(spark, sf):
    sums = G.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    return ranking.competition_rank(sums, "quantity").select("l_partkey", "quantity", "rank", "ties")


@query("w13_target_order", TRADE + """ SELECT v AS m, (row_number() OVER (ORDER BY CASE class WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 2 END, v) - 1)::INTEGER AS rank FROM vertices WHERE role = 'M'""")
def _(spark, sf):
    from fraygraph.operators.knockout import target_order

    graph = G.trade(spark, sf)
    return target_order(graph, graph.vertices, ["EUROPE", "ASIA"])


@query("w14_top_report", TRADE + " SELECT src, dst, weight, share FROM edges ORDER BY weight DESC, share DESC, src, dst LIMIT 25")
def _(spark, sf):
    return G.trade(spark, sf).edges.orderBy(F.desc("weight"), F.desc("share"), "src", "dst").limit(25)


@query("se1_same_size_draws", f"{R}{G.trade_sql()}, sizes AS (SELECT DISTINCT count(*) AS size FROM vertices GROUP BY class), {G.draws_sql(200, 9)} SELECT size::INTEGER AS size, draw::INTEGER AS draw, v FROM draws")
def _(spark, sf):
    from fraygraph.operators.knockout import same_size_draws

    graph = G.trade(spark, sf)
    sizes = graph.vertices.groupBy("class").count().select(F.col("count").alias("size"))
    return same_size_draws(graph.vertices, sizes, 200, 9, graph.size)


@query("se2_run_seeds", FLOWS + " SELECT strategy, trial, (42 + 1000 * CASE strategy WHEN 'random' THEN 0 WHEN 'out_strength' THEN 1 ELSE 2 END + trial)::INTEGER AS seed FROM curves GROUP BY ALL")
def _(spark, sf):
    from fraygraph.operators.removal import run_seed

    runs = G.trade_flows(spark, sf).select("strategy", "trial").distinct()
    index = F.when(F.col("strategy") == "random", 0).when(F.col("strategy") == "out_strength", 1).otherwise(2)
    return runs.withColumn("seed", run_seed(index, F.col("trial")))


@query("se3_weighted_choice", f"""WITH {ANCHOR_SQL}, u AS (SELECT v, region, total, sum(total) OVER (PARTITION BY v ORDER BY region) AS upto, sum(total) OVER (PARTITION BY v) AS whole,
('0x' || left(md5(concat('4|', v)), 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM anchor_sums WHERE total > 0)
SELECT v, min(region) AS region FROM u WHERE upto > u * whole GROUP BY v""")
def _(spark, sf):
    from fraygraph.operators.profile import weighted_choice

    return weighted_choice(region_counts(spark, sf), 4)


@query("ct1_degrees", TRADE + """, i AS (SELECT dst AS v, count(*) AS k, sum(weight) AS w FROM edges GROUP BY 1), o AS (SELECT src AS v, count(*) AS k, sum(weight) AS w FROM edges GROUP BY 1)
SELECT v, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree, coalesce(i.w, 0) AS in_strength, coalesce(o.w, 0) AS out_strength
FROM vertices LEFT JOIN i USING (v) LEFT JOIN o USING (v)""")
def _(spark, sf):
    graph = G.trade(spark, sf)
    return B.degrees(graph.edges, graph.vertices)


@query("ct2_strengths", TRADE + """ SELECT v, coalesce(w, 0) AS out_strength, coalesce(x, 0) AS in_strength FROM vertices
LEFT JOIN (SELECT src AS v, sum(weight) AS w FROM edges GROUP BY 1) USING (v) LEFT JOIN (SELECT dst AS v, sum(weight) AS x FROM edges GROUP BY 1) USING (v)""")
def _(spark, sf):
    graph = G.trade(spark, sf)
    out, inn = central.strategy_scores("out_strength", graph), central.strategy_scores("in_strength", graph)
    return out.select("v", F.col("score").alias("out_strength")).join(inn.select("v", F.col("score").alias("in_strength")), "v")
