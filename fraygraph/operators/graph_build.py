"""From entity and connection tables to a group graph: labelling, aggregation, shares, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.session import dealt, hint_small, replicate

UNANNOTATED = "unannotated"


def first_known_side(primary: str, fallback: str) -> Column:
    """The primary side if it is L, R or M, else the fallback side if it is L or R, else unknown."""
    return F.coalesce(
        F.when(F.col(primary).isin("L", "R", "M"), F.col(primary)),
        F.when(F.col(fallback).isin("L", "R"), F.col(fallback)),
        F.lit("unknown"),
    )


def composite(label: str, side: str) -> Column:
    return F.concat_ws("|", F.col(label), F.col(side))


def split_composite(name: str) -> list[Column]:
    """(label, side), split at the last separator."""
    side = F.substring_index(F.col(name), "|", -1)
    label = F.expr(f"left({name}, length({name}) - length(substring_index({name}, '|', -1)) - 1)")
    return [label.alias("label"), side.alias("side")]


def suffix_class(name: str) -> Column:
    """Side suffix of an instance name: L, R or M; other for any other ending; none for a missing name."""
    text = F.col(name)
    hit = [F.when(F.endswith(text, F.lit(f"_{side}")), side) for side in ("L", "R", "M")]
    return F.when(text.isNull(), "none").otherwise(F.coalesce(*hit, F.lit("other")))


def label_connections(connections: DataFrame, labels: DataFrame) -> DataFrame:
    """(pre, post, weight) by entity -> (src, dst, weight) by label. ``labels`` is (entity, label).

    Unlabelled ends keep a null label; ``unlabelled_ends`` lists them and ``require_labelled`` turns them into an error.
    """
    pre = labels.select(F.col("entity").alias("pre"), F.col("label").alias("src"))
    post = labels.select(F.col("entity").alias("post"), F.col("label").alias("dst"))
    return connections.join(pre, "pre", "left").join(post, "post", "left").select("src", "dst", "weight")


def unlabelled_ends(connections: DataFrame, labels: DataFrame) -> DataFrame:
    ends = connections.select(F.explode(F.array("pre", "post")).alias("entity")).distinct()
    return ends.join(labels, "entity", "left_anti")


def require_labelled(labelled: DataFrame) -> DataFrame:
    """Fail the job at the first row without a label, inside the scan that reads it (no extra pass)."""
    message = F.lit("connection end without a label")
    return labelled.select(
        F.coalesce("src", F.raise_error(message)).alias("src"),
        F.coalesce("dst", F.raise_error(message)).alias("dst"),
        "weight",
    )


def aggregate_edges(labelled: DataFrame) -> DataFrame:
    """(src, dst, weight, n). Partial sums before the one shuffle, so a hot label pair costs one row per task."""
    return labelled.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def merge_edges(*parts: DataFrame) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def input_shares(edges: DataFrame) -> DataFrame:
    """Adds ``share``: weight over the total weight entering dst, self-loops and weak edges included.

    The totals are an aggregate joined back, not a window, so that a hot target is summed map-side.
    """
    totals = edges.groupBy("dst").agg(F.sum("weight").alias("_total"))
    return edges.join(totals, "dst").withColumn("share", F.col("weight") / F.col("_total")).drop("_total")


def threshold_edges(edges: DataFrame, tau: float) -> DataFrame:
    """Edges between different labels that give at least ``tau`` of their target's input."""
    kept = input_shares(edges).filter((F.col("share") >= F.lit(float(tau))) & (F.col("src") != F.col("dst")))
    return kept.select("src", "dst", "weight", "share")


def majority(df: DataFrame, key: str, value: str, null_competes: bool = False, blank: str = UNANNOTATED) -> DataFrame:
    """(key, value, count, total, share): the most frequent value per key, ties to the smallest value.

    With ``null_competes`` a missing value counts as the category ``blank``; without, it is ignored unless all are null.
    """
    filled = F.coalesce(F.col(value), F.lit(blank))
    counts = df.groupBy(key, filled.alias(value), F.col(value).isNull().alias("_null")).agg(F.count(F.lit(1)).alias("count"))
    if null_competes:
        counts = counts.groupBy(key, value).agg(F.sum("count").alias("count"), F.lit(False).alias("_null"))
    order = F.struct((~F.col("_null")).cast("int").alias("known"), F.col("count"))
    best = counts.groupBy(key).agg(F.max(order).alias("_top"), F.sum("count").alias("total"))
    tied = counts.join(best, key).filter(order == F.col("_top"))
    return (
        tied.groupBy(key)
        .agg(F.min(value).alias(value), F.first("count").alias("count"), F.first("total").alias("total"))
        .withColumn("share", F.col("count") / F.col("total"))
    )


def summarize_nodes(entities: DataFrame) -> DataFrame:
    """(v, n, class, total_pre, total_post) from entities (label, class, pre, post)."""
    totals = entities.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pre").alias("total_pre"), F.sum("post").alias("total_post")
    )
    classes = majority(entities, "label", "class").select("label", "class")
    return totals.join(classes, "label").withColumnRenamed("label", "v")


def terminals_from_classes(assigned: DataFrame, source_classes: list[str], target_classes: list[str]) -> DataFrame:
    """(v, role) with role S or M from (v, class)."""
    role = F.when(F.col("class").isin(source_classes), "S").when(F.col("class").isin(target_classes), "M")
    return assigned.select("v", role.alias("role")).filter("role is not null")


def class_rollup(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("class").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("entities"))


def dangling_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edge ends that are no vertex; must be empty."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    return ends.join(vertices.select("v"), "v", "left_anti")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    keep = members.select("v")
    return edges.join(keep, edges.src == keep.v, "left_semi").join(keep, F.col("dst") == keep.v, "left_semi")


def without_vertices(edges: DataFrame, removals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges of a scenario-keyed edge table whose ends are both still there. ``removals`` is (scenario, v)."""
    by = by or ["scenario"]
    gone = removals.select(*by, "v").distinct()
    left = edges.join(gone.withColumnRenamed("v", "src"), [*by, "src"], "left_anti")
    return left.join(gone.withColumnRenamed("v", "dst"), [*by, "dst"], "left_anti")


def top_partners(edges: DataFrame, attributes: DataFrame, direction: str, k: int) -> DataFrame:
    """(v, partner, class, weight, rank): the k heaviest partners of every vertex on one side.

    Two passes: k survivors per (vertex, salt), then k of those, so no hub is sorted in one task.
    """
    v, other = ("dst", "src") if direction == "in" else ("src", "dst")
    pairs = edges.select(F.col(v).alias("v"), F.col(other).alias("partner"), "weight")
    pairs = pairs.withColumn("_salt", F.pmod(F.xxhash64("partner"), F.lit(16)))
    order = [F.col("weight").desc(), F.col("partner")]
    local = pairs.withColumn("_rn", F.row_number().over(Window.partitionBy("v", "_salt").orderBy(*order))).filter(F.col("_rn") <= k)
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy(*order))).filter(F.col("rank") <= k)
    classes = attributes.select(F.col("v").alias("partner"), "class")
    return ranked.join(classes, "partner", "left").select("v", "partner", "class", "weight", "rank")


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, in_degree, out_degree, degree, in_strength, out_strength), zeros kept; one shuffle for all five."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("wo"), (F.col("weight") * 0).alias("wi")),
                F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i"), (F.col("weight") * 0).alias("wo"), F.col("weight").alias("wi")),
            )
        ).alias("e")
    ).select("e.*")
    sums = ends.groupBy("v").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("wi").alias("in_strength"), F.sum("wo").alias("out_strength")
    )
    table = vertices.select("v").join(sums, "v", "left").na.fill(0, ["in_degree", "out_degree", "in_strength", "out_strength"])
    return table.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


class Graph:
    """Settled vertices (v, ...), edges (src, dst, weight) and terminals (v, role)."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, terminals: DataFrame):
        self.vertices, self.edges, self.terminals = vertices, edges, terminals
        self._size: int | None = None
        self._disjoint = False
        self._arcs: DataFrame | None = None
        self.layers: bool | None = None

    @property
    def spark(self):
        return self.edges.sparkSession

    @property
    def size(self) -> int:
        if self._size is None:
            self._size = self.vertices.count()
        return self._size

    @property
    def sources(self) -> DataFrame:
        return self.terminals.filter("role = 'S'").select("v").join(self.vertices.select("v"), "v", "left_semi")

    @property
    def targets(self) -> DataFrame:
        return self.terminals.filter("role = 'M'").select("v").join(self.vertices.select("v"), "v", "left_semi")

    def spread(self, rows: DataFrame, scenarios: DataFrame) -> DataFrame:
        """Rows with a column v, once per scenario they belong to: every scenario of a single graph."""
        return replicate(rows, scenarios)

    def arcs(self) -> DataFrame:
        """(src, dst), broadcast when counted small, else held dealt by src: steps along the edges read them where they lie."""
        if self._arcs is None:
            arcs = self.edges.select("src", "dst")
            small = hint_small(arcs)
            self._arcs = dealt(arcs, ["src"])[0] if small is arcs else small
        return self._arcs

    def overlapping_terminals(self) -> DataFrame:
        return self.terminals.groupBy("v").agg(F.countDistinct("role").alias("roles")).filter("roles > 1")

    def require_disjoint_terminals(self) -> "Graph":
        if not self._disjoint:
            if not self.overlapping_terminals().isEmpty():
                raise ValueError("a vertex is both a source and a target")
            self._disjoint = True
        return self


class GraphEnsemble(Graph):
    """Many graphs over the same vertices as one disjoint union: vertices are 'g|v', scenarios 'g|...'.

    A scenario only meets the vertices of its own member, so one job serves all members.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, terminals: DataFrame, members: DataFrame):
        name = lambda c: F.concat_ws("|", "g", c)
        spread_v = replicate(vertices.select("v"), members.select(F.col("g").alias("scenario"))).withColumnRenamed("scenario", "g")
        spread_t = replicate(terminals, members.select(F.col("g").alias("scenario"))).withColumnRenamed("scenario", "g")
        super().__init__(
            spread_v.select(name("v").alias("v")),
            edges.select(name("src").alias("src"), name("dst").alias("dst"), "weight"),
            spread_t.select(name("v").alias("v"), "role"),
        )
        self.member_size = vertices.count()

    @property
    def size(self) -> int:
        return self.member_size

    def spread(self, rows: DataFrame, scenarios: DataFrame) -> DataFrame:
        """Equi-join on member and a salt, so that neither a member's vertices nor its scenarios meet in one task."""
        salts = F.explode(F.sequence(F.lit(0), F.lit(7)))
        left = rows.withColumn("_g", F.substring_index("v", "|", 1)).withColumn("_salt", salts)
        right = scenarios.withColumn("_g", F.substring_index("scenario", "|", 1)).withColumn("_salt", F.pmod(F.xxhash64("scenario"), F.lit(8)).cast("int"))
        return left.join(right, ["_g", "_salt"]).drop("_g", "_salt")
