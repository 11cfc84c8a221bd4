"""Mixing sources to target weights by pivotal rounding in a distributed reduction tree, with DataFrame functions only.

Every source has a target number of words, its documents share the ratio target / source size. The whole part of the ratio is
copied anyway; the fraction is the probability of one more copy. Pairs of documents exchange words at random until the
probability of one of them is 0 or 1; the words of the pair stay the same, and so do all probabilities in expectation. The
document left over goes on to the next pair. Groups of about ``GROUP`` documents are folded this way from the largest to the
smallest document, the documents left over form the groups of the next level, and one document per source is drawn last.

A source of any size is dealt to as many groups as it needs; a level keeps one row per group. Random numbers are hashes of
the seed, the level and the document, so reruns and retries agree.

Nulls and odd input: a null or wordless text has size 0 and takes 0 words, it is copied as often as a draw on the fraction
says; the null source is a source of its own, last in order; repeated rows are separate documents; an empty table gives no
rows; a table without words has targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.llm.tables import query, read, unused
from fraygraph.operators.ranking import number_ordered
from fraygraph.session import hint_small, store

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
GROUP = 256
SEED = 42
WORD = r"[^ \t\n\u000B\f\r]+"
NEAR = 1e-9


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, docs, target) from one row per source (source, source_size, docs).

    ``share`` of all words is dealt by weight; targets stop at ``most`` times the source, the excess goes to the others. With
    the sources in order of their limit per weight, those that stop are the first ones, so running sums give the level.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weighted = sizes.withColumn("_weight", F.element_at(table, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    limited = weighted.withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    by_limit = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last())
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    weights_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    levels = limited.withColumn("_level", rest / weights_left)
    open_level = F.max(F.when(F.col("_limit") / F.col("_weight") >= F.col("_level"), F.col("_level"))).over(everything)
    target = F.least("_limit", F.coalesce(open_level, F.lit(float("inf"))) * F.col("_weight"))
    return levels.select("source", "source_size", "docs", target.alias("target"))


def uniform(seed: int, level: int) -> Column:
    """A number in [0, 1) from the seed, the level and the document."""
    hashed = F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "nth", "source", "size")
    return F.pmod(hashed, F.lit(1 << 52)).cast("double") / float(1 << 52)


def _let(value: Column, function) -> Column:
    """``function(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _settled(p: Column) -> Column:
    return F.when(p < NEAR, 0.0).when(p > 1 - NEAR, 1.0).otherwise(p)


def _whole(p: Column) -> Column:
    return (p == 0.0) | (p == 1.0)


DOC = "struct<doc_id:bigint,source:string,size:bigint,nth:int>"
STATE = f"struct<doc:{DOC},p:double,done:array<struct<doc:{DOC},extra:int>>>"


def _meet(state: Column, unit: Column) -> Column:
    """One pair: the document left over so far and the next one."""
    here, there = state["doc"]["size"].cast("double"), unit["doc"]["size"].cast("double")
    room = F.struct(
        F.least((1 - state["p"]) * here, unit["p"] * there).alias("up"),
        F.least(state["p"] * here, (1 - unit["p"]) * there).alias("down"),
    )

    def moved(r: Column) -> Column:
        return F.when(unit["u"] * (r["up"] + r["down"]) < r["down"], r["up"]).otherwise(-r["down"])

    def settled(m: Column) -> Column:
        return F.struct(_settled(state["p"] + m / here).alias("a"), _settled(unit["p"] - m / there).alias("b"))

    def decided(doc: Column, p: Column) -> Column:
        return F.struct(doc.alias("doc"), p.cast("int").alias("extra"))

    def next_state(x: Column) -> Column:
        first, second = decided(state["doc"], x["a"]), decided(unit["doc"], x["b"])
        nobody = F.lit(None).cast(DOC)
        return (
            F.when(_whole(x["a"]) & _whole(x["b"]), F.struct(nobody.alias("doc"), F.lit(0.0).alias("p"), F.concat(state["done"], F.array(first, second)).alias("done")))
            .when(_whole(x["a"]), F.struct(unit["doc"].alias("doc"), x["b"].alias("p"), F.concat(state["done"], F.array(first)).alias("done")))
            .otherwise(F.struct(state["doc"].alias("doc"), x["a"].alias("p"), F.concat(state["done"], F.array(second)).alias("done")))
            .cast(STATE)
        )

    paired = _let(_let(_let(room, moved), settled), next_state)
    alone = F.struct(unit["doc"].alias("doc"), unit["p"].alias("p"), state["done"].alias("done")).cast(STATE)
    return F.when(state["doc"].isNull(), alone).otherwise(paired)


def fold_groups(units: DataFrame, level: int, seed: int) -> DataFrame:
    """Fold the groups of one level: one row (doc, p, done) per group; ``units`` has doc_id, source, size, nth, p and slot."""
    doc = F.struct("doc_id", "source", "size", "nth")
    unit = F.struct((-F.col("size")).alias("order"), uniform(seed, level).alias("u"), doc.alias("doc"), F.col("p").alias("p"))
    groups = units.groupBy("source", "slot").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    start = F.struct(F.lit(None).cast(DOC).alias("doc"), F.lit(0.0).alias("p"), F.array().alias("done")).cast(STATE)
    return groups.select(F.aggregate("units", start, _meet).alias("s")).select("s.doc", "s.p", "s.done")


def round_copies(documents: DataFrame, targets: DataFrame, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(doc_id, source, size, nth, copies, source_size, target) for the rows of ``documents`` (doc_id, source, size)."""
    counted = documents.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).cast("int").alias("_rows"))
    single = counted.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("_rows")))).drop("_rows")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = hint_small(targets.withColumnsRenamed({"source": "_source"}))
    joined = single.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    joined = joined.withColumn("_base", F.floor(ratio + NEAR).cast("int")).withColumn("p", F.greatest(_settled(ratio - F.col("_base")), F.lit(0.0)))
    units = store(joined)

    alone = _whole(F.col("p")) | (F.col("size") == 0)
    draw = F.when(_whole(F.col("p")), F.col("p").cast("int")).otherwise((uniform(seed, 0) < F.col("p")).cast("int"))
    extras = [units.filter(alone).select("doc_id", "source", "size", "nth", draw.alias("extra"))]
    level, left = 1, units.filter(~alone)
    largest = units.agg(F.max("docs")).first()[0] or 0
    groups_of = F.greatest(F.lit(1), F.ceil(F.col("docs") / group)).cast("long")
    left = left.withColumn("_groups", groups_of).select("doc_id", "source", "size", "nth", "p", "_groups")
    while True:
        slot = F.pmod(F.xxhash64(F.lit(seed), F.lit(-level), "doc_id", "nth", "size"), F.col("_groups"))
        folded = store(fold_groups(left.withColumn("slot", slot), level, seed))
        extras.append(folded.select(F.explode("done").alias("d")).select("d.doc.*", "d.extra"))
        remaining = folded.filter("doc IS NOT NULL").select("doc.*", "p")
        largest = -(-largest // group)
        if largest <= 1:
            extras.append(remaining.select("doc_id", "source", "size", "nth", (uniform(seed, level + 1) < F.col("p")).cast("int").alias("extra")))
            break
        counts = hint_small(remaining.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count(F.lit(1)) / group).alias("_groups")))
        left = remaining.join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        level += 1
    extra = extras[0]
    for more in extras[1:]:
        extra = extra.unionByName(more)
    extra = extra.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    copies = (F.floor(ratio + NEAR) + F.col("extra")).cast("int")
    return extra.select("doc_id", "source", "size", "nth", copies.alias("copies"), "source_size", "target")


def sized(documents: DataFrame, text: str = "text") -> DataFrame:
    return store(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size")))


def mix_copies(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """How often the mix takes every document; see ``round_copies``."""
    sizes = sized(documents)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    return round_copies(sizes, source_targets(sources, weights, share, most), seed)


def mix(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of ``documents``."""
    key_, size_, copies_, nth_ = unused(documents, "key", "size", "copies", "nth")

    def key(size: str) -> Column:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in ("doc_id", "source", size)]
        return F.concat_ws("\u0001", *parts)

    found = mix_copies(documents, weights, share, most, seed).select(key("size").alias(key_), F.col("nth").alias(nth_), F.col("copies").alias(copies_))
    found = store(found)
    keyed = documents.withColumn(size_, word_count()).withColumn(key_, key(size_))
    many = store(found.groupBy(key_).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(key_))
    if many.isEmpty():
        placed = keyed.join(found, key_)
    else:
        # Rows that share id, source and size (null ids above all) are told apart by their number, dealt to ranges.
        many = hint_small(many)
        placed = keyed.join(many, key_, "left_anti").join(found.join(many, key_, "left_anti").drop(nth_), key_)
        packed = keyed.join(many, key_, "left_semi").select(key_, F.struct(*keyed.columns).alias("packed"))
        crowded = number_ordered(packed, [key_], [F.col("packed.doc_id").asc(), F.col("packed.text").asc()], nth_)
        crowded = crowded.join(found, [key_, nth_]).select("packed.*", copies_)
        placed = placed.unionByName(crowded)
    times = F.explode(F.sequence(F.lit(1), F.col(copies_)))
    return placed.filter(F.col(copies_) > 0).withColumn(size_, times).select(*documents.columns)


@query("op4_mixture")
def _(spark, sf):
    found = mix_copies(read(spark, sf, "documents", "doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
