"""Token counts from the exact histogram of encoded lengths.

Documents are counted by length before any shuffle leaves a task; the histogram has one row per distinct length. Suffix sums
over it (documents and tokens of at least a length) answer totals, quantiles and truncated totals for every context limit.
Suffix sums are taken inside blocks of ``BLOCK`` lengths and shifted by the totals of later blocks.

Nulls and odd input: a null or empty text has length 0 and is counted; repeated rows are counted each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.llm.tables import query, read, with_arrow
from fraygraph.llm.token_output import SLICE, tokenizer_file
from fraygraph.llm.tokens import worker_ids
from fraygraph.session import hint_small, store

BLOCK = 4096


def with_lengths(documents: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``documents`` plus n_tokens, without an end id."""
    def run(texts):
        ids = worker_ids(tokenizer or tokenizer_file())
        lengths = []
        for i in range(0, len(texts), SLICE):
            lengths += [len(c) // 4 for c in ids.encode([t or "" for t in texts[i : i + SLICE]])]
        return {"n_tokens": lengths}

    return with_arrow(documents, [text], "n_tokens long", run)


def length_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per distinct length: docs_at_least and tokens_at_least (suffix sums), docs, tokens (totals of all documents),
    truncated_total (tokens if every document is cut to this length) and quantile (share of documents not longer)."""
    histogram = store(histogram)  # read several times below, encoded once
    blocked = histogram.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)  # a row per 4,096 lengths
    everything = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = blocked.groupBy("_block").agg(F.sum("n_docs").alias("_docs_in"), F.sum("_tokens").alias("_tokens_in"))
    sums = sums.select(
        "_block",
        F.coalesce(F.sum("_docs_in").over(later), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_tokens_in").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs_in").over(everything).alias("docs"),
        F.sum("_tokens_in").over(everything).alias("tokens"),
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    joined = blocked.withColumns({"_docs_own": F.sum("n_docs").over(inside), "_tokens_own": F.sum("_tokens").over(inside)})
    joined = joined.join(hint_small(sums), "_block")
    docs_at_least = F.col("_docs_own") + F.col("_docs_after")
    tokens_at_least = F.col("_tokens_own") + F.col("_tokens_after")
    return joined.select(
        "n_tokens", "n_docs", docs_at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"), "docs", "tokens",
        (F.col("tokens") - tokens_at_least + F.col("n_tokens") * docs_at_least).alias("truncated_total"),
        ((F.col("docs") - docs_at_least + F.col("n_docs")) / F.col("docs")).alias("quantile"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, tokens_kept, docs_cut) of every context limit, read off the suffix sums in one aggregation.

    The next longer length that occurs carries everything needed: its suffix sums are those of all longer documents.
    """
    longer = [
        F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("n_tokens") > limit, F.col("n_tokens"))) for limit in limits
    ]
    rows = sums.agg(
        F.array(*[F.struct(F.lit(n).cast("long").alias("context"), x.alias("above")) for n, x in zip(limits, longer)]).alias("rows"),
        F.coalesce(F.max("tokens"), F.lit(0)).alias("tokens"),
    ).select("tokens", F.explode("rows").alias("r"))
    cut, beyond = (F.coalesce(F.col(f"r.above.{c}"), F.lit(0)) for c in ("docs_at_least", "tokens_at_least"))
    kept = F.col("tokens") - beyond + F.col("r.context") * cut
    return rows.select("r.context", kept.alias("tokens_kept"), cut.alias("docs_cut"))


def length_quantile(sums: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least ``share`` of the documents do not exceed."""
    return sums.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


@query("op9_token_counts")
def _(spark, sf):
    return suffix_sums(length_histogram(with_lengths(read(spark, sf, "documents", "text"))))
