"""Mixing sources to target weights.

Tokens are summed for each source; sources in the order of their names get the weights in turn and a
share of the budget by weight; a target that would ask for more than ``cap`` times its source stops
there, and what is left over is shared again among the others. A document is then emitted
floor(rate) times, and once more if a draw seeded by its id falls below the fraction.

Null texts have size 0; a null source is a source of its own, the last; sources without tokens have
target 0. The draw depends on doc_id and seed (on the text where doc_id is null), so that reruns agree
and repeated rows share their fate. An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkblot.llm.common import fresh, n_words, written

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"


def source_rates(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``rate``: one row for each source.

    The water level of the capped shares is found in one pass over sources in the order of cap by
    weight: all before the first whose share stays below its cap are capped. Only this table, a row for
    each source, goes through unpartitioned windows.
    """
    sums = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    w = F.element_at(F.array(*(F.lit(int(x)) for x in weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sums.withColumn("_rank", F.row_number().over(by_name)).withColumn("_w", w.cast("long"))
        .withColumn("_full", F.col("source_size") * F.lit(cap)).withColumn("_ratio", F.col("_full") / F.col("_w"))
    )
    order = Window.orderBy("_ratio", "_rank")
    filled = (
        ranked.withColumn("_at", F.row_number().over(order))
        .withColumn("_used", F.sum("_full").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_full"))
        .withColumn("_left", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.sum("source_size").over(whole) * F.lit(share) - F.col("_used")) / F.col("_left"))
    )
    first = F.min(F.when(F.col("_level") < F.col("_ratio"), F.struct("_at", "_level"))).over(whole)["_level"]
    target = F.least(F.col("_full"), F.coalesce(F.col("_w") * first, F.col("_full")))
    return filled.withColumn("target", target).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1, always the same for an id and a seed."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 48))


def with_copies(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """The rows and columns of ``docs``, with ``_mix``: source_size, target, rate and copies.

    The rates are written out first, a row for each source, so that Spark sees their true size and
    broadcasts them only if they are below its threshold.
    """
    rates = written(source_rates(docs.select("source", "text"), **shares), "mixing-rates")
    name = fresh(docs, "_mix")
    rates = rates.select(F.col("source").alias(f"{name}_source"), F.struct("source_size", "target", "rate").alias(f"{name}_row"))
    joined = docs.join(rates, docs["source"].eqNullSafe(rates[f"{name}_source"]))
    row = F.col(f"{name}_row")
    whole = F.floor(row["rate"])
    copies = (whole + (draw(docs["doc_id"], docs["text"], seed) < row["rate"] - whole).cast("long")).alias("copies")
    return joined.select(*(docs[c] for c in docs.columns), F.struct(row["source_size"].alias("source_size"), row["target"].alias("target"), row["rate"].alias("rate"), copies).alias(name))


def mixed(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as the mix takes it, same columns."""
    out = with_copies(docs, seed, **shares)
    name = out.columns[-1]
    often = F.col(name)["copies"].cast("int")
    again = fresh(out, "_again")
    return out.where(often > 0).withColumn(again, F.explode(F.sequence(F.lit(1), often))).select(*docs.columns)


def mix_report(docs: DataFrame, **shares) -> DataFrame:
    """For every document what the mix takes of it: doc_id, size, source_size, target, taken, copies."""
    out = with_copies(docs.select("doc_id", "source", "text"), **shares)
    mix = F.col(out.columns[-1])
    size = n_words(F.col("text"))
    return out.select(
        "doc_id", size.alias("size"), mix["source_size"].alias("source_size"), mix["target"].alias("target"),
        (size * mix["copies"]).alias("taken"), mix["copies"].alias("copies"),
    )
