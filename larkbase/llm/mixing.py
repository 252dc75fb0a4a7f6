"""Mixing sources to target weights by capped water-filling.

Sources get a share of the budget by weight. A source whose share would exceed its maximum of epochs is clamped
there and its excess is shared by weight among the rest, until none is above. Filling sources in the order of
capacity per weight reaches that fixed point in one pass of running sums over the table of sources.

A source's target is met by whole repetitions of all its documents and one more repetition of a seeded part of
them: documents are ordered by a hash of the seed and their id, whose running sum of sizes is taken over hash
buckets, so no source is ever sorted or gathered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_small, word_count, written

#: Hash buckets per source for the seeded order.
BUCKETS = 16_384


def _hash(id_col: str, seed: int, part: int) -> Column:
    """32 bits of a hash of seed and id, as long."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """From (source, source_size), adds weight and target (double).

    Sources in code-point order, null last, take the weights in turn. The table of sources is pre-aggregated;
    it alone passes through one task. If the budget exceeds all capacities, every source is at its capacity.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    rows = sources.withColumn("rank", rank).withColumn("weight", F.get(cycle, ((F.col("rank") - 1) % len(weights)).cast("int"))).withColumn("cap", cap)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    rows = rows.withColumn("left", budget - F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("full", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    rest = budget - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(rest * F.col("weight") / weight)
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2,
    seed: int = 17,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents with struct column ``mix``: size, source_size, target, repeats, taken (size times repeats).

    Size is the number of words; null and empty texts have 0. A null source is a source of its own. Rows with
    the same id share their hash and so their fate; null ids are alike. A source without words has target 0.
    Reruns with the same seed agree. A column named mix is replaced.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "mix"])
    sized = docs.select(
        kept.alias("__doc"),
        F.struct(F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), (_hash(id_col, seed, 0) % BUCKETS).alias("bucket"), _hash(id_col, seed, 1).alias("draw")).alias("mix"),
    )
    filled = written(sized.groupBy("mix.source", "mix.bucket").agg(F.sum("mix.size").alias("mass"), F.count("*").alias("n")), "mix-histogram")
    plan = targets(filled.groupBy("source").agg(F.sum("mass").alias("source_size")), weights, share, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    running = filled.withColumn("upto", F.sum("mass").over(Window.partitionBy("source").orderBy("bucket")))
    edge = running.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("upto") > F.col("need")))
    edge = edge.groupBy("p.source").agg(F.min(F.struct("bucket", "upto", "mass", "n")).alias("edge"))
    plan = plan.alias("p").join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
    part = (F.col("need") - (F.col("edge.upto") - F.col("edge.mass"))) / F.col("edge.mass")
    plan = plan.select(
        F.col("p.source").alias("plan_source"), "source_size", "target", "whole", F.when((F.col("need") <= 0) & (F.col("source_size") > 0), -1).otherwise(F.coalesce("edge.bucket", F.lit(BUCKETS))).alias("edge"), part.alias("part"), (F.col("edge.n") == 1).alias("alone")
    )
    rows = join_small(sized, plan, F.col("mix.source").eqNullSafe(F.col("plan_source")))
    chance = F.when(F.col("alone"), F.lit(0.5)).otherwise((F.col("mix.draw") + 0.5) / 2.0**32)
    more = (F.col("mix.bucket") < F.col("edge")) | ((F.col("mix.bucket") == F.col("edge")) & (chance <= F.col("part")))
    repeats = F.col("whole") + F.when(more, 1).otherwise(0)
    return rows.select(
        "__doc.*",
        F.struct(F.col("mix.size").alias("size"), "source_size", "target", repeats.alias("repeats"), (F.col("mix.size") * repeats).alias("taken")).alias("mix"),
    )


def mixed(docs: DataFrame, **settings: object) -> DataFrame:
    """The mixture itself: each document as many times as the mix takes it, with its own columns."""
    rows = mix(docs, **settings)
    doc = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "mix"]).alias("doc")
    return rows.where("mix.repeats > 0").select(doc, F.explode(F.sequence(F.lit(1), F.col("mix.repeats").cast("int"))).alias("copy")).select("doc.*")
