"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent and normalised. The exponent in [0, 1] is bisected to
the largest value (the mix nearest to the natural one) that meets a target entropy, or the smallest
that keeps every source within a repetition limit. The weights are then realised under a token
budget: each source's documents are hashed into blocks, the blocks are permuted anew for every
epoch, and blocks are taken until the source's share of the budget is spent; in the block where it
ends, documents are taken in hashed order.

With ``budget=None`` the budget is the smallest at which every source is seen whole at least once:
then no document is lost, and weights come from repetition alone.

All sums over sources are Spark aggregates, of 63 exponents at a time (the interval shrinks 64-fold
in a round), so the number of sources isn't bounded by the driver.

Defined results: tokens are runs of anything but white space; a null text has none, and such
documents (as those without words) go with their blocks, but not with one that is cut. A null source is
a source of its own. Sources without any token get no weight, and their documents appear once.
Repeated rows are mixed as documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

POINTS = 63
ROUNDS = 6
#: Blocks of a source at most: those of one epoch are ordered in one task (some 40 bytes each). Larger sources have larger blocks.
MOST_BLOCKS = 1 << 17


@dataclass(frozen=True)
class Mix:
    exponent: float
    budget: int
    tokens: int
    #: source, tokens, weight, target (tokens of the budget), repeats
    sources: DataFrame


def _largest(counts: DataFrame, total: int, exponent_of, meets) -> float:
    """The largest x in [0, 1] that meets the target, which holds up to some x; 0 if none does.

    exponent_of: x to exponent; meets: of (exponent, sum s^a, sum s^a ln s, largest s, smallest s).
    """
    share = F.col("tokens") / F.lit(float(total))
    low, high = 0.0, 1.0
    for k in range(ROUNDS):
        points = [low + (high - low) * i / (POINTS + 1) for i in range(POINTS + 2)]
        powers = [F.pow(share, F.lit(float(exponent_of(x)))) for x in points]
        row = counts.agg(
            *[F.sum(p).alias(f"z{i}") for i, p in enumerate(powers)],
            *[F.sum(p * F.log(share)).alias(f"l{i}") for i, p in enumerate(powers)],
            F.max(share).alias("most"),
            F.min(share).alias("least"),
        ).first()
        ok = [meets(exponent_of(x), row[f"z{i}"], row[f"l{i}"], row["most"], row["least"]) for i, x in enumerate(points)]
        if k == 0 and all(ok):
            return 1.0
        i = next((i for i, x in enumerate(ok) if not x), len(ok) - 1)
        if i == 0:
            return low
        low, high = points[i - 1], points[i]
    return low


def temperature_weights(counts: DataFrame, max_repeat: float | None = 4.0, min_entropy: float | None = None, budget: int | None = None) -> Mix:
    """``counts``: (source, tokens), tokens > 0. ``min_entropy`` (nats) is the target if given, else ``max_repeat``."""
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        empty = counts.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("target"), F.lit(0.0).alias("repeats"))
        return Mix(1.0, budget or 0, 0, empty)

    def spent(a: float, z: float, most: float) -> float:
        return float(budget) if budget is not None else total * most ** (1 - a) * z

    if min_entropy is not None:
        exponent = _largest(counts, total, lambda x: x, lambda a, z, l, most, least: math.log(z) - a * l / z >= min_entropy - 1e-12)
    else:  # the flatter the mix, the more often small sources repeat
        exponent = 1 - _largest(counts, total, lambda x: 1 - x, lambda a, z, l, most, least: spent(a, z, most) * least ** (a - 1) / (z * total) <= max_repeat + 1e-9)
    share = F.col("tokens") / F.lit(float(total))
    z, most = counts.agg(F.sum(F.pow(share, F.lit(exponent))), F.max(share)).first()
    all_in = int(round(spent(exponent, z, most)))
    weight = F.round(F.pow(share, F.lit(exponent)) / F.lit(z), 15)
    aim = F.round(weight * F.lit(all_in)).cast("long")
    if budget is None:  # rounding mustn't cost the largest source its last document
        aim = F.greatest(aim, F.col("tokens"))
    return Mix(exponent, all_in, total, counts.select("source", "tokens", weight.alias("weight"), aim.alias("target"), (aim / F.col("tokens")).alias("repeats")))


def mix_sources(
    docs: DataFrame,
    max_repeat: float | None = 2.0,
    min_entropy: float | None = None,
    budget: int | None = None,
    seed: int = 17,
    block_tokens: int = 1 << 20,
    columns: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each time a document is taken: doc_id, source, n_tokens, epoch, block, rank, place,
    or the named columns of ``docs`` instead, in the order of the mix.

    ``rank``: the block's place in its source's permutation of that epoch; ``place`` (0 to 1): where
    the block stands in its source's whole run. Ordering by it interleaves the sources evenly.
    Texts stay in their rows while the mix is planned: the plan (a row a source, and a row a block and
    epoch) comes to them. With ``columns`` the rows are then put into ranges of ``place`` and sorted
    within them, so that a table written from the result holds the mix in its order of files and rows.
    """
    own = docs.select(
        *[F.col(c).alias(f"__{c}") for c in columns or []],
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    own = own.withColumn("at", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("n_tokens")))
    facts = ["doc_id", "source", "n_tokens", "at"]
    rows = written(own.select(facts), "mix-rows")
    counts = written(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-sources")
    mix = temperature_weights(counts.where("tokens > 0"), max_repeat, min_entropy, budget)
    plan = counts.withColumnRenamed("source", "s").join(mix.sources.select(F.col("source").alias("s2"), "target"), F.expr("s <=> s2"), "left").select(
        "s",
        F.coalesce(F.expr("target div tokens"), F.lit(1)).alias("whole"),
        F.coalesce(F.expr("target % tokens"), F.lit(0)).alias("rest"),
        F.coalesce("target", F.lit(0)).alias("target"),
        "tokens",
        F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(16), F.ceil(F.col("tokens") / F.lit(block_tokens)))).alias("n_blocks"),
    )
    plan = written(plan, "mix-plan")

    def blocked(table: DataFrame) -> DataFrame:
        return table.join(plan, F.expr("source <=> s")).withColumn("block", F.pmod("at", F.col("n_blocks")).cast("long"))

    def order(epoch: Column) -> Column:
        return F.xxhash64(F.lit(seed), epoch, F.col("source"), F.col("block"))

    blocks = blocked(rows).groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"), *[F.first(c).alias(c) for c in ("whole", "rest", "target", "tokens")])
    blocks = written(blocks, "mix-blocks")
    epochs = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole")))).where("epoch < whole or rest > 0")
    run = Window.partitionBy("source", "epoch").orderBy(order(F.col("epoch")), "block")
    epochs = epochs.withColumn("rank", F.row_number().over(run) - 1).withColumn("before", F.sum("block_tokens").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens"))
    epochs = epochs.where("epoch < whole or before < rest").select(
        F.col("source").alias("s"),
        F.col("block").alias("b"),
        "epoch",
        "rank",
        (F.when(F.col("target") > 0, (F.col("epoch") * F.col("tokens") + F.col("before")) / F.col("target")).otherwise(0.0)).alias("place"),
        F.when((F.col("epoch") == F.col("whole")) & (F.col("before") + F.col("block_tokens") > F.col("rest")), F.col("rest") - F.col("before")).alias("room"),
    )
    epochs = written(epochs, "mix-epochs")
    same = F.expr("source <=> s and block = b")
    # Where a source's budget ends, documents are taken in hashed order up to a last one; at most one block a source.
    draw = F.struct(F.xxhash64(F.lit(seed), "epoch", "at").alias("h"), F.col("doc_id").alias("i"), F.col("at").alias("a"))
    within = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    ends = epochs.where("room is not null")
    last = blocked(rows.where("n_tokens > 0")).drop("s").join(ends, same).withColumn("draw", draw).withColumn("upto", F.sum("n_tokens").over(within))
    last = last.where("upto <= room").groupBy("source").agg(F.max("draw").alias("last")).withColumnRenamed("source", "s3")
    steps = written(epochs.join(last, F.expr("s <=> s3 and room is not null"), "left").drop("s3"), "mix-steps")
    taken = blocked(own).drop("s").join(steps, same).where(F.col("room").isNull() | ((F.col("n_tokens") > 0) & (draw <= F.col("last"))))
    if columns:
        # Within a place the order is by hash, so equal places of several sources and copies spread over tasks.
        mixed = taken.select(*[F.col(f"__{c}").alias(c) for c in columns], F.col("place").alias("__place"), F.xxhash64("epoch", "at", "doc_id").alias("__tie"))
        return mixed.repartitionByRange("__place", "__tie").sortWithinPartitions("__place", "__tie").select(*columns)
    return taken.select("doc_id", "source", "n_tokens", "epoch", "block", "rank", "place")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """A row for each time a document of ``documents`` is taken; see above for nulls, repeats and empty tables."""
    return mix_sources(table(spark, sf_dir, "documents"))
