"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed for each source, a repetition rate per source follows from its target, and every document is emitted
floor(rate) times plus one more time if a coin seeded by its id falls below the fraction.

Defined cases: a null source is a source of its own, ranked last. A null text has size 0. Sources without any word have
target and rate 0, so their documents are emitted no time. Documents of equal id share one coin. An empty table gives an
empty mix. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.common import fresh, word_count

SEED = 20240501


def coin(id_column: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row per source from sizes (source, source_size).

    Sources in code point order, null last, take the weights in turn and share `share` times all sizes by weight. No
    target exceeds `most` times its source's size; the excess is shared again by weight until none does. That is the
    level L with sum(min(cap, weight * L)) = total: sources sorted by cap / weight fill up in this order, so running
    sums find the first one that stays below its cap, and L with it. The table has a row per source, not per document.
    """
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    rows = sizes.select("source", F.col("source_size").cast("double").alias("s"), "source_size", turn.cast("double").alias("w"))
    rows = rows.where("s > 0").select("*", (F.lit(most) * F.col("s")).alias("cap"), (F.lit(share) * F.sum("s").over(whole)).alias("total"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.select("*", F.row_number().over(order).alias("k"), ((F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)).alias("level"))
    below = F.col("level") * F.col("w") < F.col("cap")
    final = F.min_by(F.when(below, F.col("level")), F.when(below, F.col("k"))).over(whole)
    filled = rows.select("source", F.least(F.col("cap"), F.coalesce(final * F.col("w"), F.col("cap"))).alias("target"))
    return sizes.alias("a").join(filled.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "a.source_size", F.coalesce("b.target", F.lit(0.0)).alias("target"))


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED, names: tuple[str, ...] = ("size", "source_size", "target", "copies")) -> DataFrame:
    """docs with each document's size, its source's size and target, and the times the mix takes it.

    The join's small side has a row per source. Spark broadcasts it only if its measured size is below the session's
    threshold, and otherwise splits the partitions of a source that holds many rows.
    """
    size, source_size, target, copies, own = fresh(docs, *names, "mix_source")
    sized = docs.withColumn(size, word_count(F.col(text)))
    sizes = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    targets = source_targets(sizes, weights, share, most).select(F.col("source").alias(own), F.col("source_size").alias(source_size), F.col("target").alias(target))
    joined = sized.join(targets, F.col(source).eqNullSafe(F.col(own)), "left").drop(own)
    rate = F.when(F.col(source_size) > 0, F.least(F.col(target) / F.col(source_size), F.lit(float(most)))).otherwise(0.0)
    return joined.withColumn(copies, (F.floor(rate) + (coin(F.col(key), seed) < rate - F.floor(rate)).cast("long")).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as the plan takes it. Rows without a word are no part of it."""
    names = tuple(fresh(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies"))
    planned = plan_mix(docs, names=names, **options).where((F.col(names[3]) > 0) & (F.col(names[0]) > 0))
    (turn,) = fresh(planned, "mix_turn")
    return planned.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(names[3]).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
