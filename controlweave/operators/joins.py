"""Equi joins that stay balanced when one key holds much of either side."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from controlweave.functions.conditions import quoted

# A key of at most this many right rows fits any single task.
SPLIT_ABOVE_ROWS = 10_000_000


def key_condition(pairs: list[tuple[str, str]]) -> Column:
    return reduce(and_, [quoted(left) == quoted(right) for left, right in pairs])


def equi_join(
    left: DataFrame,
    right: DataFrame,
    pairs: list[tuple[str, str]],
    how: str,
    rows_per_key: int | None = None,
    split_above: int = SPLIT_ABOVE_ROWS,
) -> DataFrame:
    """``left`` or ``inner`` join on distinct column names.

    Adaptive execution splits a hot key of the left side in any join, but a hot
    key of the right side only in an inner join. So where a key may hold very
    many right rows (``rows_per_key`` bounds them), the keys that do are measured
    in the plan and salted: their right rows are spread, their left rows repeated
    once per share. All other rows go through the same join unchanged.

    Where a right row goes follows from its values alone: equal rows of a hot key are
    counted, dealt to the shares by arithmetic, and repeated after the join. So a task
    that runs again, over rows in another order, makes the same rows.
    """
    condition = key_condition(pairs)
    if how == "inner" or rows_per_key is None or rows_per_key <= split_above:
        return left.join(right, condition, how)
    names = [f"_hot_{i}" for i in range(len(pairs))]
    keys = [quoted(r).alias(n) for (_, r), n in zip(pairs, names)]
    counted = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > split_above)
    # at most one row per ``split_above`` right rows
    hot = F.broadcast(counted.select(*names, F.ceil(F.col("_rows") / max(split_above, 1)).alias("_shares")))
    beside = lambda frame, own: frame.join(hot, reduce(and_, [quoted(c) == F.col(n) for c, n in zip(own, names)]), "left")
    shares = F.coalesce("_shares", F.lit(1))
    marked = beside(left, [l for l, _ in pairs])
    repeated = marked.select(
        *[quoted(c) for c in left.columns], "_shares", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("_share")
    )
    own = [quoted(c) for c in right.columns]
    measured = beside(right, [r for _, r in pairs])
    cool = measured.filter(F.col("_shares").isNull()).select(*own, F.lit(0).cast("long").alias("_salt"), F.lit(1).cast("long").alias("_copies"))
    warm = measured.filter(F.col("_shares").isNotNull()).groupBy(*own, "_shares").agg(F.count(F.lit(1)).alias("_n"))
    warm = warm.withColumn("_parts", F.least("_shares", "_n"))
    warm = warm.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part")).select(
        *own,
        F.pmod(F.xxhash64(*own) + F.col("_part"), F.col("_shares")).alias("_salt"),
        (F.floor(F.col("_n") / F.col("_parts")) + (F.col("_part") < F.col("_n") % F.col("_parts")).cast("long")).alias("_copies"),
    )
    joined = repeated.join(cool.union(warm), condition & (F.col("_share") == F.col("_salt")), "left")
    # a hot key has matches: a share of it without any is no miss
    matched = joined.filter(F.col("_shares").isNull() | F.col("_salt").isNotNull())
    copies = F.explode(F.array_repeat(F.lit(0), F.coalesce("_copies", F.lit(1)).cast("int"))).alias("_copy")
    columns = [quoted(c) for c in [*left.columns, *right.columns]]
    return matched.select(*columns, copies).select(*columns)


def latest_per_key(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of every key; ``order`` lists the columns from most to least
    significant, largest first. Spark keeps one row per key and task before the
    shuffle, so a hot key costs no more than the number of tasks."""
    window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(
        *[quoted(c).desc_nulls_last() for c in order]
    )
    return frame.withColumn("_rank", F.row_number().over(window)).filter("_rank <= 1").drop("_rank")
