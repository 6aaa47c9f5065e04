"""Repeatable samples of a population.

Every row gets a draw: the md5 of its key and the seed. The rows with the lowest
draws are the sample, so the same rows come back whatever the partitioning, the
size is exact, and another engine can reproduce the choice.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from operator import and_
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from controlweave.functions.conditions import quoted
from controlweave.operators.names import Lineage
from controlweave.operators.population import Joined
from controlweave.plans.spec import Sampling
from controlweave.session import shared_folder

# Draws are counted by their first hex digits: at most 16**PREFIX counts.
PREFIX = 4
# Copies of one row are written out in blocks of this many rows per task.
COPY_BLOCK = 1_000_000

Quota = Callable[[Column], Column]


def draw(columns: list[str], seed: int) -> Column:
    """md5 of the key columns and the seed; lengths keep different rows apart."""
    parts = []
    for name in columns:
        text = quoted(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat_ws("#", *parts, F.lit(str(seed))))


def rounded(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("long")


def fixed_quota(n: int) -> Quota:
    return lambda total: F.lit(n).cast("long")


def share_quota(share: float) -> Quota:
    return lambda total: rounded(total * F.lit(float(share)))


def statistical_quota(plan: Sampling) -> Quota:
    """Cochran's size for a proportion of one half, corrected for a finite population."""
    z = NormalDist().inv_cdf((1 + plan.confidence_level) / 2)
    infinite = z * z * 0.25 / (plan.precision * plan.precision)

    def quota(total: Column) -> Column:
        size = F.ceil(F.lit(infinite) / (1 + (F.lit(infinite) - 1) / total)).cast("long")
        size = F.greatest(size, F.lit(plan.min_sample_size).cast("long"))
        if plan.max_sample_size is not None:
            size = F.least(size, F.lit(plan.max_sample_size).cast("long"))
        return size

    return quota


def same_stratum(left: list[str], right: list[str]) -> Column:
    return reduce(and_, [quoted(a).eqNullSafe(quoted(b)) for a, b in zip(left, right)])


def _cut(counts: DataFrame, strata: list[str], by: str, wanted: Column) -> DataFrame:
    """For each stratum the value of ``by`` at which the running count reaches ``wanted``."""
    running = Window.partitionBy(*[quoted(s) for s in strata]).orderBy(by)
    upto = F.sum("_rows").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        counts.withColumn("_upto", upto)
        .withColumn("_before", F.col("_upto") - F.col("_rows"))
        .withColumn("_wanted", wanted)
        .filter((F.col("_before") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_upto")))
        .withColumn("_rest", F.col("_wanted") - F.col("_before"))
    )


def draws_below_cut(
    frame: DataFrame,
    key: list[str],
    unique: bool,
    quota: Quota | None,
    seed: int,
    stratum: str | None = None,
    size: int | None = None,
) -> DataFrame:
    """The lowest draws of each stratum (or of all rows), any number of them: by ``quota``,
    or ``size`` rows shared out among the strata.

    The population is read twice. Counts by draw prefix, at most 16**PREFIX per stratum,
    give the bucket the cut-off falls in. Rows up to that bucket, the sample and a little
    more, are checkpointed; all else, the cut-off within the bucket and the sample for as
    many uses as there are, is found in them. No task ever holds a stratum.
    """
    shared_folder(frame.sparkSession)
    names = frame.columns
    strata = [stratum] if stratum else []
    keyed = frame.withColumn("_draw", draw(key, seed)).withColumn("_bucket", F.substring("_draw", 1, PREFIX))

    histogram = keyed.groupBy(*[quoted(s) for s in strata], "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    if quota is None:
        counted = shared_out(histogram, stratum, size)
        wanted = F.col("_quota")
    else:
        counted = histogram.withColumn("_total", F.sum("_rows").over(Window.partitionBy(*[quoted(s) for s in strata])))
        wanted = F.least(quota(F.col("_total")), F.col("_total"))
    buckets = _cut(counted, strata, "_bucket", wanted)
    candidates = beside(keyed, buckets, strata, bucket="_bucket", rest="_rest").filter(F.col("_bucket") <= F.col("_cut.bucket"))
    candidates = candidates.withColumn("_last", F.when(F.col("_bucket") == F.col("_cut.bucket"), F.col("_cut.rest"))).drop("_cut", "_bucket").checkpoint()
    inside = candidates.filter(F.col("_last").isNotNull())
    columns = [quoted(c) for c in names]
    grouping = [quoted(s) for s in strata] if unique else columns
    distinct = inside.groupBy(*grouping, "_draw").agg(F.count(F.lit(1)).alias("_rows"), F.first("_last").alias("_cut_rest"))
    draws = distinct.groupBy(*[quoted(s) for s in strata], "_draw").agg(
        F.sum("_rows").alias("_rows"), F.first("_cut_rest").alias("_cut_rest")
    )
    cuts = _cut(draws, strata, "_draw", F.col("_cut_rest"))
    cut = {"bound": "_bound", "draw": "_draw", "copies": "_rest", "ties": "_rows"}  # one struct, found once
    # One comparison per row: below the bound is in. Draws are hex digits, so "~" sorts after them.
    including = F.concat("_draw", F.lit("~"))
    bound = including if unique else F.when(F.col("_rest") == F.col("_rows"), including).otherwise(F.col("_draw"))
    cuts = cuts.withColumn("_bound", bound)
    whole = beside(candidates, cuts, strata, **cut).filter(F.col("_draw") < F.col("_cut.bound")).select(*columns)
    if unique:
        return whole

    # Rows that share the cut-off draw are copies: counted above, the first few are written out.
    tied = beside(distinct, cuts, strata, **cut).filter(
        (F.col("_draw") == F.col("_cut.draw")) & (F.col("_cut.copies") < F.col("_cut.ties"))
    )
    before = F.sum("_rows").over(
        Window.partitionBy(*[quoted(s) for s in strata])
        .orderBy("_draw")  # rows of one draw are copies, so there is one row per stratum
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("_rows")
    some = tied.withColumn("_take", F.least(F.col("_cut.copies") - before, F.col("_rows"))).filter("_take > 0")
    return whole.unionByName(write_out(some, "_take", names))


def beside(keyed: DataFrame, cuts: DataFrame, strata: list[str], **fields: str) -> DataFrame:
    """``keyed`` with its stratum's cut as the struct ``_cut``: joined on the stratum,
    or, without strata, the one value there is."""
    cut = F.struct(*[F.col(source).alias(name) for name, source in fields.items()])
    if not strata:
        return keyed.withColumn("_cut", cuts.select(cut).scalar())
    right = cuts.select(*[quoted(s).alias(f"_stratum_{i}") for i, s in enumerate(strata)], cut.alias("_cut"))
    condition = same_stratum(strata, right.columns[:-1])
    return keyed.join(right, condition).select(*[quoted(c) for c in keyed.columns], "_cut")


def write_out(frame: DataFrame, copies: str, names: list[str]) -> DataFrame:
    """Each row repeated ``copies`` times; very many copies are spread over tasks."""
    columns = [quoted(c) for c in names]
    n = F.col(copies)
    few = frame.filter(n <= COPY_BLOCK).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_copy"))
    many = (
        frame.filter(n > COPY_BLOCK)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({copies} - 1) div {COPY_BLOCK}"))))
        .repartition(*columns, F.col("_block"))
    )
    size = F.least(F.lit(COPY_BLOCK).cast("long"), n - F.col("_block") * COPY_BLOCK)
    many = many.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("_copy"))
    return few.unionByName(many).drop("_copy")


def shared_out(histogram: DataFrame, stratum: str, size: int) -> DataFrame:
    """The counts with ``_quota``, the rows that each stratum gives: in proportion to its
    size by largest remainder, ``size`` together.

    Strata whose proportion is below one row give one row, so there are never fewer rows
    than strata. One row per stratum is compared in one task.
    """
    key, whole = quoted(stratum), lambda text: F.expr(text)
    everything = Window.partitionBy(F.lit(0))
    sizes = histogram.groupBy(key).agg(F.sum("_rows").cast("decimal(38,0)").alias("_n"))
    marked = sizes.withColumn("_small", F.lit(size) * F.col("_n") < F.sum("_n").over(everything))
    big = F.sum(F.when(~F.col("_small"), F.col("_n"))).over(everything).cast("decimal(38,0)")
    rest = F.greatest(F.lit(size) - F.count_if("_small").over(everything), F.lit(0)).cast("decimal(38,0)")
    parts = marked.withColumn("_big", big).withColumn("_rest", rest)
    parts = parts.withColumn("_base", whole("CASE WHEN _small THEN 1L ELSE (_rest * _n) div _big END"))
    parts = parts.withColumn("_over", whole("CASE WHEN _small THEN -1 ELSE (_rest * _n) % _big END"))
    place = F.row_number().over(everything.orderBy(F.desc("_over"), F.desc("_n"), key))
    left = F.lit(size) - F.sum("_base").over(everything)
    given = F.least(F.greatest(F.col("_base") + F.when(place <= left, 1).otherwise(0), F.lit(1)), F.col("_n")).cast("long")
    quotas = parts.select(key.alias("_of"), given.alias("_quota"))
    return histogram.join(quotas, key.eqNullSafe(F.col("_of"))).drop("_of")


def stratified_share(plan: Sampling) -> Quota:
    """A share of each stratum, at least one row each."""
    return lambda size: F.greatest(F.lit(1).cast("long"), rounded(size * F.lit(float(plan.sample_percentage))))


def every_kth(
    frame: DataFrame, key: list[str], unique: bool, seed: int, size: int | None, share: float | None
) -> DataFrame:
    """Systematic sample: order by key, then take every k-th row from a start.

    Copies are counted, never written out to be ranked: a distinct row, or key, with n copies has the n
    ranks after those of all rows before it, and arithmetic tells how many of them are taken. The ranks
    come from a range-partitioned, sorted and checkpointed frame of distinct rows: counts within the
    partition plus those of the partitions before it. The checkpoint fixes the partitions, so
    the ranks agree even if a task is run again.
    """
    shared_folder(frame.sparkSession)
    names = frame.columns
    by = [quoted(c) for c in (key if unique else names)]
    counted = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    placed = (
        counted.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .checkpoint()
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33))
    )
    sizes = placed.groupBy("_part").agg(F.sum("_rows").alias("_rows"))  # one row per partition
    upto = F.sum("_rows").over(Window.orderBy("_part"))
    offsets = sizes.select("_part", (upto - F.col("_rows")).alias("_offset"))
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0))).scalar()
    if size:
        step, most = F.greatest(F.lit(1).cast("long"), F.floor(total / F.lit(size))), F.lit(size).cast("long")
    else:
        step, most = F.greatest(F.lit(1).cast("long"), F.round(F.lit(1.0 / share)).cast("long")), total
    within = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        placed.withColumn("_upto", F.sum("_rows").over(within))
        .join(F.broadcast(offsets), "_part")
        .withColumns({"_first": F.col("_offset") + F.col("_upto") - F.col("_rows"), "_step": step, "_most": most})
        .withColumn("_start", F.pmod(F.lit(seed).cast("long"), F.col("_step")))
    )
    # the j-th row taken has the rank start + j * step: which j fall on the ranks of this row's copies
    lowest = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_first") - F.col("_start")) / F.col("_step")))
    highest = F.least(F.col("_most") - 1, F.floor((F.col("_first") + F.col("_rows") - 1 - F.col("_start")) / F.col("_step")))
    chosen = ranked.withColumn("_taken", highest - lowest + 1).filter("_taken > 0")
    if not unique:
        return write_out(chosen, "_taken", names)
    picks = chosen.select(*[quoted(k).alias(f"_pick_{i}") for i, k in enumerate(key)])
    return frame.join(picks, same_stratum(key, picks.columns), "left_semi")


def chosen_rows(frame: DataFrame, selection: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Judgmental sample: the rows whose key was picked by hand."""
    picks = selection.select(*[quoted(r).alias(f"_pick_{i}") for i, (_, r) in enumerate(pairs)]).distinct()
    condition = reduce(and_, [quoted(l) == F.col(f"_pick_{i}") for i, (l, _) in enumerate(pairs)])
    return frame.join(picks, condition, "left_semi")


def settled(plan: Sampling | None) -> Sampling | None:
    """The plan with a seed of its own, so that every later draw gives the same rows."""
    if plan is None or not plan.enabled or plan.random_seed:
        return plan
    return replace(plan, random_seed=random.randrange(1, 2**31))


def sample(joined: Joined, plan: Sampling | None, catalog) -> Joined:
    """The rows of the population that are tested."""
    if plan is None or not plan.enabled:
        return joined
    frame, lineage = joined.frame, joined.lineage
    unique = bool(plan.sample_key)
    key = [lineage.physical(k) for k in plan.sample_key] or frame.columns
    seed = settled(plan).random_seed
    if plan.method == "judgmental":
        selection = catalog.frame(plan.selection_dataset)
        names = Lineage.of(selection, plan.selection_dataset)
        picked = chosen_rows(frame, selection, [(lineage.physical(k), names.physical(k)) for k in plan.sample_key])
    elif plan.method == "systematic":
        picked = every_kth(frame, key, unique, seed, plan.sample_size, plan.sample_percentage)
    elif plan.method == "stratified":
        quota = None if plan.sample_size else stratified_share(plan)
        stratum = lineage.physical(plan.stratification_field)
        picked = draws_below_cut(frame, key, unique, quota, seed, stratum, plan.sample_size)
    elif plan.method == "statistical":
        picked = draws_below_cut(frame, key, unique, statistical_quota(plan), seed)
    elif plan.sample_size:
        picked = draws_below_cut(frame, key, unique, fixed_quota(plan.sample_size), seed)
    else:
        picked = draws_below_cut(frame, key, unique, share_quota(plan.sample_percentage), seed)
    return Joined(picked, lineage)
