"""Connected components of a table of links: stars within tasks; among several tasks, alternating star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from controlweave.llm.tables import batch, release_shuffles, written


class ForestOfBatch:
    """Union-find over the links of one task: tells which links join two groups not yet joined."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


#: Links that one task makes stars of: a task holds no more, however many there are.
LINKS_PER_TASK = 1 << 16
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(batches) -> Iterator[pa.RecordBatch]:
    """The links of one task as stars: each id with the smallest one that the task's links reach."""
    forest = ForestOfBatch()
    for part in batches:
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            forest.joins(a, b)
    ids = list(forest.parent)
    for at in range(0, len(ids), 1 << 16):
        some = ids[at : at + (1 << 16)]
        yield batch(_LINKS, [[forest.root(x) for x in some], some])


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # a node with very many neighbours is one hot key of this join, which adaptive execution splits
    return both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked with the smallest of them (a < b in links)."""
    low = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(low, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(low.select(F.col("m").alias("a"), "b"))


def components(links: DataFrame) -> DataFrame:
    """(``id``, ``component``) of every id in the links ``a``, ``b``: the smallest id reachable.

    Links are counted first, and dealt to tasks of up to LINKS_PER_TASK. What fits one task is settled by it; else rounds
    follow, each written to the shared folder, so no lineage builds up. A step never makes the sum of a link's ids larger, so
    links that a round leaves as they are are stars. Links of an id with itself and links with null are
    ignored; repeated links do no harm; no links give no rows.
    """
    ordered = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tasks = max(1, -(-ordered.count() // LINKS_PER_TASK))
    in_stars = lambda frame: written(frame.repartition(tasks).mapInArrow(_stars, "a bigint, b bigint"), "links")
    current, before = in_stars(ordered), None
    while tasks > 1:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, tasks = state, -(-state[0] // LINKS_PER_TASK)
        release_shuffles(links.sparkSession)
        current = in_stars(_small_star(_large_star(current).distinct()).distinct())
    return current.select(F.col("b").alias("id"), F.col("a").alias("component")).union(current.select("a", "a").distinct())
