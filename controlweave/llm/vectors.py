"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from controlweave.llm.components import ForestOfBatch, components
from controlweave.llm.tables import batch, partitions, prepared, written

KEY_BITS = 48
#: Vectors compared as one block when a component is completed.
BLOCK = 512
#: Vectors that one block of outsiders is held against in one group.
MEMBERS = 8192

_ROWS = pa.schema([("pass", pa.int32()), ("dim", pa.int32()), ("key", pa.int64()), ("node", pa.int64()), ("unit", pa.binary())])
_ROWS_DDL = "pass int, dim int, key bigint, node bigint, unit binary"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("tail", pa.bool_()), ("place", pa.int32()), *list(_ROWS)])
_FOUND_DDL = f"a bigint, b bigint, part int, tail boolean, place int, {_ROWS_DDL}"
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


#: Neighbours that would be enough if hashes cut the vectors evenly. Windows are larger, as a third of
#: the vectors may lie in one narrow region, which few of the hashes cut.
EVEN_WINDOW = 32


def passes_needed(n: int, threshold: float, recall: float) -> int:
    """Passes after which a pair right at the threshold was neighbours once with this probability.

    A pass brings two vectors into one window if they agree in the leading hashes that tell about
    n / EVEN_WINDOW groups apart; each hash agrees with probability 1 - angle / pi.
    """
    agree = (1 - math.acos(threshold) / math.pi) ** max(1.0, math.log2(max(n, 2) / EVEN_WINDOW))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


@functools.lru_cache(maxsize=8)
def _planes(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * KEY_BITS))


def _units(vectors: pa.Array) -> list[np.ndarray]:
    """Vectors of length one, in double precision; large ones are scaled first, against overflow."""
    out = []
    for v in vectors.to_pylist():
        x = np.asarray(v, np.float64)
        x = x / np.abs(x).max()
        out.append(x / math.sqrt(math.fsum(x * x)))
    return out


def _keyed(passes: int, seed: int):
    """A row for each vector and pass, with the pass's concatenated hashes as the sort key."""
    weights = 1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)

    def keyed(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            nodes, units = part.column(0).to_numpy(), part.column(1).to_pylist()
            dims = np.fromiter((len(u) // 8 for u in units), np.int32, len(units))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(units[i] for i in own)).reshape(len(own), dim)
                signs = (x @ _planes(int(dim), passes, seed) > 0).reshape(len(own), passes, KEY_BITS)
                keys = signs @ weights
                for p in range(passes):
                    yield batch(_ROWS, [np.full(len(own), p, np.int32), np.full(len(own), dim, np.int32), keys[:, p].copy(), nodes[own], [units[i] for i in own]])

    return keyed


def _matrix(units: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units)).reshape(len(units), dim)


def _windows(threshold: float, window: int):
    """Compare each vector with the ``window`` before it in its pass.

    Gives the links that join groups this task had not joined yet, and the first and last
    vectors of the task for the comparison across the border of tasks.
    """

    def compare(batches) -> Iterator[pa.RecordBatch]:
        forest, number, seen = ForestOfBatch(), TaskContext.get().partitionId(), 0
        last: list[dict] = []
        for part in batches:
            rows = part.to_pylist()
            if not rows:
                continue
            heads = [(number, False, seen + i, r) for i, r in enumerate(rows[: max(0, window - seen)])]
            seen += len(rows)
            links = []
            both = last + rows
            passes = np.array([r["pass"] for r in both])
            for dim in {r["dim"] for r in rows}:
                new = np.array([i for i in range(len(last), len(both)) if both[i]["dim"] == dim])
                old = np.array([i for i, r in enumerate(both) if r["dim"] == dim])
                close = _matrix([both[i]["unit"] for i in new], dim) @ _matrix([both[i]["unit"] for i in old], dim).T >= threshold
                apart = new[:, None] - old[None, :]
                close &= (apart > 0) & (apart <= window) & (passes[new][:, None] == passes[old][None, :])
                # one vector of each group is enough
                roots = np.array([forest.root(r["node"]) for r in both])
                x, y = np.nonzero(close & (roots[new][:, None] != roots[old][None, :]))
                _, first = np.unique(np.stack([x, roots[old[y]]]), axis=1, return_index=True)
                for i, j in zip(new[x[first]].tolist(), old[y[first]].tolist(), strict=True):
                    if forest.joins(both[i]["node"], both[j]["node"]):
                        links.append((both[i]["node"], both[j]["node"]))
            last = both[-window:]
            if links or heads:
                yield _found(links, heads)
        if seen:
            yield _found([], [(number, True, len(last) - 1 - i, r) for i, r in enumerate(last)])

    return compare


def _found(links: list, borders: list) -> pa.RecordBatch:
    none = [None] * len(borders)
    blank = [None] * len(links)
    own = [[r[n] for *_, r in borders] for n in _ROWS.names]
    return batch(_FOUND, [[a for a, _ in links] + none, [b for _, b in links] + none, *(blank + [x[k] for x in borders] for k in range(3)), *(blank + c for c in own)])


def _across(threshold: float, window: int):
    """Compare the last vectors of one task with the first ones of the next."""

    def compare(rows: pa.Table) -> pa.Table:
        all_rows, forest, links = rows.to_pylist(), ForestOfBatch(), []
        kinds = {(r["pass"], r["dim"]) for r in all_rows}
        for kind in sorted(kinds):
            tails, heads = ([r for r in all_rows if r["tail"] is side and (r["pass"], r["dim"]) == kind] for side in (True, False))
            if not tails or not heads:
                continue
            close = _matrix([r["unit"] for r in tails], kind[1]) @ _matrix([r["unit"] for r in heads], kind[1]).T >= threshold
            close &= np.array([r["place"] for r in tails])[:, None] + np.array([r["place"] for r in heads])[None, :] < window
            for i, j in zip(*np.nonzero(close), strict=True):
                if forest.joins(tails[i]["node"], heads[j]["node"]):
                    links.append((tails[i]["node"], heads[j]["node"]))
        return pa.table({"a": [a for a, _ in links], "b": [b for _, b in links]}, schema=_LINKS)

    return compare


def links_found(classes: DataFrame, threshold: float, window: int, passes: int, seed: int) -> DataFrame:
    """Links ``a``, ``b`` that connect the vectors found close in any pass."""
    n = max(partitions(classes.sparkSession), 1)
    ordered = classes.select("node", "unit").mapInArrow(_keyed(passes, seed), _ROWS_DDL)
    ordered = ordered.repartitionByRange(n, "pass", "dim", "key", "node").sortWithinPartitions("pass", "dim", "key", "node")
    found = written(ordered.mapInArrow(_windows(threshold, window), _FOUND_DDL), "passes")
    # one row per task: their order fits in one task
    order = found.where("part IS NOT NULL").select("part").distinct().withColumn("rank", F.row_number().over(Window.orderBy("part")))
    borders = found.where("part IS NOT NULL").join(order, "part")
    borders = borders.withColumn("border", F.col("rank") - F.when(F.col("tail"), 0).otherwise(1))
    columns = ["border", "tail", "place", "pass", "dim", "node", "unit"]
    crossing = borders.select(columns).groupBy("border").applyInArrow(_across(threshold, window), "a bigint, b bigint")
    return found.where("part IS NULL").select("a", "b").union(written(crossing, "links-across"))


_SUMS = pa.schema([("component", pa.int64()), ("total", pa.binary())])


def _sums(batches) -> Iterator[pa.RecordBatch]:
    """One sum of vectors for each component and task."""
    totals: dict[int, np.ndarray] = {}
    for part in batches:
        for component, unit in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            x = np.frombuffer(unit)
            old = totals.get(component)
            totals[component] = x if old is None else old + x if len(old) == len(x) else old
    if totals:
        yield batch(_SUMS, [list(totals), [t.tobytes() for t in totals.values()]])


def _pivots(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The direction of the sum of a component's vectors."""
    total = 0.0
    for part in batches:
        for piece in part.column(1).to_pylist():
            total = total + np.frombuffer(piece)
    norm = float(np.linalg.norm(total))
    yield batch(_SUMS, [[key[0].as_py()], [(total / norm if norm else total).tobytes()]])


def _held_against(threshold: float):
    """Links of a block of outsiders with some members of their component."""

    def count(rows: pa.Table) -> pa.Table:
        all_rows = rows.to_pylist()
        outsiders = [r for r in all_rows if r["asks"]]
        members = [r for r in all_rows if not r["asks"]]
        totals: dict[int, int] = {}
        dims = {len(r["unit"]) for r in outsiders}
        for size in dims:
            asking = [r for r in outsiders if len(r["unit"]) == size]
            asked = [r for r in members if len(r["unit"]) == size]
            if not asked:
                continue
            x = _matrix([r["unit"] for r in asking], size // 8)
            own = np.array([r["node"] for r in asking])
            weight = np.array([r["weight"] for r in asking])
            for at in range(0, len(asked), BLOCK):
                some = asked[at : at + BLOCK]
                close = (x @ _matrix([r["unit"] for r in some], size // 8).T >= threshold) & (own[:, None] != np.array([r["node"] for r in some]))
                for node, n in zip(own, close @ np.array([r["weight"] for r in some]), strict=True):
                    totals[int(node)] = totals.get(int(node), 0) + int(n)
                for r, n in zip(some, weight @ close, strict=True):
                    if r["inside"]:
                        totals[r["node"]] = totals.get(r["node"], 0) + int(n)
        return pa.table({"node": list(totals), "n": list(totals.values())}, schema=pa.schema([("node", pa.int64()), ("n", pa.int64())]))

    return count


def _counts(classes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(``node``, ``n``): vectors linked with each vector, over whole components.

    Vectors within half the threshold's angle of a common direction all link with one another, so
    they are only counted. The others are held against all members of their component, in blocks.
    """
    members = written(
        classes.join(found, F.col("node") == F.col("id")).select("component", "unit", "node", "weight"), "members"
    )
    pivots = members.select("component", "unit").mapInArrow(_sums, "component bigint, total binary").groupBy("component").applyInArrow(_pivots, "component bigint, total binary")
    near = math.cos(math.acos(threshold) / 2) + 1e-9

    def placed(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            pairs = zip(part.column("unit").to_pylist(), part.column("total").to_pylist(), strict=True)
            inside = [len(u) == len(t) and bool(np.frombuffer(u) @ np.frombuffer(t) >= near) for u, t in pairs]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("component", "unit", "node", "weight")), pa.array(inside, pa.bool_())], names=["component", "unit", "node", "weight", "inside"])

    rows = written(members.join(pivots, "component").mapInArrow(placed, "component bigint, unit binary, node bigint, weight bigint, inside boolean"), "placed")
    sizes = rows.groupBy("component").agg(
        F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0)).alias("within"),
        F.count("*").alias("size"),
        F.count(F.when(~F.col("inside"), 1)).alias("outside"),
    )
    inner = rows.where("inside").join(sizes, "component").select("node", (F.col("within") - F.col("weight")).alias("n"))
    split = sizes.where("outside > 0").select("component", F.ceil(F.col("outside") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("size") / MEMBERS).cast("int").alias("shares"))
    parted = rows.join(split, "component")
    block, share = F.pmod(F.xxhash64("node"), "blocks").cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), "shares").cast("int")
    common = ["component", "unit", "node", "weight", "inside"]
    asks = parted.where("NOT inside").select(*common, F.lit(True).alias("asks"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    asked = parted.select(*common, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), share.alias("share"))
    outer = asks.unionByName(asked).groupBy("component", "block", "share").applyInArrow(_held_against(threshold), "node bigint, n bigint")
    return inner.union(outer).groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.9,
    window: int = 512, recall: float = 0.98, passes: int | None = None, seed: int = 7,
) -> DataFrame:
    """Links between vectors whose cosine, in double precision, reaches the threshold.

    Identical vectors are one class. In each pass the classes are sorted by concatenated signs of
    random projections and compared with the ``window`` classes before them; verified pairs of all
    passes are united, and each component is completed exactly. Every pass covers all vectors; the
    number of passes follows their number unless given.

    Result, a row per input row: the id, ``n_links`` (other rows linked directly), ``component_id``
    (smallest id reachable), ``kept`` (the id is its component's). Vectors that are null, empty, zero or hold null or
    non-finite components, and vectors of another length, link with nothing. A row without an id
    takes no part: no links, null component, not kept. Rows that repeat an id with another vector
    share one node. An empty table gives no rows; other columns are ignored.
    """
    prepared(vectors.sparkSession)
    own = vectors.select(vectors[id_column].cast("bigint").alias("vec_id"), vectors[vector_column].cast("array<double>").alias("vector"))
    x = F.col("vector")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))
    good = own.where(usable)
    grouped = written(good.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "classes")

    def unit(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([u.tobytes() for u in _units(part.column(1))], pa.binary()), part.column(2)], names=["node", "unit", "weight"])

    classes = written(grouped.select("node", "vector", "weight").mapInArrow(unit, "node bigint, unit binary, weight bigint"), "units")
    passes = passes or passes_needed(classes.count(), threshold, recall)
    found = components(links_found(classes, threshold, window, passes, seed))
    counts = _counts(classes, found, threshold)
    nodes = grouped.join(found, F.col("node") == F.col("id"), "left").join(counts, "node", "left")
    nodes = nodes.select("vector", "node", "weight", F.coalesce("component", "node").alias("component_id"), F.coalesce("n", F.lit(0)).alias("n"))
    linked = good.join(nodes, "vector").select("vec_id", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    alone = own.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("vec_id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
