"""Similarity join of documents on word n-grams: all pairs above a Jaccard threshold, exactly.

Prefix filtering with the rarest n-grams first, length, positional and suffix filters. Texts with
equal sets are one node. What is asked for are the groups that links form, so once some links are
verified, pairs within one group need no look any more; pairs between groups are all looked at.

Signatures and sets are far larger than the entries that ask for them. They are sent in turns, in proportion
to the nodes, and each step's shuffle files go before the next, so that disk grows with the input only.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from controlweave.llm.arrays import U64, Words, combined
from controlweave.llm.components import components
from controlweave.llm.tables import batch, chunks, partitions, payloads, prepared, release_shuffles, written

#: Counters of the frequency table that orders n-grams: 8 MB whatever the corpus. Two n-grams may
#: share one, which changes only how selective the order is, never the result.
SLOT_BITS = 21
#: Counters of one row when the tables of tasks are summed.
SLOTS_PER_ROW = 1 << 15
#: Ranges of the hash space. Whether a set's count in each is odd takes one bit; sets differ in at
#: least as many n-grams as bits (suffix filter: a bound of the Hamming distance by ranges).
RANGES = 1024
_BITS = [f"s{i}" for i in range(RANGES // 64)]
#: Bits of the table of nodes whose sets are needed.
NEEDED_BITS = 23
#: Rounds of linear linking before all remaining pairs are looked at.
ROUNDS = 1
#: Entries with a signature that are sent in one turn, for each node; n-grams of sets, for each one of all sets.
SIGNED_AT_ONCE, SETS_AT_ONCE = 8, 0.5


@dataclass(frozen=True)
class Rule:
    """Link when 100 * intersection >= percent * union."""

    n: int = 4
    percent: int = 85

    def overlap(self, x, y):
        """The smallest intersection of linked sets of these sizes."""
        return -(-self.percent * (x + y) // (100 + self.percent))

    def prefix_long(self, size: int) -> int:
        """Leading n-grams one of which a linked set of at most this size must hold."""
        return size - -(-self.percent * size // 100) + 1

    def prefix_short(self, size):
        """The same for linked sets of at least this size."""
        return size - -(-2 * self.percent * size // (100 + self.percent)) + 1

    def largest(self, size: str, place: str):
        """The largest set that one of this size may link with if their first common n-gram has this place in it (columns)."""
        return F.expr(f"cast({size} - {place} AS bigint) * {100 + self.percent} div {self.percent} - {size}")


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct runs of n words; of all words, if fewer."""
    for _, group in chunks(texts):
        words = Words(group)
        runs, at = words.runs(n)
        cut = np.searchsorted(at, words.first)
        for i in range(len(group)):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= n:
                yield np.unique(runs[cut[i] : cut[i + 1]])
            elif b > a:
                yield combined([words.hashes[k : k + 1] for k in range(a, b)] + [np.array([b - a], U64)])
            else:
                yield np.empty(0, U64)


def _node(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes(), len(grams)) - (1 << 63)


_DOCS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), *((b, pa.int64()) for b in _BITS), ("slots", pa.int32()), ("counts", pa.binary())])
_DOCS_DDL = f"doc_id bigint, n bigint, node bigint, {', '.join(f'{b} bigint' for b in _BITS)}, slots int, counts binary"


def _described(n: int):
    """A row per document with its node, and each task's n-gram counts."""

    def describe(batches) -> Iterator[pa.RecordBatch]:
        table, seen, pack = np.zeros(1 << SLOT_BITS, np.uint32), set(), zstandard.ZstdCompressor(level=1)
        for part in batches:
            rows = []
            for grams in shingle_sets([t or b"" for t in payloads(part.column(1))], n):
                if not len(grams):
                    rows.append((0, None, *[None] * len(_BITS)))
                    continue
                node = _node(grams)
                if node not in seen:
                    seen.add(node)
                    np.add.at(table, (grams & U64(table.size - 1)).astype(np.int64), 1)
                odd = np.bincount((grams >> U64(54)).astype(np.int64), minlength=RANGES) & 1
                rows.append((len(grams), node, *np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()))
            none = [None] * len(rows)
            yield batch(_DOCS, [part.column(0), *([r[k] for r in rows] for k in range(2 + len(_BITS))), none, none])
        if seen:
            blocks = table.reshape(-1, SLOTS_PER_ROW)
            none = [None] * len(blocks)
            yield batch(_DOCS, [*[none] * (3 + len(_BITS)), range(len(blocks)), [pack.compress(b.tobytes()) for b in blocks]])

    return describe


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, unpack = np.zeros(SLOTS_PER_ROW, np.uint32), zstandard.ZstdDecompressor()
    for part in batches:
        for data in part.column("counts").to_pylist():
            total = np.minimum(total.astype(np.uint64) + np.frombuffer(unpack.decompress(data), np.uint32), (1 << 32) - 1).astype(np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slots", "counts"])


def frequency_table(described: DataFrame) -> np.ndarray:
    """How often the n-grams of each counter occur; a table of fixed size."""
    rows = described.where("slots IS NOT NULL").select("slots", "counts").groupBy("slots").applyInArrow(_summed, "slots int, counts binary")
    table = np.zeros((1 << SLOT_BITS) // SLOTS_PER_ROW * SLOTS_PER_ROW, np.uint32).reshape(-1, SLOTS_PER_ROW)
    for row in rows.collect():
        table[row.slots] = np.frombuffer(row.counts, np.uint32)
    return table.reshape(-1)


_PREFIX = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])
_PREFIX_DDL = "gram bigint, node bigint, n int, place int"


def _prefixes(frequency, rule: Rule):
    """The leading n-grams of each node, rarest first, once per task."""

    def prefix(batches) -> Iterator[pa.RecordBatch]:
        table, seen = np.minimum(frequency.value, (1 << 20) - 1).astype(U64) << U64(44), set()
        for part in batches:
            grams_out, nodes, sizes, places = [], [], [], []
            for grams in shingle_sets([t or b"" for t in payloads(part.column(0))], rule.n):
                if not len(grams) or (node := _node(grams)) in seen:
                    continue
                seen.add(node)
                order = np.argsort(table[(grams & U64(len(table) - 1)).astype(np.int64)] | (grams >> U64(20)), kind="stable")
                first = grams[order[: rule.prefix_long(len(grams))]]
                grams_out.append(first)
                nodes.append(np.full(len(first), node))
                sizes.append(np.full(len(first), len(grams), np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
            if nodes:
                yield batch(_PREFIX, [np.concatenate(grams_out).view(np.int64), *map(np.concatenate, (nodes, sizes, places))])

    return prefix


_SETS = pa.schema([("node", pa.int64()), ("grams", pa.binary())])


def _needed(nodes: DataFrame) -> bytes:
    """A bit for the remainder of each node; a table of fixed size, which may name too many."""
    place = F.pmod("node", F.lit(1 << NEEDED_BITS))
    rows = nodes.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("bits"))
    out = np.zeros(((1 << NEEDED_BITS) // 32768, 4096), np.uint8)
    for row in rows.collect():
        out[row.bucket - 1] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def _sets_of(needed, n: int):
    def sets(batches) -> Iterator[pa.RecordBatch]:
        bits, seen = np.unpackbits(np.frombuffer(needed.value, np.uint8), bitorder="little"), set()
        for part in batches:
            found = []
            for grams in shingle_sets([t or b"" for t in payloads(part.column(0))], n):
                if len(grams) and bits[(node := _node(grams)) % len(bits)] and node not in seen:
                    seen.add(node)
                    found.append((node, grams.tobytes()))
            if found:
                yield batch(_SETS, list(zip(*found, strict=True)))

    return sets


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(rule: Rule):
    def check(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            kept = []
            for a, b, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "grams_a", "grams_b")), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= rule.percent * (len(x) + len(y) - common):
                    kept.append((a, b))
            if kept:
                yield batch(_PAIRS, list(zip(*kept, strict=True)))

    return check


class Join:
    """The stages of one join over documents (``doc_id``, ``text`` as bytes)."""

    def __init__(self, docs: DataFrame, rule: Rule) -> None:
        self.spark, self.rule, self.docs = prepared(docs.sparkSession), rule, docs
        described = written(docs.mapInArrow(_described(rule.n), _DOCS_DDL), "sets-described")
        self.described = described.where("slots IS NULL").drop("slots", "counts")
        first = [F.first(c).alias(c) for c in ("n", *_BITS)]
        self.nodes = self._stored(self.described.where("node IS NOT NULL").groupBy("node").agg(*first), "nodes")
        self.n_nodes, self.n_grams = self.nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.entries = self._entries(described)

    def _stored(self, frame: DataFrame, purpose: str) -> DataFrame:
        """The frame, written; the shuffles that made it go."""
        out = written(frame, purpose)
        release_shuffles(self.spark)
        return out

    def _in_turns(self, total: int | None, at_once: float, purpose: str, result: Callable[[int, int], DataFrame]) -> DataFrame:
        """All rows of ``result(turn, turns)``, where the turns share what would be ``total`` at once."""
        turns = max(1, math.ceil((total or 0) / max(at_once, 1)))
        return functools.reduce(DataFrame.union, [self._stored(result(turn, turns), purpose) for turn in range(turns)])

    def _entries(self, described: DataFrame) -> DataFrame:
        """Prefix entries of n-grams that two nodes at least have in their prefixes, at places and with sizes that let them link.

        As the smaller set of a pair an entry needs one with a larger set behind it, of a size that its own place allows; as
        the larger, an entry before it whose place allows its size.
        """
        frequency = self.spark.sparkContext.broadcast(frequency_table(described))
        every = self.docs.select("text").mapInArrow(_prefixes(frequency, self.rule), _PREFIX_DDL)
        # nodes that several tasks found are one
        placed = every.repartition(partitions(self.spark), "gram").distinct()
        placed = placed.withColumn("largest", self.rule.largest("n", "place"))
        by_size = Window.partitionBy("gram").orderBy("n", "node")
        smaller = by_size.rowsBetween(Window.unboundedPreceding, -1)
        met = placed.withColumn("next", F.lead("n").over(by_size)).withColumn("allowed", F.max("largest").over(smaller))
        return self._stored(met.where("next <= largest OR allowed >= n").select(*_PREFIX.names), "prefix-entries")

    def _sets(self, pairs: DataFrame) -> DataFrame:
        """The sets of the nodes in these pairs, at least."""
        nodes = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct())
        needed = self.spark.sparkContext.broadcast(_needed(nodes))
        return self.docs.select("text").mapInArrow(_sets_of(needed, self.rule.n), "node bigint, grams binary").dropDuplicates(["node"])

    def _alike(self, a: str, b: str):
        """The suffix filter: the sets may differ in few enough n-grams to link."""
        p = self.rule.percent
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _BITS[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
        # linked sets share p / (100 + p) of their sizes' sum, so they differ in the rest
        return apart * (100 + p) <= (na + nb) * (100 - p)

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, each verified once."""
        once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        info = lambda s: self.nodes.withColumnRenamed("node", s).alias(f"of_{s}")
        likely = once.join(info("a"), "a").join(info("b"), "b").where(self._alike("of_a", "of_b"))
        likely = self._stored(likely.select("a", "b", (F.col("of_a.n") + F.col("of_b.n")).alias("size")), "likely-pairs")

        def verified(turn: int, turns: int) -> DataFrame:
            pairs = likely.where(_is_in_turn(["a", "b"], turn, turns)).select("a", "b")
            sets = self._sets(pairs)
            own = lambda s: sets.select(F.col("node").alias(s), F.col("grams").alias(f"grams_{s}"))
            return pairs.join(own("a"), "a").join(own("b"), "b").mapInArrow(_verified(self.rule), "a bigint, b bigint")

        return self._in_turns(likely.agg(F.sum("size")).first()[0], SETS_AT_ONCE * self.n_grams, "verified", verified)

    def _grouped(self, links: DataFrame | None) -> DataFrame:
        """Entries with the group of their node, of n-grams that several groups share."""
        if links is None:
            return self.entries.withColumn("root", F.col("node"))
        roots = components(links)
        entries = self.entries.join(roots, F.col("node") == F.col("id"), "left").select("gram", "node", "n", "place", F.coalesce("component", "node").alias("root"))
        mixed = entries.groupBy("gram").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("gram")
        return self._stored(entries.join(mixed, "gram", "left_semi"), "mixed-entries")

    def _neighbours(self, entries: DataFrame, turn: int) -> DataFrame:
        """For each node, the node before it in an n-gram's bucket that shares most n-grams so."""
        order = [F.col("n"), F.col("node")] if turn == 0 else [F.xxhash64("node", F.lit(turn)), F.col("node")]
        bucket = Window.partitionBy("gram").orderBy(*order)
        before = lambda c: F.lag(c).over(bucket)
        lagged = entries.select("node", "n", "root", before("node").alias("other"), before("n").alias("m"), before("root").alias("other_root"))
        p = self.rule.percent
        fits = (F.least("n", "m") * 100 >= F.greatest("n", "m") * p) & (F.col("root") != F.col("other_root")) & (F.col("node") != F.col("other"))
        counted = lagged.where(fits).groupBy("node", "other").agg(F.count("*").alias("shared"))
        return counted.groupBy("node").agg(F.max_by("other", F.struct("shared", "other")).alias("other")).select(F.col("node").alias("a"), F.col("other").alias("b"))

    def links(self) -> DataFrame:
        """Links that connect whatever links directly or through others."""
        found: DataFrame | None = None
        for turn in range(ROUNDS):
            new = self._verify(self._neighbours(self._grouped(found), turn))
            found = new if found is None else found.union(new)
        rest = self._remaining(self._grouped(found))
        return rest if found is None else found.union(rest)

    def _remaining(self, entries: DataFrame) -> DataFrame:
        """Links between groups that still differ, over all pairs that share an n-gram of their prefixes.

        Pairs never leave a task: the pairs of a bucket that pass the filters come out as a spanning forest,
        and what hangs together so is verified block by block on the sets, where only links that join
        two groups come out.
        """
        n = partitions(self.spark)
        signature = F.concat(*(F.unhex(F.lpad(F.hex(c), 16, "0")) for c in _BITS)).alias("signature")
        signed = self.nodes.select("node", signature)
        sizes = entries.groupBy("gram").agg(F.count("*").alias("members"))

        def passing(turn: int, turns: int) -> DataFrame:
            met = _blocks(entries.join(sizes, "gram"), "gram", ENTRIES_PER_BLOCK, n, signed, turn, turns)
            return met.select(*_LIKELY_COLUMNS).mapInArrow(_likely(self.rule), "a bigint, b bigint").distinct()

        sent = sizes.agg(F.sum(F.col("members") * F.ceil(F.col("members") / ENTRIES_PER_BLOCK))).first()[0]
        forest = self._in_turns(sent, SIGNED_AT_ONCE * self.n_nodes, "likely-pairs", passing)
        clusters = components(forest)
        roots = entries.select("node", "root").distinct()
        placed = clusters.join(roots, F.col("id") == F.col("node")).select("node", F.col("component").alias("cluster"), "root")
        placed = self._stored(placed.join(self.nodes.select("node", "n"), "node"), "clusters")
        sizes_of = placed.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("grams"))
        sent = sizes_of.agg(F.sum(F.col("grams") * F.ceil(F.col("members") / SETS_PER_BLOCK))).first()[0]
        sets = self._sets(placed.select(F.col("node").alias("a"), F.col("node").alias("b")))
        if (sent or 0) > SETS_AT_ONCE * self.n_grams:
            sets = self._stored(sets, "cluster-sets")

        def linked(turn: int, turns: int) -> DataFrame:
            held = _blocks(placed.join(sizes_of.drop("grams"), "cluster"), "cluster", SETS_PER_BLOCK, n, sets, turn, turns)
            return held.select("cluster", "low", "high", "block", "node", "root", "grams").mapInArrow(_linked(self.rule), "a bigint, b bigint")

        return self._in_turns(sent, SETS_AT_ONCE * self.n_grams, "verified", linked)


def _is_in_turn(columns: list[str], turn: int, turns: int):
    return F.pmod(F.xxhash64(*columns), F.lit(turns)) == turn if turns > 1 else F.lit(True)


def _blocks(rows: DataFrame, key: str, most: int, n: int, data: DataFrame, turn: int, turns: int) -> DataFrame:
    """Deal the members of a key into blocks of about ``most`` and send each, with its ``data``, to all pairs of blocks with its own.

    Pairs (``low``, ``high``) come together within a partition, one after the other. Each pair of blocks has its turn.
    """
    dealt = rows.withColumn("blocks", F.ceil(F.col("members") / most).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = dealt.select("*", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    paired = paired.where(_is_in_turn([key, "low", "high"], turn, turns)).join(data, "node")
    return paired.repartition(n, key, "low", "high").sortWithinPartitions(key, "low", "high")


#: Members of a bucket, and sets of a cluster, in one block.
ENTRIES_PER_BLOCK, SETS_PER_BLOCK = 2048, 512
_LIKELY_COLUMNS = ["gram", "low", "high", "block", "node", "n", "place", "root", "signature"]


def _groups(batches, width: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows with equal first ``width`` columns, several at a time, and where each begins."""
    held: list[pa.RecordBatch] = []
    rows, least = 0, ENTRIES_PER_BLOCK

    def cut(table: pa.Table, last: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        keys = [table.column(i).to_numpy() for i in range(width)]
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        begins = np.flatnonzero(new)
        stop = table.num_rows if last else int(begins[-1])
        return table.slice(0, stop), begins[begins < stop], table.slice(stop)

    for part in batches:
        held.append(part)
        rows += part.num_rows
        if rows >= least:
            done, begins, rest = cut(pa.Table.from_batches(held).combine_chunks(), False)
            if done.num_rows:
                yield done, begins
            held, rows = rest.to_batches(), rest.num_rows
            # a group longer than that is awaited without cutting at every batch
            least = max(ENTRIES_PER_BLOCK, 2 * rows)
    if rows:
        done, begins, _ = cut(pa.Table.from_batches(held).combine_chunks(), True)
        yield done, begins


def _likely(rule: Rule):
    """Of the pairs of each bucket that pass the length, positional and suffix filters, those that join two trees."""

    def likely(batches) -> Iterator[pa.RecordBatch]:
        p = rule.percent
        for table, begins in _groups(batches, 3):
            low, high, block, node, n, place, root = (table.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "block", "node", "n", "place", "root"))
            signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), U64).reshape(-1, RANGES // 64)
            end = np.repeat(np.append(begins[1:], len(node)), np.diff(np.append(begins, len(node))))
            nodes, own = np.unique(node, return_inverse=True)
            tree, pairs = np.arange(len(nodes)), []
            at, step = np.arange(len(node)), 1
            while len(at := at[at + step < end[at]]):
                x, y = at, at + step
                # blocks that differ meet each other only; what hangs together already need not meet
                kept = (root[x] != root[y]) & (tree[own[x]] != tree[own[y]]) & ((low[x] == high[x]) | (block[x] != block[y]))
                kept &= np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * p
                x, y = x[kept], y[kept]
                kept = np.minimum(n[x] - place[x], n[y] - place[y]) * (100 + p) >= (n[x] + n[y]) * p
                short = np.where((n[x] < n[y]) | ((n[x] == n[y]) & (node[x] < node[y])), x, y)
                kept &= place[short] < rule.prefix_short(n[short])
                x, y = x[kept], y[kept]
                kept = np.bitwise_count(signature[x] ^ signature[y]).sum(axis=1, dtype=np.int64) * (100 + p) <= (n[x] + n[y]) * (100 - p)
                for i, j in zip(own[x[kept]].tolist(), own[y[kept]].tolist(), strict=True):
                    if tree[i] != tree[j]:
                        tree[tree == tree[j]] = tree[i]
                        pairs.append((int(nodes[i]), int(nodes[j])))
                step += 1
            if pairs:
                yield batch(_PAIRS, list(zip(*pairs, strict=True)))

    return likely


def _linked(rule: Rule):
    """Verified links of each cluster's blocks that join two groups."""

    def link(batches) -> Iterator[pa.RecordBatch]:
        p = rule.percent
        for table, begins in _groups(batches, 3):
            low, high, block, node, root = (table.column(c).to_numpy() for c in ("low", "high", "block", "node", "root"))
            links = []
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), table.num_rows], strict=True):
                sets = [np.frombuffer(x, U64) for x in table.column("grams").slice(a, b - a).to_pylist()]
                sizes = np.array([len(x) for x in sets])
                odd = np.stack([np.packbits((np.bincount((x >> U64(54)).astype(np.int64), minlength=RANGES) & 1).astype(np.uint8)).view(U64) for x in sets])
                group = root[a:b].copy()
                for i in range(b - a):
                    j = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
                    if low[a] != high[a]:
                        j = j[block[a + j] != block[a + i]]
                    j = j[(np.minimum(sizes[j], sizes[i]) * 100 >= np.maximum(sizes[j], sizes[i]) * p)]
                    j = j[np.bitwise_count(odd[j] ^ odd[i]).sum(axis=1, dtype=np.int64) * (100 + p) <= (sizes[j] + sizes[i]) * (100 - p)]
                    for k in j.tolist():
                        if group[i] == group[k]:
                            continue
                        both = np.sort(np.concatenate([sets[i], sets[k]]))
                        common = int(np.count_nonzero(both[1:] == both[:-1]))
                        if 100 * common >= p * (len(both) - common):
                            group[group == group[k]] = group[i]
                            links.append((int(node[a + i]), int(node[a + k])))
            if links:
                yield batch(_PAIRS, list(zip(*links, strict=True)))

    return link


def near_duplicate_groups(docs: DataFrame, rule: Rule = Rule(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Groups of documents whose n-gram sets link, directly or through others.

    Words are runs of characters other than ASCII white space, with A-Z in lower case. A
    document's set are its distinct n-word runs; with fewer words, all of them as one. Result, a
    row per input row: the id, ``n_shingles``, ``component_id`` (smallest id reachable). Null and
    empty texts, and those of white space, have empty sets and link with nothing. Rows that repeat
    an id are judged apart; rows without an id have the group of their set, or null. An empty
    table gives no rows; other columns are ignored whatever their names.
    """
    own = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("binary").alias("text"))
    join = Join(own, rule)
    roots = components(join.links())
    least = join.described.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = least.join(roots, F.col("node") == F.col("id"), "left").select("node", "first", F.coalesce("component", "node").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = rooted.select("node", "root").join(groups, "root").select("node", "component_id")
    known = join.described.where("node IS NOT NULL").join(of_node, "node").select("doc_id", "n", "component_id")
    empty = join.described.where("node IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return known.union(empty).select(F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")
