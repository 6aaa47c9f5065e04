"""How the sources of a language differ in their terms, by exact counts over all documents.

Terms that enough documents of a language hold are kept. They are dealt into shards, each of which gets a
minimal perfect hash with its keys stored in slot order. The hashes are broadcast, as many at a time
as fit a fixed size, and documents are read again: a term's slot is looked up, verified against the stored key,
and incremented in the dense row of the document's language and source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from controlweave.llm.arrays import mixed
from controlweave.llm.resampling import LANES, word_lanes, xxh64
from controlweave.llm.tables import CHUNK_BYTES, batch, payloads, prepared, written

U64 = np.uint64
#: Every character but ASCII letters and those beyond ASCII ends a term.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of a perfect hash; keys that none of them settles are looked up by their bytes.
LEVELS = 24


@dataclass(frozen=True)
class Rule:
    """Terms of ``least_docs`` documents are kept; the ``top`` terms of a group are reported.

    A shard has about ``shard_keys`` keys, one broadcast at most ``broadcast_bytes``, and a task's dense
    counts ``dense_cells`` cells per language before they are handed on.
    """

    least_docs: int = 3
    unit: int = 1_000_000_000
    smooth: int = 1
    top: int = 200
    shard_keys: int = 1 << 16
    broadcast_bytes: int = 32 << 20
    dense_cells: int = 1 << 22


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes, with room behind them, their begins and sizes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join([*words, bytes(8 * LANES)]), np.uint8), np.cumsum(sizes) - sizes, sizes


def hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """64-bit hashes of words, and the lanes that hold their first bytes."""
    lanes = word_lanes(data, starts, sizes)
    keys = xxh64(lanes, sizes.astype(U64))
    for i in np.flatnonzero(sizes > 8 * LANES):
        keys[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return keys, lanes


class PerfectHash:
    """A minimal perfect hash of words: each has a slot of its own among the first ``n`` numbers.

    At each level the words not settled yet are hashed into twice as many bits; a word alone at its
    bit is settled there, and its slot is the number of bits set before. Keys are stored in slot order.
    """

    def __init__(self, words: list[bytes]) -> None:
        data, starts, sizes = _flat(words)
        keys, _ = hashed(data, starts, sizes)
        self.levels: list[np.ndarray] = []
        order, waiting = [], np.arange(len(words))
        for level in range(LEVELS):
            if not len(waiting):
                break
            at = self._place(keys[waiting], level, 2 * len(waiting))
            alone = np.bincount(at, minlength=2 * len(waiting)) == 1
            self.levels.append(alone)
            settled = alone[at]
            order.append(waiting[settled][np.argsort(at[settled])])
            waiting = waiting[~settled]
        self._keep([words[i] for part in [*order, waiting] for i in part], len(waiting))

    def _keep(self, words: list[bytes], left: int) -> None:
        self.words, self.left = words, left
        self.data, self.starts, self.sizes = _flat(words)
        self.lanes = word_lanes(self.data, self.starts, self.sizes)
        counts = [int(x.sum()) for x in self.levels]
        firsts = np.cumsum([0, *counts])
        self.ranks = [f + np.cumsum(x) - 1 for f, x in zip(firsts, self.levels, strict=False)]
        self.rest = {w: len(words) - left + i for i, w in enumerate(words[len(words) - left :])}

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + U64(level)) % U64(size)).astype(np.int64)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.words), self.left, len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        bits = b"".join(np.packbits(x).tobytes() for x in self.levels)
        return _squeezed(head + bits + self.sizes.astype("<i8").tobytes() + b"".join(self.words))

    @classmethod
    def from_bytes(cls, packed: bytes) -> PerfectHash:
        raw = _unsqueezed(packed)
        n, left, n_levels = (int(x) for x in np.frombuffer(raw, "<i8", 3))
        lengths = np.frombuffer(raw, "<i8", n_levels, 24).tolist()
        self, at = cls.__new__(cls), 24 + 8 * n_levels
        self.levels = []
        for length in lengths:
            stop = at + (length + 7) // 8
            self.levels.append(np.unpackbits(np.frombuffer(raw[at:stop], np.uint8), count=length).astype(bool))
            at = stop
        sizes = np.frombuffer(raw, "<i8", n, at).tolist()
        at += 8 * n
        words = []
        for size in sizes:
            words.append(raw[at : at + size])
            at += size
        self._keep(words, left)
        return self

    def slots(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, lanes: list[np.ndarray]) -> np.ndarray:
        """The slot of each word, or -1 for words that aren't keys: the stored key must be equal."""
        out = np.full(len(keys), -1, np.int64)
        waiting = np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(waiting):
                break
            at = self._place(keys[waiting], level, len(bits))
            hit = bits[at]
            out[waiting[hit]] = rank[at[hit]]
            waiting = waiting[~hit]
        found = np.flatnonzero(out >= 0)
        slot = out[found]
        same = self.sizes[slot] == sizes[found]
        for own, lane in zip(self.lanes, lanes, strict=True):
            same &= own[slot] == lane[found]
        out[found[~same]] = -1
        for i in np.flatnonzero((out >= 0) & (sizes > 8 * LANES)):
            if self.words[out[i]] != data[starts[i] : starts[i] + sizes[i]].tobytes():
                out[i] = -1
        if self.rest:
            for i in waiting:
                out[i] = self.rest.get(data[starts[i] : starts[i] + sizes[i]].tobytes(), -1)
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U64(32)) % U64(shards)).astype(np.int64)


def kept_terms(docs: DataFrame, rule: Rule) -> DataFrame:
    """(``lang``, ``term``) of the terms that enough documents of the language hold."""
    low = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    met = docs.select("lang", F.explode(F.array_distinct(F.split(low, SEPARATORS))).alias("term")).where("term <> ''")
    return met.groupBy("lang", "term").agg(F.count("*").alias("n")).where(F.col("n") >= rule.least_docs).select("lang", "term")


_DEALT_DDL = "lang string, shards int, shard int, term binary"
_DEALT = pa.schema([("lang", pa.string()), ("shards", pa.int32()), ("shard", pa.int32()), ("term", pa.binary())])
_SHARDS_DDL = "lang string, shards int, shard int, n int, bytes bigint, data binary"
_SHARDS = pa.schema([("lang", pa.string()), ("shards", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("bytes", pa.int64()), ("data", pa.binary())])


def _dealt(batches) -> Iterator[pa.RecordBatch]:
    for part in batches:
        words, shards = part.column(2).to_pylist(), part.column(1).to_numpy()
        keys, _ = hashed(*_flat(words))
        yield batch(_DEALT, [part.column(0), part.column(1), ((keys >> U64(32)) % shards.astype(U64)).astype(np.int32), words])


def _built(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = [w for part in batches for w in part.column("term").to_pylist()]
    data = PerfectHash(sorted(words)).to_bytes()
    yield batch(_SHARDS, [[k.as_py()] for k in key] + [[len(words)], [len(data) + 40 * len(words)], [data]])


def perfect_hashes(terms: DataFrame, rule: Rule) -> DataFrame:
    """The shards of each language: ``shards``, ``shard``, ``n`` keys, ``bytes`` that it takes in a worker, ``data``."""
    sizes = terms.groupBy("lang").agg(F.count("*").alias("n_terms"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / rule.shard_keys)).cast("int")
    sized = terms.join(sizes, "lang").select("lang", shards.alias("shards"), F.col("term").cast("binary").alias("term"))
    return sized.mapInArrow(_dealt, _DEALT_DDL).groupBy("lang", "shards", "shard").applyInArrow(_built, _SHARDS_DDL)


def rounds(sizes: list[tuple[str, int, int]], limit: int) -> list[list[tuple[str, int]]]:
    """Shards (language, shard, bytes) in the broadcasts that hold them, each of at most ``limit`` bytes or one shard."""
    out: list[list[tuple[str, int]]] = []
    room = 0
    for lang, shard, size in sizes:
        if not out or size > room:
            out.append([])
            room = limit
        out[-1].append((lang, shard))
        room -= size
    return out


_COUNTS_DDL = "lang string, source string, shard int, slice int, data binary"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("shard", pa.int32()), ("slice", pa.int32()), ("data", pa.binary())])


class Counter:
    """The dense counts of a task for one language: a row of slots for each source met."""

    def __init__(self, lang: str, shards: int, hashes: dict[int, PerfectHash], rule: Rule, width: int) -> None:
        self.lang, self.shards, self.hashes, self.rule, self.width = lang, shards, hashes, rule, width
        self.bases, total = {}, 0
        for k in sorted(hashes):
            self.bases[k], total = total, total + len(hashes[k].words)
        self.slots, self.rows = total, {}
        self.table = np.zeros((0, total), np.int64)

    def add(self, sources: list[str], owner: np.ndarray, data, starts, sizes, keys, lanes) -> Iterator[pa.RecordBatch]:
        """Count words; ``owner`` numbers each one's source. Full tables are handed on first."""
        if len(self.rows.keys() | set(sources)) * self.slots > max(self.rule.dense_cells, self.slots * len(set(sources))):
            yield from self.handed_on()
        for s in sources:
            self.rows.setdefault(s, len(self.rows))
        if len(self.rows) > len(self.table):
            more = np.zeros((max(len(self.rows), 2 * len(self.table)), self.slots), np.int64)
            more[: len(self.table)] = self.table
            self.table = more
        row = np.array([self.rows[s] for s in sources], np.int64)[owner]
        shard = shard_of(keys, self.shards)
        for k, perfect in self.hashes.items():
            own = np.flatnonzero(shard == k)
            slot = perfect.slots(data, starts[own], sizes[own], keys[own], [x[own] for x in lanes])
            hit = slot >= 0
            np.add.at(self.table.reshape(-1), row[own[hit]] * self.slots + self.bases[k] + slot[hit], 1)

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        for source, row in self.rows.items():
            out = []
            for k, perfect in self.hashes.items():
                counts = self.table[row, self.bases[k] : self.bases[k] + len(perfect.words)]
                for piece in range(0, len(counts), self.width):
                    own = counts[piece : piece + self.width]
                    if own.any():
                        out.append((self.lang, source, k, piece // self.width, _squeezed(own.astype("<i8").tobytes())))
            if out:
                yield batch(_COUNTS, list(zip(*out, strict=True)))
        self.rows, self.table = {}, np.zeros((0, self.slots), np.int64)


def _recounted(held, rule: Rule, width: int):
    """Counts of the broadcast terms in each language and source of a task."""

    def recount(batches) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        for lang, (shards, packed) in held.value.items():
            counters[lang] = Counter(lang, shards, {k: PerfectHash.from_bytes(x) for k, x in packed.items()}, rule, width)
        for part in batches:
            langs, sources = part.column(0).to_pylist(), part.column(1).to_pylist()
            texts = payloads(part.column(2))
            for lang in sorted(set(langs) & counters.keys()):
                of_lang = [i for i, x in enumerate(langs) if x == lang and texts[i]]
                names = sorted({sources[i] for i in of_lang})
                number = {s: k for k, s in enumerate(names)}
                for owners, text in _pieces([(number[sources[i]], texts[i]) for i in of_lang]):
                    data = _FOLD[np.frombuffer(text + bytes(8 * LANES), np.uint8)]
                    inside = np.append(_TERM[data], False)
                    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
                    starts, ends = edges[0::2], edges[1::2]
                    if len(starts):
                        ended = np.array([e for _, e in owners])
                        owner = np.array([o for o, _ in owners])[np.searchsorted(ended, starts, side="right")]
                        keys, lanes = hashed(data, starts, ends - starts)
                        yield from counters[lang].add(names, owner, data, starts, ends - starts, keys, lanes)
        for counter in counters.values():
            yield from counter.handed_on()

    return recount


def _pieces(rows: list[tuple[int, bytes]]) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Texts of about CHUNK_BYTES together, with (owner, end) of each; longer ones are cut between terms."""
    owners, parts, size = [], [], 0
    for owner, text in rows:
        at = 0
        while at < len(text):
            stop = min(at + CHUNK_BYTES, len(text))
            while stop < len(text) and _TERM[text[stop]]:
                stop += 1
            part = text[at:stop] + b" "
            if size and size + len(part) > CHUNK_BYTES:
                yield owners, b"".join(parts)
                owners, parts, size = [], [], 0
            size += len(part)
            owners.append((owner, size))
            parts.append(part)
            at = stop
    if parts:
        yield owners, b"".join(parts)


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in batches:
        for data in part.column("data").to_pylist():
            counts = np.frombuffer(_unsqueezed(data), "<i8")
            total = counts.copy() if total is None else total + counts
    schema = pa.schema([*_COUNTS, ("total", pa.int64())])
    yield batch(schema, [[k.as_py()] for k in key] + [[_squeezed(total.astype("<i8").tobytes())], [int(total.sum())]])


def recounts(docs: DataFrame, shards: DataFrame, rule: Rule, width: int) -> DataFrame:
    """How often each kept term stands in each language and source: dense counts by shard and slice of it."""
    spark = docs.sparkSession
    sizes = [(r.lang, r.shard, r.bytes) for r in shards.select("lang", "shard", "bytes").orderBy("lang", "shard").collect()]
    found: DataFrame | None = None
    for some in rounds(sizes, rule.broadcast_bytes):
        wanted = spark.createDataFrame(some, "lang string, shard int")
        held: dict[str, tuple[int, dict[int, bytes]]] = {}
        # one round's shards: at most rule.broadcast_bytes
        for r in shards.join(F.broadcast(wanted), ["lang", "shard"]).collect():
            held.setdefault(r.lang, (r.shards, {}))[1][r.shard] = bytes(r.data)
        counts = docs.select("lang", "source", "text").mapInArrow(_recounted(spark.sparkContext.broadcast(held), rule, width), _COUNTS_DDL)
        summed = counts.groupBy("lang", "source", "shard", "slice").applyInArrow(_summed, f"{_COUNTS_DDL}, total bigint")
        summed = written(summed, "term-counts")
        found = summed if found is None else found.union(summed)
    return spark.createDataFrame([], f"{_COUNTS_DDL}, total bigint") if found is None else found


_SLICES_DDL = "lang string, shard int, slice int, data binary"
_SLICES = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("slice", pa.int32()), ("data", pa.binary())])


def _sliced(width: int):
    """The terms of each slice of a shard, in slot order."""

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for lang, shard, data in zip(*(part.column(c).to_pylist() for c in ("lang", "shard", "data")), strict=True):
                words = PerfectHash.from_bytes(data).words
                for at in range(0, len(words), width):
                    yield batch(_SLICES, [[lang], [shard], [at // width], [_squeezed(b"\0".join(words[at : at + width]))]])

    return cut


_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_PARTS_DDL = "lang string, source string, part string, item string, value bigint"


def shares(counts: np.ndarray, total: int, n_terms: int, rule: Rule) -> np.ndarray:
    """1 + floor(unit * (count + smooth) / (total + smooth * terms)), exactly."""
    if int(counts.max(initial=0)) >= (1 << 62) // rule.unit:
        exact = [1 + rule.unit * (c + rule.smooth) // (total + rule.smooth * n_terms) for c in counts.tolist()]
        return np.array(exact, np.int64)
    return 1 + rule.unit * (counts + rule.smooth) // (total + rule.smooth * n_terms)


def _compared(rule: Rule):
    """The sums of each pair of sources, and the candidates of each source's top terms, over one slice of terms."""

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, counted = key[0].as_py(), {}
        for part in batches:
            for r in part.to_pylist():
                if r["source"] is None:
                    words, n_terms = _unsqueezed(r["data"]).split(b"\0"), r["n_terms"]
                    totals = sorted((t["source"], t["total"]) for t in r["totals"])
                else:
                    counted[r["source"]] = np.frombuffer(_unsqueezed(r["data"]), "<i8")
        none = np.zeros(len(words), np.int64)
        counts = np.stack([counted.get(s, none) for s, _ in totals])
        p = np.stack([shares(c, n, n_terms, rule) for c, (_, n) in zip(counts, totals, strict=True)])
        q = shares(counts.sum(axis=0), sum(n for _, n in totals), n_terms, rule)
        names = [s for s, _ in totals]
        for i, source in enumerate(names):
            apart = p[i] - p
            sums = (apart * apart // p).sum(axis=1).tolist()
            rows = [(lang, source, "pair", other, sums[k]) for k, other in enumerate(names) if k != i]
            above = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            values = (p[i] - q)[above] ** 2 // q[above]
            if len(above) > rule.top:
                # ties at the last place stay until items decide
                least = np.partition(values, len(values) - rule.top)[len(values) - rule.top]
                above, values = above[values >= least], values[values >= least]
            best = sorted(zip((-values).tolist(), (words[k] for k in above), strict=True))[: rule.top]
            rows += [(lang, source, "term", w.decode("utf-8", "replace"), -v) for v, w in best]
            if rows:
                yield batch(_PARTS, list(zip(*rows, strict=True)))

    return compare


def divergences(
    docs: DataFrame, rule: Rule = Rule(), text_column: str = "text", lang_column: str = "lang", source_column: str = "source"
) -> DataFrame:
    """How much each source's terms differ from every other source's of its language, and by which terms it stands out.

    Result: ``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item`` (other source or term), ``value`` and
    ``rank``. Every row is a document; null texts, languages and sources are empty text. A language
    without kept terms has pairs of value 0 and no terms; sources without terms have the smoothed share of all
    terms; a language with one source has terms only; an empty table gives no rows. Ties go
    to the item that comes first in UTF-8. Very long texts are read in pieces. Other columns are ignored whatever their names.

    Terms that do not fit one broadcast are counted in further rounds over the documents.
    """
    prepared(docs.sparkSession)
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    own = docs.select(text(lang_column).alias("lang"), text(source_column).alias("source"), text(text_column).alias("text"))
    groups = written(own.select("lang", "source").distinct(), "sources")
    most = groups.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    width = max(64, min(1 << 14, rule.dense_cells // most))
    shards = written(perfect_hashes(kept_terms(own, rule), rule), "term-hashes")
    counts = recounts(own, shards, rule, width)
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    each = F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))
    totals = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.collect_list(each).alias("totals"))
    n_terms = shards.groupBy("lang").agg(F.sum("n").alias("n_terms"))
    slices = shards.select("lang", "shard", "data").mapInArrow(_sliced(width), _SLICES_DDL)
    heads = slices.join(totals.join(n_terms, "lang"), "lang").withColumn("source", F.lit(None).cast("string"))
    none = {"totals": F.lit(None), "n_terms": F.lit(None)}
    rows = heads.unionByName(counts.drop("total").withColumns(none))
    compared = written(rows.groupBy("lang", "shard", "slice").applyInArrow(_compared(rule), _PARTS_DDL), "term-comparisons")
    # sums over slices; a term is in one slice
    summed = compared.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = groups.join(n_terms, "lang", "left_anti")
    others = bare.select("lang", F.col("source").alias("item"))
    alike = bare.join(others, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = summed.union(alike).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= rule.top))
