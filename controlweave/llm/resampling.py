"""Importance resampling of documents towards a target: hashed n-gram features and Gumbel top-k.

The n-grams of a batch are interned in open-addressed NumPy tables: slots are probed by xxhash64
keys and a slot is taken only after its content was compared. A slot stores the n-gram's bucket and
its count, so a CRC is computed once per distinct n-gram; each occurrence keeps its slot's number,
by which the bucket gains are gathered and summed per document.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from controlweave.llm.tables import CHUNK_BYTES, batch, partitions, payloads, prepared, written

U64, U32 = np.uint64, np.uint32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_OUTSIDE = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_INSIDE = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Constants of the 64-bit xxHash, fixed by its specification.
_P1, _P2, _P3, _P4, _P5 = (U64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Words up to so many bytes are compared as 8-byte lanes.
LANES = 3


@dataclass(frozen=True)
class Rule:
    """Runs of 1 to ``orders`` words in ``buckets``; ``percent`` of the texts of ``least_words`` words are drawn."""

    orders: int = 3
    buckets: int = 10_000
    scale: int = 1000
    seed: int = 42
    percent: int = 5
    least_words: int = 20


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def xxh64(lanes: list[np.ndarray], seeds: np.ndarray | int = 0) -> np.ndarray:
    """The xxHash64 of up to three 8-byte lanes, for each row, with a seed."""
    h = np.asarray(seeds, U64) + _P5 + U64(8 * len(lanes))
    for lane in lanes:
        h = _turned(h ^ (_turned(lane * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> U64(33))) * _P2
    h = (h ^ (h >> U64(29))) * _P3
    return h ^ (h >> U64(32))


def word_lanes(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The first 8 * LANES bytes of each word as 8-byte lanes, zero behind its end; ``data`` has as many bytes after the last word."""
    lanes_at = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    lanes = []
    for k in range(LANES):
        rest = np.clip(size - 8 * k, 0, 8)
        at = np.where(rest > 0, starts + 8 * k, 0)
        mask = np.where(rest >= 8, ~U64(0), (U64(1) << (U64(8) * np.minimum(rest, 7).astype(U64))) - U64(1))
        lanes.append(np.where(rest > 0, lanes_at[at].astype(U64) & mask, U64(0)))
    return lanes


class SlotTable:
    """An open-addressed table of one batch: interned items with linear probing.

    ``slot`` numbers the slot of each occurrence; ``holder`` is the occurrence stored in a slot, or
    -1; ``count`` and ``bucket`` belong to the slots.
    """

    def __init__(self, keys: np.ndarray, content: list[np.ndarray]) -> None:
        size = 1 << max(4, int(1.5 * len(keys)).bit_length())
        self.holder = np.full(size, -1, np.int32)
        self.bucket = np.zeros(size, np.int64)
        self.slot = np.empty(len(keys), np.int64)
        at, waiting = (keys & U64(size - 1)).astype(np.int64), np.arange(len(keys), dtype=np.int32)
        while len(waiting):
            free = self.holder[at] < 0
            # of several that claim a free slot the last stays; the others compare with it
            self.holder[at[free]] = waiting[free]
            holder = self.holder[at]
            same = keys[holder] == keys[waiting]
            for lane in content:
                same &= lane[holder] == lane[waiting]
            self.slot[waiting[same]] = at[same]
            waiting, at = waiting[~same], (at[~same] + 1) & (size - 1)
        self.count = np.bincount(self.slot, minlength=size)
        self.used = np.flatnonzero(self.holder >= 0)


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """What zero bytes make of a CRC: tables for 0 to 63 bytes, and for 64, 128, ... bytes.

    The CRC of a joined text is linear in that of its first part, so four lookups append a length.
    """
    one = np.arange(256, dtype=U32)
    for _ in range(8):
        one = np.where(one & 1, (one >> U32(1)) ^ U32(0xEDB88320), one >> U32(1))
    table = np.concatenate([np.arange(256, dtype=U32) << U32(8 * k) for k in range(4)])
    short = [table]
    for _ in range(64):
        short.append(one[short[-1] & U32(255)] ^ (short[-1] >> U32(8)))
    long = [short.pop()]
    for _ in range(30):
        long.append(_looked_up(long[-1], long[-1]))
    return np.stack(short), np.stack(long)


def _looked_up(table: np.ndarray, crc: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
    out = table[base + (crc & U32(255)).astype(np.int64)]
    for k in (1, 2, 3):
        out = out ^ table[base + 256 * k + ((crc >> U32(8 * k)) & U32(255)).astype(np.int64)]
    return out


_SHORT, _LONG = _crc_tables()
_STEP = _SHORT[1][:256]


def _word_crcs(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: byte by byte for all words at once, the longer ones one by one."""
    order = np.argsort(-size, kind="stable")
    starts, size = starts[order], size[order]
    long = int(np.count_nonzero(size > 8 * LANES))
    state = np.full(len(size), 0xFFFFFFFF, U32)
    for j in range(int(size[long:].max(initial=0))):
        on = slice(long, int(np.searchsorted(-size, -j, side="left")))
        state[on] = _STEP[(state[on] ^ data[starts[on] + j]) & U32(255)] ^ (state[on] >> U32(8))
    state = ~state
    for i in range(long):
        state[i] = zlib.crc32(data[starts[i] : starts[i] + size[i]])
    out = np.empty(len(size), U32)
    out[order] = state
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two joined byte strings, from theirs and the second one's length."""
    out = _looked_up(_SHORT.reshape(-1), first, (length & 63) * 1024)
    high = length >> 6
    for k in range(int(high.max(initial=0)).bit_length()):
        on = np.flatnonzero((high >> k) & 1)
        out[on] = _looked_up(_LONG[k], out[on])
    return out ^ second


class Pieces:
    """Texts of a batch in pieces of about ``limit`` bytes.

    A longer text is cut outside words; each further piece begins with the words before it that
    n-grams reach back to.
    """

    def __init__(self, texts: list[bytes], orders: int, limit: int = CHUNK_BYTES) -> None:
        self.texts, self.orders, self.limit = texts, orders, limit

    def _parts(self) -> Iterator[tuple[int, bytes, int]]:
        for i, text in enumerate(self.texts):
            if len(text) <= self.limit:
                yield i, text, 0
                continue
            at, tail = 0, []
            while at < len(text):
                found = _OUTSIDE.search(text, min(at + self.limit, len(text)))
                end = found.end() if found else len(text)
                part = text[at:end]
                yield i, b" ".join([*tail, part]), len(tail)
                tail, at = (tail + _INSIDE.findall(part))[-(self.orders - 1) or len(text) :] if self.orders > 1 else [], end

    def __iter__(self) -> Iterator[list[tuple[int, bytes, int]]]:
        group, size = [], 0
        for part in self._parts():
            if group and size + len(part[1]) > self.limit:
                yield group
                group, size = [], 0
            group.append(part)
            size += len(part[1])
        if group:
            yield group


class Features:
    """The n-gram occurrences of one group of pieces.

    ``tables`` has a table per order, ``owner`` the text of each occurrence of that order, and
    ``words`` the number of new words of each piece's text.
    """

    def __init__(self, group: list[tuple[int, bytes, int]], rule: Rule) -> None:
        parts = [p for _, p, _ in group]
        data = _FOLD[np.frombuffer(b"\n".join([*parts, bytes(8 * LANES)]), np.uint8)]
        inside = _WORD[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[0::2], edges[1::2]
        ended = np.cumsum([len(p) + 1 for p in parts])
        piece = np.searchsorted(ended, starts, side="right")
        first = np.searchsorted(piece, np.arange(len(parts) + 1))
        carried = np.array([c for _, _, c in group], np.int64)
        owner = np.array([i for i, _, _ in group], np.int64)
        words, crcs, spaced, length = self._words(data, starts, ends)
        number = words.slot
        self.tables, self.owners = [], []
        place = np.arange(len(starts)) - first[piece]
        ids, at = number, np.arange(len(starts))
        code = crcs[number]
        for order in range(1, rule.orders + 1):
            if order > 1:
                # runs of one word more whose words are all of one piece
                inner = at + order - 1 < len(starts)
                at, ids, code = at[inner], ids[inner], code[inner]
                inner = piece[at] == piece[at + order - 1]
                at, ids, code = at[inner], ids[inner], code[inner]
                last = at + order - 1
                lanes = [ids.astype(U64), number[last].astype(U64)]
                table = SlotTable(xxh64(lanes), lanes)
                held = table.holder[table.used]
                joined = np.zeros(len(table.holder), U32)
                joined[table.used] = joined_crc(code[held], spaced[last[held]], length[last[held]])
                ids, code = table.slot, joined[table.slot]
            else:
                table, joined = words, crcs
            table.bucket[table.used] = joined[table.used].astype(np.int64) % rule.buckets
            # runs that end in a carried word were met in the piece before
            fresh = place[at + order - 1] >= carried[piece[at]]
            if not fresh.all():
                table.count = np.bincount(table.slot[fresh], minlength=len(table.holder))
            self.tables.append((table, table.slot[fresh]))
            self.owners.append(owner[piece[at[fresh]]])

    @staticmethod
    def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[SlotTable, np.ndarray, np.ndarray, np.ndarray]:
        """The words' table and the CRC in each slot; of each word, the CRC of a space and the word, and that length."""
        size = ends - starts
        lanes = word_lanes(data, starts, size)
        keys = xxh64(lanes, size.astype(U64))
        content = [size, *lanes]
        long = np.flatnonzero(size > 8 * LANES)
        if len(long):
            # longer words are told apart by all their bytes
            known: dict[bytes, int] = {}
            told = np.zeros(len(size), np.int64)
            for i in long:
                word = data[starts[i] : ends[i]].tobytes()
                told[i] = known.setdefault(word, len(known) + 1)
                keys[i] = xxhash.xxh64_intdigest(word)
            content.append(told)
        table = SlotTable(keys, content)
        held = table.holder[table.used]
        crc, spaced = np.zeros(len(table.holder), U32), np.zeros(len(table.holder), U32)
        crc[table.used] = _word_crcs(data, starts[held], size[held])
        spaced[table.used] = joined_crc(np.full(len(held), zlib.crc32(b" "), U32), crc[table.used], size[held])
        return table, crc, spaced[table.slot], size + 1


_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def bucket_counts(texts: DataFrame, rule: Rule) -> DataFrame:
    """(``bucket``, ``n``): how often the features of all texts (first column, bytes) fall into each bucket met."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rule.buckets, np.int64)
        for part in batches:
            for group in Pieces([t or b"" for t in payloads(part.column(0))], rule.orders):
                for table, _ in Features(group, rule).tables:
                    np.add.at(total, table.bucket[table.used], table.count[table.used])
        met = np.flatnonzero(total)
        yield batch(_COUNTS, [met.astype(np.int32), total[met]])

    return texts.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, rule: Rule) -> np.ndarray:
    """The gain of each bucket; two tables of fixed size are all that reaches the driver."""
    s, t = np.zeros(rule.buckets, np.int64), np.zeros(rule.buckets, np.int64)
    for counts, texts in ((s, docs), (t, target)):
        for row in bucket_counts(texts, rule).collect():
            counts[row.bucket] = row.n
    n_s, n_t = float(s.sum() + rule.buckets), float(t.sum() + rule.buckets)
    ratio = [(b + 1.0) * n_s / ((a + 1.0) * n_t) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    return np.array([math.floor(rule.scale * math.log(r)) for r in ratio], np.int64)


def _noise(doc_id: int | None, rule: Rule) -> int:
    """Gumbel noise from the document's id."""
    h = int(hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-rule.scale * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("n_words", pa.int64())])
_SCORED_DDL = "doc_id bigint, n_features bigint, weight bigint, score bigint, n_words bigint"


def _scored(own: DataFrame, gain: np.ndarray, rule: Rule) -> DataFrame:
    held = own.sparkSession.sparkContext.broadcast(gain)

    def score(batches) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for part in batches:
            texts = [t or b"" for t in payloads(part.column(1))]
            n, n_words, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for group in Pieces(texts, rule.orders):
                features = Features(group, rule)
                for order, ((table, slots), owner) in enumerate(zip(features.tables, features.owners, strict=True)):
                    np.add.at(n, owner, 1)
                    np.add.at(weight, owner, gain[table.bucket][slots])
                    if order == 0:
                        np.add.at(n_words, owner, 1)
            ids = part.column(0).to_pylist()
            yield batch(_SCORED, [ids, n, weight, [int(w) + _noise(i, rule) for i, w in zip(ids, weight, strict=True)], n_words])

    return own.mapInArrow(score, _SCORED_DDL)


def _ranked(scored: DataFrame, rule: Rule) -> DataFrame:
    """Ranks of the highest scores, by ranges: the rows of a range are counted, and its ranks begin after all ranges before it."""
    spark = scored.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    ranges = scored.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id())
    ranges = written(ranges, "scores-by-range")
    # a row per range: the prefix sum of their sizes fits in one task
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))
    every = Window.orderBy("range")
    before = F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    begins = sizes.select("range", before.alias("before"), F.floor(total * rule.percent / 100).alias("drawn"))
    placed = ranges.join(F.broadcast(begins), "range")
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    columns = ["doc_id", "n_features", "weight", "score"]
    near = placed.where("before < drawn").withColumn("rank", (F.col("before") + within).cast("bigint"))
    near = near.select(*columns, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank"))
    return near.union(placed.where("before >= drawn").select(*columns, F.lit(None).cast("bigint").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, rule: Rule = Rule(),
    id_column: str = "doc_id", text_column: str = "text", target_column: str = "text",
) -> DataFrame:
    """Weigh every document by how much likelier its n-grams are in the target, and draw by weight.

    Result, a row per input row: the id, ``n_features``, ``weight``, ``score`` (weight and Gumbel noise
    of the id) and ``rank`` (null: not drawn). Words are runs of ASCII letters and digits and all characters
    beyond ASCII, A-Z in lower case. Null and empty texts have no features and weight 0, and like
    all texts of too few words they are not drawn. Ties go to the smaller id; rows that repeat an id
    are judged each on its own, with the same noise; a row without an id has the noise of the empty
    text and comes first among ties. An empty table gives no rows, an empty target leaves gains of an empty count.
    Very long texts are read in pieces. Other columns are ignored whatever their names.
    """
    prepared(docs.sparkSession)
    own = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("binary").alias("text"))
    gain = gains(own.select("text"), target.select(target[target_column].cast("binary").alias("text")), rule)
    scored = written(_scored(own, gain, rule), "scores")
    ranked = _ranked(scored.where(F.col("n_words") >= rule.least_words), rule)
    short = scored.where(F.col("n_words") < rule.least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return ranked.union(short).withColumnRenamed("doc_id", id_column)
