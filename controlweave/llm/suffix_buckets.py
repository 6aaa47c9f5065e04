"""Exact removal of byte strings that also start in a document with a smaller id.

Texts are packed into blocks. Every window of ``Rule.length`` bytes has an anchor, the 24 bytes
within it whose hash is smallest, so equal windows have equal anchors. A window also holds the bytes
just before its anchor, or those just behind it. Blocks exchange the hashes of
their anchors and of what is around them; windows whose anchor with that side stands in one document only cannot repeat. Runs of the other
windows are sent to the bucket of their anchor, each content once per block, where their suffixes
are sorted by bucket-pointer refinement: initial buckets of 8 bytes are refined by sorting on the bucket
identifiers of later offsets, and the refined identifiers serve the next, twice as deep, refinement,
up to the window's length. The smallest id of a final bucket decides on its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from controlweave.llm.arrays import mixed
from controlweave.llm.tables import batch, partitions, payloads, prepared, release_shuffles, written

U64 = np.uint64
#: Bytes of an anchor, and of an initial bucket.
ANCHOR, GRAM = 24, 8
#: Bytes of a bucket that are sorted at once.
PART_BYTES = 1 << 20
#: Bytes of a block whose windows are looked at together, so that tables stay in the cache, and the bits of a place within them.
RUN_BYTES, PLACE_BITS = 1 << 15, 21
#: Stands for a missing id: larger than any other.
NO_ID = (1 << 63) - 1
#: What another block has, too: the anchor with the bytes before it, and with those behind it; and whether the anchor is hot.
LEFT, RIGHT, HOT = 1, 2, 4
#: An entry is a bucket, 20 bits of an anchor's hash, and SIDE_BITS of the hash of either side; 0 if no window holds that side.
SIDE_BITS, ANCHOR_BITS = 12, 20
ENTRY_BITS = 2 * SIDE_BITS + ANCHOR_BITS
_SIDE = U64((1 << SIDE_BITS) - 1)


@dataclass(frozen=True)
class Rule:
    """Strings of ``length`` bytes; texts go together up to ``block_bytes``.

    Each shuffle partition has ``groups`` buckets. An anchor in ``hot_blocks`` blocks or more is hot:
    its windows are dealt out one by one, by all their bytes.
    """

    length: int = 50
    block_bytes: int = 2 << 20
    groups: int = 4
    hot_blocks: int = 256

    def __post_init__(self) -> None:
        if self.length < ANCHOR:
            raise ValueError(f"strings of fewer than {ANCHOR} bytes have no anchor")


def _squeezed(array: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(array if isinstance(array, bytes) else array.tobytes())


def _unsqueezed(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


_BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
_BLOCKS_DDL = "block bigint, ids array<bigint>, sizes array<bigint>, data binary"


def _packed(rule: Rule):
    """Consecutive texts as blocks, numbered by task; the table they are written to fixes them."""

    def pack(batches) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def block() -> pa.RecordBatch:
            return batch(_BLOCKS, [[number], [ids], [[len(t) for t in texts]], [_squeezed(b"".join(texts))]])

        for part in batches:
            for doc_id, text in zip(part.column(0).to_pylist(), payloads(part.column(1)), strict=True):
                text = text or b""
                if ids and size + len(text) > rule.block_bytes:
                    yield block()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if ids:
            yield block()

    return pack


class Block:
    """The texts of a block and the runs of windows with one anchor.

    Of each run: ``begin`` (place of the first window), ``count`` (windows), ``doc`` (number of the
    text), ``anchor`` (bucket and 32 bits of the anchor's hash), ``left`` (so many windows, the first ones, hold the
    bytes before the anchor, the others those behind it) and ``entry`` (anchor and sides).
    """

    def __init__(self, row: dict, rule: Rule, buckets: int) -> None:
        self.rule, self.buckets = rule, buckets
        self.ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.text = zstandard.ZstdDecompressor().decompress(row["data"])
        padded = np.frombuffer(self.text + bytes(ANCHOR + 8), np.uint8)
        self.lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))

    def hashes(self, at: slice | np.ndarray) -> np.ndarray:
        """Of the ANCHOR bytes from each place on."""
        if isinstance(at, slice):
            lane = lambda k: self.lanes[at.start + k : at.stop + k].astype(U64)
        else:
            lane = lambda k: self.lanes[at + k].astype(U64)
        return mixed(lane(0) * U64(0x9E3779B97F4A7C15) + mixed(lane(8) * U64(0xC2B2AE3D27D4EB4F) + lane(16) * U64(0x165667B19E3779F9)))

    def dealt(self, hashes: np.ndarray) -> np.ndarray:
        """Bucket (upper half) and identity (lower half) of hashes."""
        bucket = ((hashes >> U64(32)) * U64(self.buckets)) >> U64(32)
        return (bucket << U64(32)) | (hashes & U64(0xFFFFFFFF))

    @cached_property
    def runs(self) -> dict[str, np.ndarray]:
        parts = [self._runs(a) for a in range(0, max(len(self.text) - self.rule.length + 1, 0), RUN_BYTES)]
        names = ("begin", "count", "doc", "hash", "place")
        out = {n: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, U64 if n == "hash" else np.int64) for k, n in enumerate(names)}
        place, anchor = out.pop("place"), self.dealt(out.pop("hash"))
        before = (self.rule.length - ANCHOR) // 2
        behind = self.rule.length - ANCHOR - before + 1
        left = np.clip(place - before - out["begin"] + 1, 0, out["count"])
        entry = (anchor >> U64(32) << U64(ENTRY_BITS)) | ((anchor & U64(0xFFFFFFFF)) >> U64(32 - ANCHOR_BITS) << U64(2 * SIDE_BITS))
        for has, at, shift in ((left > 0, place - before, SIDE_BITS), (left < out["count"], place + behind, 0)):
            side = self.hashes(np.where(has, at, 0)) % _SIDE + U64(1)
            entry |= np.where(has, side, U64(0)) << U64(shift)
        return out | {"anchor": anchor, "left": left, "entry": entry}

    def _runs(self, a: int) -> tuple[np.ndarray, ...]:
        length = self.rule.length
        n = min(RUN_BYTES, len(self.text) - length + 1 - a)
        width = length - ANCHOR + 1
        hashes = self.hashes(slice(a, a + n + width - 1))
        least = (hashes & ~U64((1 << PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=U64)
        step = 1
        while 2 * step <= width:
            least, step = np.minimum(least[:-step], least[step:]), 2 * step
        if width > step:
            least = np.minimum(least[: step - width], least[width - step :])
        where = (least & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first, last = np.searchsorted(self.ends, [a, a + n - 1], side="right")
        doc = np.repeat(np.arange(first, last + 1), np.diff(np.clip(self.ends[first : last + 1], a, a + n), prepend=a))
        inside = np.arange(a, a + n) + length <= self.ends[doc]
        new = np.ones(n, bool)
        new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(begin, append=n)
        kept = inside[begin]
        begin, count = begin[kept], count[kept]
        return begin + a, count, doc[begin], hashes[where[begin]], where[begin] + a


_ANCHORS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
_ANCHORS_DDL = "bucket int, block bigint, data binary"


def _rows_by_bucket(block: int, buckets: np.ndarray) -> list[tuple[int, int, slice]]:
    """(bucket, block, its part of an array sorted by bucket)."""
    cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
    return [(int(buckets[a]), block, slice(a, b)) for a, b in zip(cuts, [*cuts[1:], len(buckets)], strict=False)]


def _anchors(rule: Rule, buckets: int):
    """The distinct entries of each block, by bucket."""

    def anchors(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                own = np.unique(Block(row, rule, buckets).runs["entry"])
                sides = (own & U64((1 << 2 * SIDE_BITS) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
                anchor = (own >> U64(2 * SIDE_BITS)).astype("<u4") & np.uint32((1 << ANCHOR_BITS) - 1)
                rows = [(k, b, _squeezed(np.diff(anchor[s], prepend=np.uint32(0)).tobytes() + sides[s].tobytes())) for k, b, s in _rows_by_bucket(row["block"], (own >> U64(ENTRY_BITS)).astype(np.int64))]
                if rows:
                    yield batch(_ANCHORS, list(zip(*rows, strict=True)))

    return anchors


def _entries(data: bytes) -> np.ndarray:
    """The entries, without their bucket, that a block sent to it."""
    raw = _unsqueezed(data, np.uint8)
    n = len(raw) // 7
    sides = np.zeros((n, 4), np.uint8)
    sides[:, :3] = raw[4 * n :].reshape(n, 3)
    return (np.cumsum(raw[: 4 * n].view("<u4"), dtype=U64) << U64(2 * SIDE_BITS)) | sides.view("<u4").reshape(n)


def _sided(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors with the bytes before them, and with those behind them, as numbers that differ; 0 if there is no such side."""
    left, right = entries >> U64(SIDE_BITS), entries & _SIDE
    anchor = entries >> U64(2 * SIDE_BITS)
    return np.where(left & _SIDE, left << U64(1), U64(0)), np.where(right, (((anchor << U64(SIDE_BITS)) | right) << U64(1)) | U64(1), U64(0))


def _within(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _met(rule: Rule):
    """For each block's entries of a bucket, which sides another block has, and whether the anchor is hot: a byte for each."""

    def met(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for part in batches for r in part.to_pylist()]
        own = [_entries(r["data"]) for r in rows]
        values, counts = np.unique(np.concatenate([np.unique(np.concatenate(_sided(e))) for e in own]), return_counts=True)
        values = values[(counts > 1) & (values > 0)]
        hot = np.empty(0, U64)
        if len(own) >= rule.hot_blocks:
            anchors, counts = np.unique(np.concatenate([np.unique(e >> U64(2 * SIDE_BITS)) for e in own]), return_counts=True)
            hot = anchors[counts >= rule.hot_blocks]
        for r, entries in zip(rows, own, strict=True):
            left, right = (_within(values, side) for side in _sided(entries))
            codes = LEFT * left.astype(np.uint8) | RIGHT * right.astype(np.uint8) | HOT * _within(hot, entries >> U64(2 * SIDE_BITS)).astype(np.uint8)
            yield batch(_ANCHORS, [[r["bucket"]], [r["block"]], [_squeezed(codes)]])

    return met


def _pieces(rule: Rule, buckets: int):
    """What each block sends to the buckets: the bytes of runs that may repeat, each content once,
    with the smallest id that has it."""

    def pieces(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                sent = Runs(Block(row, rule, buckets), row["met"]).rows(row["block"])
                if sent:
                    yield batch(_ANCHORS, list(zip(*sent, strict=True)))

    return pieces


class Runs:
    """The runs of a block's windows that may repeat: ``begin``, ``count`` and ``piece`` (the number of its content)
    of each, and whether it is ``lost``, as a text of the block with a smaller id has the same run.

    Pieces are numbered in the order of their buckets and anchors.
    """

    def __init__(self, block: Block, met: list[dict] | None) -> None:
        length, runs = block.rule.length, block.runs
        own, which = np.unique(runs["entry"], return_inverse=True)
        codes = np.concatenate([np.empty(0, np.uint8), *(_unsqueezed(a["data"], np.uint8) for a in sorted(met or [], key=lambda a: a["bucket"]))])
        shared = []
        for side, bit in zip(_sided(own), (LEFT, RIGHT), strict=True):
            # an anchor with this side in two texts of the block is shared, too
            values, of = np.unique(side, return_inverse=True)
            low, high = np.full(len(values), len(block.ids)), np.full(len(values), -1)
            np.minimum.at(low, of[which], runs["doc"])
            np.maximum.at(high, of[which], runs["doc"])
            shared.append((((codes & bit) > 0) | (low < high)[of])[which])
        first, last = (np.where(some, n, 0) for some, n in zip(shared, (runs["left"], runs["count"] - runs["left"]), strict=True))
        # of a run, the windows with a side that is shared: the first ones, the last ones or all
        begins, counts = runs["begin"] + np.where(first > 0, 0, runs["left"]), first + last
        hot = (counts > 0) & ((codes & HOT) > 0)[which]
        cool = (counts > 0) & ~hot
        begin, count, doc, key = begins[cool], counts[cool], runs["doc"][cool], runs["anchor"][cool]
        if hot.any():
            single = _spread(begins[hot], counts[hot])
            whole = block.hashes(single)
            for k in [*range(ANCHOR, length - ANCHOR, ANCHOR), length - ANCHOR]:
                whole = mixed(whole + block.hashes(single + k))
            begin = np.concatenate([begin, single])
            count = np.concatenate([count, np.ones(len(single), np.int64)])
            doc = np.concatenate([doc, np.repeat(runs["doc"][hot], counts[hot])])
            key = np.concatenate([key, block.dealt(whole)])
        known: dict[bytes, int] = {}
        text = block.text
        piece = np.array([known.setdefault(text[a:b], len(known)) for a, b in zip(begin.tolist(), (begin + count + length - 1).tolist(), strict=True)], np.int64)
        contents = list(known)
        keys, least = np.zeros(len(contents), U64), np.full(len(contents), NO_ID)
        keys[piece] = key
        np.minimum.at(least, piece, block.ids[doc])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.begin, self.count, self.piece, self.lost = begin, count, place[piece], block.ids[doc] > least[piece]
        self.contents, self.keys, self.least = [contents[i] for i in order], keys[order], least[order]
        self.windows = np.array([len(c) - length + 1 for c in self.contents], np.int64)
        self.sizes = self.windows + length - 1

    def rows(self, block: int) -> list[tuple[int, int, bytes]]:
        """The pieces for each bucket."""
        out = []
        tops = ((self.keys >> U64(24)) & U64(255)).astype(np.uint8)
        for bucket, number, s in _rows_by_bucket(block, (self.keys >> U64(32)).astype(np.int64)):
            head = np.concatenate([[s.stop - s.start], self.sizes[s], self.least[s]]).astype("<i8").tobytes()
            out.append((bucket, number, _squeezed(head + tops[s].tobytes() + b"".join(self.contents[s]))))
        return out


def bucket_pointers(data: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """For each place, the bucket of the ``length`` bytes from it on: equal for equal bytes, ordered as they are.

    ``end`` is where the text of each place ends; places with fewer bytes keep the bucket of a shorter string or
    -1. Initial buckets hold equal strings of GRAM bytes and are named by the place of their last member
    in the sorted order. Buckets of several members are refined by sorting on the buckets of the bytes
    behind those compared so far, and the new names are used by the next refinement.
    """
    pointer = np.full(len(data), -1, np.int64)
    rest = end - np.arange(len(data))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    grams = np.ndarray((len(data),), ">u8", padded, strides=(1,))
    members = np.flatnonzero(rest >= GRAM)
    key = grams[members].astype(U64)
    order = np.argsort(key)
    members, key = members[order], key[order]
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True)[: len(key)])
    pointer[members] = np.repeat(last, np.diff(last, prepend=-1))
    depth = GRAM
    while depth < length and len(members):
        step = min(depth, length - depth)
        bucket = pointer[members]
        # members of one bucket stand together; single ones are settled
        same = bucket[1:] == bucket[:-1]
        several = np.append(same, False) | np.insert(same, 0, False)
        members = members[several & (rest[members] >= depth + step)]
        if not len(members):
            break
        bucket, later = pointer[members], pointer[members + step]
        # both are below 2 ** 31 and sorted as one number
        order = np.argsort((bucket << 32) + later)
        members, bucket, later = members[order], bucket[order], later[order]
        ends = np.append((bucket[1:] != bucket[:-1]) | (later[1:] != later[:-1]), True)
        last = np.flatnonzero(ends)
        of_bucket = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True))
        # a part of a bucket is named by its last member's place, counted from the bucket's end
        behind = np.repeat(of_bucket, np.diff(of_bucket, prepend=-1))[last] - last
        pointer[members] = np.repeat(bucket[last] - behind, np.diff(last, prepend=-1))
        depth += step
    return pointer


class _Sent:
    """The pieces that a block sent to a bucket, in the order of their anchors' hashes."""

    def __init__(self, data: bytes) -> None:
        self.raw = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(self.raw, "<i8", 1)[0])
        head = np.frombuffer(self.raw, "<i8", 2 * n, 8)
        self.sizes, self.ids = head[:n], head[n:]
        self.tops = np.frombuffer(self.raw, np.uint8, n, 8 + 16 * n)
        self.ends = 8 + 17 * n + np.cumsum(self.sizes)

    def between(self, low: int, high: int) -> tuple[list[bytes], np.ndarray]:
        """The contents and ids of the pieces whose upper bits are from low to high."""
        a, b = np.searchsorted(self.tops, low, side="left"), np.searchsorted(self.tops, high, side="right")
        ends = self.ends[a:b].tolist()
        return [self.raw[e - n : e] for e, n in zip(ends, self.sizes[a:b].tolist(), strict=True)], self.ids[a:b]


def _repeated(sent: list[tuple[list[bytes], np.ndarray]], rule: Rule) -> list[np.ndarray]:
    """For the windows of each block's pieces, whether any piece with a smaller id has them."""
    known: dict[bytes, int] = {}
    content = [np.array([known.setdefault(c, len(known)) for c in contents], np.int64) for contents, _ in sent]
    least = np.full(len(known), NO_ID)
    for which, (_, ids) in zip(content, sent, strict=True):
        np.minimum.at(least, which, ids)
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    data = np.frombuffer(b"".join(known), np.uint8)
    ends = np.cumsum(sizes)
    windows = sizes - rule.length + 1
    pointer = bucket_pointers(data, np.repeat(ends, sizes), rule.length)[_spread(ends - sizes, windows)]
    smallest = np.repeat(least, windows)
    order = np.argsort(pointer)
    cuts = np.flatnonzero(np.diff(pointer[order], prepend=-1))
    if len(cuts):
        smallest[order] = np.repeat(np.minimum.reduceat(smallest[order], cuts), np.diff(cuts, append=len(order)))
    first = np.cumsum(windows) - windows
    return [smallest[_spread(first[w], windows[w])] < np.repeat(ids, windows[w]) for w, (_, ids) in zip(content, sent, strict=True)]


def _judged(rule: Rule):
    """For each window sent to a bucket, whether a text with a smaller id has it: a bit for each, by block."""

    def judge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = [(r["block"], _Sent(r["data"])) for part in batches for r in part.to_pylist()]
        weight = sum(np.bincount(x.tops, x.sizes, 256) for _, x in sent)
        # anchors with equal upper bits of their hash stay together
        share = (np.cumsum(weight) // PART_BYTES).astype(np.int64)
        bits: list[list[np.ndarray]] = [[] for _ in sent]
        for part in np.unique(share):
            low, high = np.flatnonzero(share == part)[[0, -1]]
            for mine, found in zip(bits, _repeated([x.between(low, high) for _, x in sent], rule), strict=True):
                mine.append(found)
        for (block, _), mine in zip(sent, bits, strict=True):
            every = np.concatenate(mine)
            yield batch(_ANCHORS, [[key[0].as_py()], [block], [_squeezed(np.int64(len(every)).tobytes() + np.packbits(every).tobytes())]])

    return judge


_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.binary())])
_CUT_DDL = "doc_id bigint, n_bytes bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary"


def _removed(block: Block, row: dict) -> np.ndarray:
    """Whether each byte of a block goes."""
    cover = np.zeros(len(block.text) + 1, np.int32)
    if row["judged"] is not None:
        runs = Runs(block, row["met"])
        parts = [_unsqueezed(a["data"], np.uint8) for a in sorted(row["judged"], key=lambda a: a["bucket"])]
        bits = np.concatenate([np.unpackbits(p[8:], count=int(p[:8].view("<i8")[0])) for p in parts]).astype(bool)
        first = np.cumsum(runs.windows) - runs.windows
        gone = bits[_spread(first[runs.piece], runs.count)] | np.repeat(runs.lost, runs.count)
        starts = _spread(runs.begin, runs.count)[gone]
        cover[starts] += 1
        cover[starts + block.rule.length] -= 1
    return np.cumsum(cover[:-1]) > 0


def _cut(rule: Rule, buckets: int):
    def cut(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                block = Block(row, rule, buckets)
                gone, data = _removed(block, row), np.frombuffer(block.text, np.uint8)
                spans, kept = [], []
                for a, b in zip((block.ends - block.sizes).tolist(), block.ends.tolist(), strict=True):
                    edges = np.flatnonzero(np.diff(gone[a:b].view(np.int8), prepend=0, append=0)).tolist()
                    spans.append([{"begin": x, "end": y} for x, y in zip(edges[0::2], edges[1::2], strict=True)])
                    kept.append(data[a:b][~gone[a:b]].tobytes())
                yield batch(_CUT, [row["ids"], block.sizes, spans, kept])

    return cut


def remove_repeats(docs: DataFrame, rule: Rule = Rule(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Cut each byte that lies in a string of ``rule.length`` bytes which also starts in a document with a smaller id.

    Result, a row per input row: the id, ``n_bytes`` of the text in UTF-8, ``spans`` (the maximal runs
    cut, as ``begin`` and ``end``) and ``kept`` (what remains, as bytes: a cut may fall within a
    character). Strings never reach across documents and are judged on the input; a string that
    repeats only within its document stays. Null texts are empty. Rows that repeat an id
    don't cut one another; a row without an id counts as later than all others, so it is cut by all
    and cuts none. An empty table gives no rows; other columns are ignored whatever their names.

    A bucket's group is what one task holds: with more data, give the session more shuffle
    partitions. Content that many texts share arrives once per block.
    """
    spark = prepared(docs.sparkSession)
    n = partitions(spark)
    buckets = min(rule.groups * n, 1 << 64 - ENTRY_BITS)
    own = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("binary").alias("text"))
    blocks = written(own.mapInArrow(_packed(rule), _BLOCKS_DDL), "text-blocks")
    by_block = lambda rows, name: rows.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias(name))
    anchors = blocks.mapInArrow(_anchors(rule, buckets), _ANCHORS_DDL)
    met = written(by_block(anchors.groupBy("bucket").applyInArrow(_met(rule), _ANCHORS_DDL), "met"), "anchors-met")
    # what buckets were sent is no longer needed once they have answered
    release_shuffles(spark)
    pieces = blocks.join(met, "block").mapInArrow(_pieces(rule, buckets), _ANCHORS_DDL)
    judged = written(by_block(pieces.groupBy("bucket").applyInArrow(_judged(rule), _ANCHORS_DDL), "judged"), "windows-judged")
    release_shuffles(spark)
    # runs are found once more: that costs less than to store them
    answers = met.join(judged, "block", "left")
    cut = blocks.join(answers, "block", "left").select("ids", "sizes", "data", "met", "judged").mapInArrow(_cut(rule, buckets), _CUT_DDL)
    return cut.withColumnRenamed("doc_id", id_column)
