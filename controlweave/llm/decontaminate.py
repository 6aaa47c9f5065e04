"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to features whose document frequencies come from all passages of the corpus. A
randomised SVD of TF-IDF passages gives each feature a latent vector. Every window of every document
is then held against all benchmark items by cosine, and what is close is confirmed on the words:
their longest common subsequence with the item, and the item's answer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from controlweave.llm.arrays import U64, Words
from controlweave.llm.tables import batch, chunks, payloads, prepared, release_shuffles, written

FEATURES = 1 << 15
#: Latent dimensions, and columns of the random sketch from which they are taken. The leading COMMON
#: directions tell languages and frequent words apart, not passages, and are left out.
RANK, COMMON, SKETCH = 48, 8, 64
#: Words of a passage whose terms are counted.
PASSAGE = 32
#: Blocks whose vectors are summed together, so that they stay in a core's cache.
BLOCKS = 1 << 11
#: Windows begin at every multiple of BLOCK words and have these lengths in blocks.
BLOCK, LENGTHS = 8, (2, 3, 4, 6, 8)
COSINE = 0.6
#: A match needs this share of the item's words in order, or the smaller one and the answer.
LCS, LCS_WITH_ANSWER, ANSWER = 0.7, 0.5, 0.8
#: Benchmark items held against the documents in one pass.
ITEMS = 20_000


def _features(words: Words) -> np.ndarray:
    return (words.hashes & U64(FEATURES - 1)).astype(np.int64)


def _passage_terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage number, feature and count of each distinct feature of each passage, in order."""
    place = np.arange(len(words.text)) - words.first[:-1][words.text]
    per_text = -(-np.diff(words.first) // PASSAGE)
    passage = (np.cumsum(per_text) - per_text)[words.text] + place // PASSAGE
    # half as wide where they fit, as such keys are sorted faster
    width = np.uint32 if per_text.sum() * FEATURES <= 1 << 32 else np.int64
    keys, counts = np.unique((passage * FEATURES + _features(words)).astype(width), return_counts=True)
    keys = keys.astype(np.int64)
    return keys // FEATURES, keys % FEATURES, counts


_TERMS = pa.schema([(c, pa.binary()) for c in ("sizes", "features", "counts")])
_TERMS_DDL = "sizes binary, features binary, counts binary"
_FREQUENCY = pa.schema([("feature", pa.int64()), ("n", pa.int64())])


def _terms(batches) -> Iterator[pa.RecordBatch]:
    """The passages of some texts: how many distinct features each has, these, and how often."""
    for part in batches:
        for _, group in chunks([t or b"" for t in payloads(part.column(0))]):
            words = Words(group, marks=True)
            if len(words.text):
                passage, feature, counts = _passage_terms(words)
                sizes = np.bincount(passage)
                yield batch(_TERMS, [[sizes.astype(np.uint8).tobytes()], [feature.astype("<u2").tobytes()], [counts.astype(np.uint8).tobytes()]])


def _read_terms(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for part in batches:
        for sizes, features, counts in zip(*(part.column(c).to_pylist() for c in _TERMS.names), strict=True):
            yield np.frombuffer(sizes, np.uint8).astype(np.int64), np.frombuffer(features, "<u2"), np.frombuffer(counts, np.uint8)


def _frequencies(batches) -> Iterator[pa.RecordBatch]:
    """Passages with each feature, one row per task and feature; their number as feature -1."""
    total, passages = np.zeros(FEATURES, np.int64), 0
    for sizes, features, _ in _read_terms(batches):
        total += np.bincount(features, minlength=FEATURES)
        passages += len(sizes)
    seen = np.flatnonzero(total)
    if passages:
        yield batch(_FREQUENCY, [np.concatenate([[-1], seen]), np.concatenate([[passages], total[seen]])])


_PARTIAL = pa.schema([("block", pa.int32()), ("rows", pa.binary()), ("values", pa.binary())])
_PARTIAL_DDL = "block int, rows binary, values binary"
_ROWS = 1 << 10


#: Passages that are worked on at once, rows of a table that one small product sums, and entries whose products are prepared together.
TOGETHER, WIDTH, ENTRIES = 1 << 15, PASSAGE, 1 << 16


def _together(parts: Iterator[tuple[np.ndarray, ...]], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Consecutive parts as one of at least so many passages; the last may have fewer."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= least:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _weighed(table: np.ndarray, which: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """For consecutive groups of so many entries (one at least), the weighted sum of their rows of ``table``: some groups at a time.

    Groups are cut into pieces of up to WIDTH entries, whose sums are products of small matrices, some pieces at a time.
    """
    ends = np.cumsum(sizes)
    some = np.empty((128, WIDTH, table.shape[1]), np.float32)
    # so many groups that their tables stay small, however many entries there are
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(which), ENTRIES), side="left"), len(sizes)))
    for low, high in zip(np.append(0, cuts[:-1]), cuts, strict=True):
        if low == high:
            continue
        own, begin = sizes[low:high], int(ends[low] - sizes[low])
        pieces = -(-own // WIDTH)
        first = np.cumsum(pieces) - pieces
        slot = np.arange(begin, ends[high - 1]) - np.repeat(ends[low:high] - own, own)
        piece, slot = np.repeat(first, own) + slot // WIDTH, slot % WIDTH
        n = int(pieces.sum())
        weights, rows = np.zeros((n, WIDTH), np.float32), np.zeros((n, WIDTH), np.intp)
        weights[piece, slot], rows[piece, slot] = weight[begin : ends[high - 1]], which[begin : ends[high - 1]]
        out = np.empty((n, table.shape[1]), np.float32)
        for at in range(0, n, len(some)):
            chosen = rows[at : at + len(some)]
            found = np.take(table, chosen, axis=0, out=some[: len(chosen)], mode="clip")
            np.matmul(weights[at : at + len(chosen), None, :], found, out=out[at : at + len(chosen), None, :])
        yield slice(low, high), out if n == len(own) else np.add.reduceat(out, first, axis=0)


def _sketched(idf: np.ndarray, basis: np.ndarray):
    """Each task's part of A'(A basis), A being the unit TF-IDF vectors of the passages: the rows of the features it has, by block."""

    logs = (1 + np.log(np.arange(1, PASSAGE + 1))).astype(np.float32)
    factor, basis = idf.astype(np.float32), np.ascontiguousarray(basis, np.float32)

    def add(out: np.ndarray, sizes: np.ndarray, feature: np.ndarray, counts: np.ndarray) -> None:
        weight = logs[counts - 1] * factor[feature]
        norms = np.sqrt(np.add.reduceat(weight * weight, np.cumsum(sizes) - sizes))
        weight /= np.repeat(np.maximum(norms, 1e-12), sizes)
        rows = np.empty((len(sizes), basis.shape[1]), np.float32)
        for groups, sums in _weighed(basis, feature, weight, sizes):
            rows[groups] = sums
        order = np.argsort(feature, kind="stable").astype(np.int32)
        sorted_, passage = feature[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        firsts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        distinct = sorted_[firsts]
        for groups, sums in _weighed(rows, passage, weight[order], np.diff(firsts, append=len(order))):
            out[distinct[groups]] += sums

    def sketch(batches) -> Iterator[pa.RecordBatch]:
        out, seen = np.zeros(basis.shape, np.float64), np.zeros(len(basis), bool)
        for sizes, feature, counts in _together(_read_terms(batches), TOGETHER):
            seen[feature] = True
            add(out, sizes, feature, counts)
        own = np.flatnonzero(seen)
        cuts = np.searchsorted(own, np.arange(0, len(basis) + 1, _ROWS))
        blocks = [(k, own[x:y]) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]
        if blocks:
            yield batch(_PARTIAL, [[k for k, _ in blocks], [(f % _ROWS).astype("<u2").tobytes() for _, f in blocks], [out[f].astype(np.float32).tobytes() for _, f in blocks]])

    return sketch


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in batches:
        for rows, values in zip(part.column("rows").to_pylist(), part.column("values").to_pylist(), strict=True):
            rows = np.frombuffer(rows, "<u2")
            values = np.frombuffer(values, np.float32).reshape(len(rows), -1)
            total = np.zeros((_ROWS, values.shape[1])) if total is None else total
            total[rows] += values
    seen = np.flatnonzero(total.any(axis=1))
    yield batch(_PARTIAL, [[key[0].as_py()], [seen.astype("<u2").tobytes()], [total[seen].astype(np.float32).tobytes()]])


@dataclass
class Space:
    """Latent vectors of the features, inverse document frequencies included."""

    vectors: np.ndarray

    def embed(self, features: np.ndarray) -> np.ndarray:
        return self.vectors[features].sum(axis=0)


def fit(docs: DataFrame, seed: int = 11) -> Space:
    """Frequencies, and a randomised SVD with one power step, over all passages.

    The passages' features are stored once and read by each step. What comes to the driver are tables of
    FEATURES rows, whatever the corpus.
    """
    spark = prepared(docs.sparkSession)
    terms = written(docs.select(docs["text"].cast("binary").alias("text")).mapInArrow(_terms, _TERMS_DDL), "passage-terms")
    counted = terms.mapInArrow(_frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    frequency, total = np.zeros(FEATURES), 0
    for row in counted:
        if row.feature < 0:
            total = row.n
        else:
            frequency[row.feature] = row.n
    idf = np.log((1 + total) / (1 + frequency)) + 1e-3

    def through(basis: np.ndarray) -> np.ndarray:
        """A'(A basis) over all passages."""
        out = np.zeros(basis.shape, np.float32)
        parts = terms.mapInArrow(_sketched(idf, basis), _PARTIAL_DDL).groupBy("block").applyInArrow(_added, _PARTIAL_DDL)
        for row in parts.toLocalIterator():
            out[row.block * _ROWS + np.frombuffer(row["rows"], "<u2").astype(np.int64)] = np.frombuffer(row["values"], np.float32).reshape(-1, basis.shape[1])
        return out

    # single precision and no full QR: the driver holds two or three tables of FEATURES x SKETCH
    basis = _orthonormal(through(np.random.default_rng(seed).standard_normal((FEATURES, SKETCH), np.float32)))
    release_shuffles(spark)
    after = through(basis)
    release_shuffles(spark)
    _, rotation = np.linalg.eigh(basis.T.astype(np.float64) @ after)
    latent = basis @ rotation[:, ::-1][:, COMMON : COMMON + RANK].astype(np.float32)
    return Space(latent * idf[:, None].astype(np.float32))


def _orthonormal(y: np.ndarray) -> np.ndarray:
    """The same span with orthonormal columns; directions that vanish become zero."""
    values, vectors = np.linalg.eigh(y.T.astype(np.float64) @ y)
    scale = np.where(values > 1e-10 * max(values[-1], 1e-30), 1 / np.sqrt(np.maximum(values, 1e-30)), 0)
    return y @ (vectors * scale).astype(np.float32)


def common_subsequence(item: dict, words: list, length: int) -> tuple[int, int, int]:
    """Length of the longest common subsequence (bit-parallel), and the span of words it ends and begins near.

    ``item`` has the bits of each of its words' places.
    """
    return _ordered([(place, bits) for place, word in enumerate(words) if (bits := item.get(word)) is not None], length)


def _ordered(hits: list[tuple[int, int]], length: int) -> tuple[int, int, int]:
    """The same of the words that the item has: their places and bits."""
    full = (1 << length) - 1
    state, best, begin, end = full, 0, 0, 0
    for place, bits in hits:
        u = state & bits
        state = ((state + u) | (state - u)) & full
        reached = length - state.bit_count()
        if reached > best:
            best, end = reached, place + 1
            if best == 1:
                begin = place
    return best, begin, end


@dataclass
class Item:
    """A benchmark item as its words: the whole text, and the answer at its end."""

    item_id: int
    words: list[int]
    answer: list[int]

    def __post_init__(self) -> None:
        self.bits, self.answer_bits = _places(self.words), _places(self.answer)


def _places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def answer_of(text: str) -> str:
    """What follows the last question mark, else the last sentence."""
    _, mark, rest = text.rpartition("?")
    if mark and rest.strip():
        return rest
    parts = [p for p in text.replace("\n", " ").split(". ") if p.strip()]
    return parts[-1] if parts else ""


def read_items(rows: list) -> list[Item]:
    out = []
    for item_id, text in rows:
        if text and item_id is not None:
            words = Words([text.encode()], marks=True).hashes.tolist()
            if words:
                out.append(Item(item_id, words, Words([answer_of(text).encode()], marks=True).hashes.tolist()))
    return out


class Search:
    """Windows of texts against benchmark items."""

    def __init__(self, space: Space, items: list[Item], cosine: float) -> None:
        self.space, self.items, self.cosine = space, items, cosine
        self.table = np.concatenate([space.vectors, np.zeros_like(space.vectors[:1])])
        groups: dict[int, list[tuple[int, np.ndarray]]] = {}
        for number, item in enumerate(items):
            words = np.array(item.words, U64)
            longest = LENGTHS[-1] * BLOCK
            for at in range(0, max(1, len(words) - longest // 2), longest // 2):
                piece = words[at : at + longest]
                vector = space.embed((piece & U64(FEATURES - 1)).astype(np.int64))
                length = min(LENGTHS, key=lambda m: (abs(m * BLOCK - len(piece)), m))
                norm = float(np.linalg.norm(vector))
                if norm:
                    groups.setdefault(length, []).append((number, vector / norm))
        self.groups = {m: (np.array([n for n, _ in g]), np.array([v for _, v in g], np.float32).T.copy()) for m, g in groups.items()}

    def _block_sums(self, features: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sum of the vectors of each block, up to BLOCK words from its start on: one word of some blocks at a time."""
        # a row of zeros stands for the words that a text's last block lacks
        table, last = self.table, len(features) - 1
        out = np.empty((len(starts), table.shape[1]), table.dtype)
        for low in range(0, len(starts), BLOCKS):
            begin, size = starts[low : low + BLOCKS], sizes[low : low + BLOCKS]
            total = out[low : low + BLOCKS]
            total[:] = 0
            word = np.empty_like(total)
            for k in (*range(1, BLOCK), 0):
                feature = np.where(size > k, features[np.minimum(begin + k, last)], len(table) - 1)
                total += np.take(table, feature, axis=0, out=word, mode="clip")
        return out

    def _windows(self, sums: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each length of the items, the sums of so many blocks from each block on, as far as there are so many."""
        known = {1: sums}
        for m in LENGTHS:
            # the two longest sums known that make this one
            a = max(k for k in known if k < m)
            known[m] = known[a][: max(0, len(sums) - m + 1)] + known[m - a][a:]
            if m in self.groups:
                yield m, known[m]

    def close(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, word after the last) of runs of windows close to an item."""
        sizes = np.diff(words.first)
        blocks = -(-sizes // BLOCK)
        if not blocks.sum():
            return
        base = np.cumsum(blocks) - blocks
        owner = np.repeat(np.arange(len(sizes)), blocks)
        place = np.arange(len(owner)) - base[owner]
        starts = words.first[:-1][owner] + place * BLOCK
        sums = self._block_sums(_features(words), starts, np.minimum(BLOCK, sizes[owner] - place * BLOCK))
        left = blocks[owner] - place
        found: list[np.ndarray] = []
        for m, windows in self._windows(sums):
            numbers, vectors = self.groups[m]
            # windows that go on into the next text are dropped, but those of texts shorter than a window end with them
            inside = left[: len(windows)] >= m
            short = np.flatnonzero((left < m) & (place == 0))
            ends = np.array([sums[i : i + left[i]].sum(axis=0) for i in short], np.float32).reshape(-1, sums.shape[1])
            for first, x in ((None, windows), (short, ends)):
                for at in range(0, len(x), 4096):
                    some = x[at : at + 4096]
                    some = some / np.maximum(np.sqrt(np.einsum("ij,ij->i", some, some)), 1e-9)[:, None]
                    hits = np.flatnonzero((some @ vectors >= self.cosine).ravel())
                    if len(hits):
                        b, v = at + hits // len(numbers), hits % len(numbers)
                        if first is None:
                            b, v = b[inside[b]], v[inside[b]]
                        else:
                            b = first[b]
                        found.append(np.stack([owner[b], numbers[v], place[b] * BLOCK, np.minimum(place[b] + m, blocks[owner[b]]) * BLOCK]))
        if found:
            rows = np.concatenate(found, axis=1).T
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))].tolist()
            current = rows[0]
            for row in rows[1:]:
                if row[:2] == current[:2] and row[2] <= current[3]:
                    current[3] = max(current[3], row[3])
                else:
                    yield tuple(current)
                    current = row
            yield tuple(current)

    def confirmed(self, words: Words) -> Iterator[tuple[int, int, float, float, int, int]]:
        """(text, item id, share of its words, share of its answer, first word, word after the last)."""
        best: dict[tuple[int, int], tuple] = {}
        for text, number, begin, end in self.close(words):
            item = self.items[number]
            a, b = words.first[text], words.first[text + 1]
            margin = BLOCK + len(item.words) // 2
            low, high = max(a, a + begin - margin), min(b, a + end + margin)
            near = words.hashes[low:high].tolist()
            own_bits = list(map(item.bits.get, near))
            length = len(item.words)
            # no more words are in order than are there
            if (len(near) - own_bits.count(None)) / length < LCS_WITH_ANSWER:
                continue
            hits = [(i, bits) for i, bits in enumerate(own_bits) if bits is not None]
            places = [i for i, _ in hits]
            # a run may be any number of windows: words count together only within twice the item's length
            size, step = 2 * length, -(-length // 2)
            for at in range(0, max(1, len(near) - size + step), step):
                own = hits[bisect_left(places, at) : bisect_left(places, at + size)]
                if len(own) / length < LCS_WITH_ANSWER:
                    continue
                n, first, last = _ordered(own, length)
                share = n / length
                if share < LCS_WITH_ANSWER:
                    continue
                some = near[at : at + size]
                answer = common_subsequence(item.answer_bits, some, len(item.answer))[0] / len(item.answer) if item.answer else 0.0
                if share >= LCS or answer >= ANSWER:
                    key, row = (text, number), (share, answer, int(low - a) + first, int(low - a) + last)
                    best[key] = max(best.get(key, row), row)
        for (text, number), row in best.items():
            yield text, self.items[number].item_id, *row


_MATCH = [("item_id", pa.int64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]


def matches(
    docs: DataFrame, benchmark: DataFrame, space: Space | None = None, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", cosine: float = COSINE,
) -> DataFrame:
    """Documents that hold benchmark items, perhaps reworded: a row per document row and item.

    ``lcs_share`` is the share of the item's words found in order, ``answer_share`` that of its
    answer (after the last question mark, else the last sentence); ``first_word`` and ``last_word``
    say where. Case and ASCII marks don't count. Null and empty texts hold and are nothing; items
    without an id are ignored; repeated rows are judged each; empty tables give no rows; other columns are ignored.
    The benchmark is the stated query set, held against all windows of all documents in blocks.
    """
    spark = prepared(docs.sparkSession)
    own = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("binary").alias("text"))
    space = space or fit(own)
    queries = benchmark.select(benchmark[item_column].cast("bigint").alias("i"), benchmark[item_text_column].cast("string").alias("t")).distinct()
    n_blocks = max(1, -(-queries.count() // ITEMS))
    shared = spark.sparkContext.broadcast(space.vectors)
    out = None
    for block in range(n_blocks):
        # about ITEMS items
        items = spark.sparkContext.broadcast(read_items([tuple(r) for r in queries.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == block).orderBy("i", "t").collect()]))

        def found(batches, items=items) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc_id", pa.int64()), *_MATCH])
            search = Search(Space(shared.value), items.value, cosine)
            for part in batches:
                ids, rows = part.column(0).to_pylist(), []
                for first, group in chunks([t or b"" for t in payloads(part.column(1))]):
                    rows += [(ids[first + text], *rest) for text, *rest in search.confirmed(Words(group, marks=True))]
                if rows:
                    yield batch(schema, list(zip(*rows, strict=True)))

        new = own.mapInArrow(found, "doc_id bigint, item_id bigint, lcs_share double, answer_share double, first_word bigint, last_word bigint")
        out = new if out is None else out.union(new)
    return out.withColumnRenamed("doc_id", id_column)
