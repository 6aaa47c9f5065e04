"""Token ids in flat binary files with 64-bit document offsets.

A data set is a folder with shards ``<name>.bin`` (the ids, flat, as unsigned 16- or 32-bit
little-endian integers), ``<name>.len`` and ``<name>.key`` (counts and ids of the
documents, from which the index is made) and ``<name>.idx``::

    8 bytes   CWTOKIDX
    u64       format version (1)
    u64       bytes of an id (2 or 4)
    u64       documents in the shard, n
    u64       ids in all shards before this one (the base)
    n x i64   document ids, ascending (the smallest 64-bit integer stands for null)
    n+1 x u64 offsets: ids in the data set before each document, and before the next shard

Shards follow one another by their first document. Readers map both files into memory.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from controlweave.llm.tables import batch, decoded, filesystem, partitions, prepared, written
from controlweave.session import fresh_folder

MAGIC = b"CWTOKIDX"
VERSION = 1
NULL_ID = -(1 << 63)
#: Words whose ids a worker remembers.
CACHED_WORDS = 400_000
#: Words given to the tokenizer as one text, and the mark between them.
JOINED, MARK = 200, "|"
GROUP_BYTES = 6 << 20
_SHARDS = "shard string, place int, first_id bigint, n_docs bigint, n_ids bigint"
#: Rows of one document id that a single task may hold.
REPEATED = 100_000
_READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
_READ_IDS = "doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>"


class WordTokenizer:
    """Ids of whole texts from a tokenizer that drops white space and never crosses it.

    Each distinct white-space separated word is encoded once and remembered, as neither the
    normalizer nor the split pattern joins characters across ASCII white space. Texts that hold an
    added token are read whole by the tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.specials = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"\A(?!)")
        mark = self.tokenizer.encode(f"a {MARK} a", add_special_tokens=False).ids
        #: The id of the mark, if it has one of its own.
        self.mark = mark[1] if len(mark) == 3 else None
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.flat, self.begins, self.sizes = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        out = self._by_words(texts)
        if self.specials:
            whole = pc.match_substring_regex(texts, self.special.pattern)
            for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
                out[i] = np.asarray(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return out

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        # a comma or full stop after a letter is a match of its own, so it may stand apart
        spread = pc.replace_substring_regex(texts, r"([A-Za-z])([.,])(\s)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(spread)
        flat = split.flatten()
        # case makes no difference in ASCII words (in others it may, before characters are composed)
        foldable = pc.and_not(pc.string_is_ascii(flat), pc.match_substring(flat, "<"))
        coded = pc.if_else(foldable, pc.ascii_lower(flat), flat).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.number) > self.limit:
            self._forget()
        self._learn([w for w in words if w not in self.number])
        known = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        codes = known[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.sizes[codes]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.begins[codes] - ends + n, n) + np.arange(n.sum())]
        cuts = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Encode new words: many joined by a mark that none of them holds, as a call costs more than a word."""
        plain = [w for w in words if MARK not in w and not self.special.search(w)] if self.mark is not None else []
        joined = [f" {MARK} ".join(plain[i : i + JOINED]) for i in range(0, len(plain), JOINED)]
        encode = lambda some: self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
        ids = np.array([i for got in encode(joined) for i in (*got.ids, self.mark)], np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(plain):
            # some word gives the mark itself: one by one, then
            plain, ids, marks = [], ids[:0], marks[:0]
        known = set(plain)
        other = [w for w in words if w not in known]
        rest = [got.ids for got in encode(other)]
        sizes = np.concatenate([np.diff(marks, prepend=-1) - 1, np.fromiter(map(len, rest), np.int64, len(rest))])
        new = np.concatenate([ids[ids != self.mark] if len(ids) else ids, np.array([i for r in rest for i in r], np.uint32)])
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, new])
        self.number.update(zip([*plain, *other], range(len(self.number), len(self.number) + len(words)), strict=True))


@lru_cache(maxsize=1)
def _loaded(path: str, stamp: tuple[int, int]) -> WordTokenizer:
    return WordTokenizer(path)


def word_tokenizer(path: str) -> WordTokenizer:
    """The process's tokenizer of this file: later tasks of a worker need not load it and learn its words again."""
    stat = os.stat(path)
    return _loaded(path, (stat.st_mtime_ns, stat.st_size))


def _texts(column: pa.Array) -> pa.Array:
    """UTF-8 bytes as text; null is empty, broken sequences become U+FFFD."""
    try:
        return column.cast(pa.large_string()).fill_null("")
    except pa.ArrowInvalid:
        return pa.array([decoded(t) for t in column.to_pylist()], pa.large_string())


def _groups(batches) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of several batches, about GROUP_BYTES of text together."""
    keys, texts, size = [], [], 0
    for part in batches:
        keys.append(part.column(0))
        texts.append(_texts(part.column(1)))
        size += texts[-1].nbytes
        if size >= GROUP_BYTES:
            yield pa.concat_arrays(keys), pa.concat_arrays(texts)
            keys, texts, size = [], [], 0
    if keys:
        yield pa.concat_arrays(keys), pa.concat_arrays(texts)


def write_ids(
    docs: DataFrame, tokenizer_path: str, end_id: int | None = None, folder: str | None = None, wide: bool | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Tokenize every whole text and store the ids in ascending order of the document ids.

    Result: the shards (``shard`` path without suffix, ``place`` among the shards, ``first_id``, ``n_docs``, ``n_ids``,
    ``base``); only shards listed there belong to the data set, files of lost attempts don't.
    ``end_id`` is appended to each document. Ids take 2 bytes if the vocabulary allows, else 4.
    Null and empty texts hold the end id only; repeated document ids are kept, ordered by their
    texts (ids with more than ``REPEATED`` rows by the CRC-32 of their texts first, so that they spread over shards); null document ids
    come first. An empty table gives no shards. Other columns are ignored whatever their names. One shuffle of the texts, by
    ranges of the document id.
    """
    spark = prepared(docs.sparkSession)
    folder = folder or fresh_folder(spark, "token-files")
    size = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    width = 4 if (wide if wide is not None else max(size, (end_id or 0) + 1) > 1 << 16) else 2
    key = docs[id_column].cast("bigint").alias("doc_id")
    rows = docs.select(key, docs[text_column].cast("binary").alias("text"))
    # at most one id per REPEATED rows
    hot = [r.doc_id for r in rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > REPEATED).collect()]
    place = [F.col("doc_id")]
    if hot:
        often = F.col("doc_id").isin([i for i in hot if i is not None]) | (F.col("doc_id").isNull() if None in hot else F.lit(False))
        place.append(F.when(often, F.crc32("text")))
    ordered = rows.repartitionByRange(partitions(spark), *place).sortWithinPartitions(*place, "text")

    def store(batches) -> Iterator[pa.RecordBatch]:
        tokenizer, store, place = word_tokenizer(tokenizer_path), *filesystem(folder)
        name, first, n_docs, n_ids = f"{place}/{uuid.uuid4().hex}", None, 0, 0
        out = lengths = keys = None
        for column, texts in _groups(batches):
            if out is None:
                store.create_dir(place, recursive=True)
                out, lengths, keys = (store.open_output_stream(f"{name}.{x}") for x in ("bin", "len", "key"))
                first = column[0].as_py()
            tail = [] if end_id is None else [np.array([end_id])]
            coded = tokenizer.encode(texts)
            out.write(np.concatenate([x for ids in coded for x in (ids, *tail)]).astype(f"<u{width}").tobytes())
            counts = np.fromiter(map(len, coded), np.int64, len(coded)) + len(tail)
            lengths.write(counts.astype("<u8").tobytes())
            keys.write(column.fill_null(NULL_ID).to_numpy().astype("<i8").tobytes())
            n_ids, n_docs = n_ids + int(counts.sum()), n_docs + len(texts)
        if out is not None:
            for stream in (out, lengths, keys):
                stream.close()
            schema = pa.schema([("shard", pa.string()), ("place", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
            uri = f"{folder}/{name.rsplit('/', 1)[1]}"
            # partitions are numbered in the order of their ranges
            yield batch(schema, [[uri], [TaskContext.get().partitionId()], [first], [n_docs], [n_ids]])

    shards = written(ordered.mapInArrow(store, _SHARDS), "token-shards")
    # one row per shard: the prefix sum of their sizes fits in one task
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return written(based.repartition(partitions(spark), "shard").mapInArrow(_index_writer(width), f"{_SHARDS}, base bigint"), "token-index")


def _index_writer(width: int) -> Callable:
    def write(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                store, name = filesystem(row["shard"])
                counts = np.frombuffer(store.open_input_file(f"{name}.len").read(), "<u8")
                keys = store.open_input_file(f"{name}.key").read()
                offsets = row["base"] + np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
                head = MAGIC + np.array([VERSION, width, row["n_docs"], row["base"]], "<u8").tobytes()
                with store.open_output_stream(f"{name}.idx") as out:
                    out.write(head + keys + offsets.astype("<u8").tobytes())
            yield part

    return write


def mapped(uri: str, suffix: str) -> np.ndarray:
    """A shard file's bytes: memory-mapped where it is a local path, else read."""
    store, name = filesystem(uri)
    if store.type_name == "local":
        path = f"{name}.{suffix}"
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8)
    return np.frombuffer(store.open_input_file(f"{name}.{suffix}").read(), np.uint8)


class Shard:
    """One shard, opened through its index."""

    def __init__(self, uri: str) -> None:
        index = mapped(uri, "idx")
        if index[:8].tobytes() != MAGIC:
            raise ValueError(f"{uri}.idx is not a token index")
        version, width, n, self.base = (int(x) for x in index[8:40].view("<u8"))
        if version != VERSION:
            raise ValueError(f"{uri}.idx has version {version}")
        self.doc_ids = index[40 : 40 + 8 * n].view("<i8")
        self.offsets = index[40 + 8 * n : 48 + 16 * n].view("<u8").astype(np.int64)
        self.ids = mapped(uri, "bin").view(f"<u{width}")
        if len(self.ids) != self.offsets[-1] - self.base:
            raise ValueError(f"{uri}.bin does not hold the ids its index promises")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] - self.base : self.offsets[i + 1] - self.base]


def read_ids(shards: DataFrame, digests_only: bool = False) -> DataFrame:
    """One row per document of the listed shards: ``doc_id``, ``start`` (ids before it),
    ``n_tokens`` and ``ids``, or with ``digests_only`` instead of them ``ids_crc32`` (CRC-32 of the
    ids as little-endian unsigned 32-bit integers)."""

    def read(batches) -> Iterator[pa.RecordBatch]:
        last = ("ids_crc32", pa.int64()) if digests_only else ("ids", pa.list_(pa.int64()))
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])
        for part in batches:
            for uri in part.column(0).to_pylist():
                shard = Shard(uri)
                for at in range(0, len(shard), 256):
                    span = range(at, min(at + 256, len(shard)))
                    keys = [None if k == NULL_ID else int(k) for k in shard.doc_ids[span.start : span.stop]]
                    starts = shard.offsets[span.start : span.stop]
                    values = [zlib.crc32(shard[i].astype("<u4").tobytes()) if digests_only else shard[i].astype(np.int64) for i in span]
                    yield batch(schema, [keys, starts, np.diff(shard.offsets[span.start : span.stop + 1]), values])

    n = partitions(prepared(shards.sparkSession))
    return shards.select("shard").repartition(n, "shard").mapInArrow(read, _READ if digests_only else _READ_IDS)
