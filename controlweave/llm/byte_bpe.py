"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from controlweave.llm.tables import batch, decoded, payloads, prepared

#: Code points given to the encoder in one call; longer texts are cut at safe boundaries.
PIECE = 50_000

#: Between a letter or digit and white space no match of the split pattern goes on: its
#: alternatives hold white space at their start or alone.
_BEFORE_SPACE = re.compile(r"[0-9A-Za-z.,](?=[ \n])")
#: Nor between an ASCII letter and a digit, either way round.
_BETWEEN = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
#: A whole run of white space, if long: the regex engine's stack doesn't hold such a match.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (lines of base64 bytes and rank), without special tokens."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` that the pattern splits as it would the whole.

    Cuts lie before white space that follows a letter, digit, full stop or comma, else between
    ASCII letters and digits. A stretch with neither stays in one piece.
    """
    start = 0
    while len(text) - start > size:
        for boundary in (_BEFORE_SPACE, _BETWEEN):
            found = boundary.search(text, start + size, min(len(text), start + 2 * size))
            if found:
                break
        else:
            found = _BEFORE_SPACE.search(text, start + 2 * size) or _BETWEEN.search(text, start + 2 * size)
            if not found:
                break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def _with_long_runs(text: str, codec: tiktoken.Encoding) -> list[int]:
    """Encode a piece that may hold long runs of white space.

    The pattern matches all of such a run but its last character, which goes to what follows;
    a run at the end of the text is one match.
    """
    out, start = [], 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += codec.encode_ordinary(text[start : run.start()])
        out += codec._encode_single_piece(text[run.start() : end])
        start = end
    return out + codec.encode_ordinary(text[start:])


class Codec:
    """Encodes texts of any length as the encoding does, and decodes ids to bytes."""

    def __init__(self, ranks_path: str, pattern: str, piece: int = PIECE) -> None:
        self.encoding, self.piece = encoding(ranks_path, pattern), piece

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.piece:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for piece in pieces(text, self.piece):
            out += _with_long_runs(piece, self.encoding)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes, which need not be whole UTF-8 when ids are cut anywhere."""
        return self.encoding.decode_bytes(ids)


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
    with_ids: bool = True, with_decoded: bool = True, piece: int = PIECE,
) -> DataFrame:
    """Ids of every whole text by the rank file, and the bytes they decode to.

    Result: the id column, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, unless left out,
    ``ids`` (little-endian unsigned 32-bit) and ``decoded`` (raw bytes). Null and empty texts give no
    ids and empty bytes. Repeated rows and null ids are kept, an empty table gives an empty result,
    other columns are ignored whatever their names. Invalid UTF-8 is read with U+FFFD in place of
    each broken sequence. Narrow: no shuffle.
    """
    prepared(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    extra = ["ids"] * with_ids + ["decoded"] * with_decoded
    schema = f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} binary" for c in extra)
    narrow = docs.select(docs[id_column], docs[text_column].cast("binary"))

    def encoded(batches):
        codec = Codec(ranks_path, pattern, piece)
        for part in batches:
            columns: dict[str, list] = {c: [] for c in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for data in payloads(part.column(1)):
                ids = codec.encode(decoded(data))
                packed, back = np.asarray(ids, "<u4").tobytes(), codec.decode(ids)
                columns["n_tokens"].append(len(ids))
                columns["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                columns["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                for name, value in (("ids", packed), ("decoded", back)):
                    if name in extra:
                        columns[name].append(value)
            types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), **dict.fromkeys(extra, pa.binary())}
            out = pa.schema([pa.field(id_column, part.schema.field(0).type), *types.items()])
            yield batch(out, [part.column(0), *(columns[c] for c in types)])

    return narrow.mapInArrow(encoded, schema)
