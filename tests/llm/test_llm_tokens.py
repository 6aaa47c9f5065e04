import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_cases import ODD, frame
from tokenizers import Tokenizer

from controlweave.llm import byte_bpe, token_files
from controlweave.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECES = ["a", "Bc", "THE", " ", "  ", "\n", "1", "23", "'s", "'LL", "'", "é", "É", "H̱", "́", "漢字", "...", ", ", ".", "\t", "　", "\x1c", "don't", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ"]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_words_encode_as_whole_texts():
    tokenizer, mine = Tokenizer.from_file(WORDS), token_files.WordTokenizer(WORDS, limit=50)
    texts = random_texts(1500, 1)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], mine.encode(texts[at : at + 100]), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_later_tasks_of_a_worker_know_the_words(spark, tmp_path):
    """Words learned by one task are not encoded again by the next; another file under the same name is read anew."""
    path = tmp_path / "words.json"
    path.write_bytes(open(WORDS, "rb").read())
    mine = token_files.word_tokenizer(str(path))
    before = mine.encode(["some words, learned once"])[0].tolist()
    learned = []
    mine._learn = learned.extend
    again = token_files.word_tokenizer(str(path))
    assert again.encode(["once learned some words"])[0].tolist() == Tokenizer.from_file(WORDS).encode("once learned some words").ids and not learned
    path.write_bytes(open(WORDS, "rb").read() + b"\n")
    fresh = token_files.word_tokenizer(str(path))
    assert fresh is not mine and fresh.encode(["some words, learned once"])[0].tolist() == before


def test_pieces_encode_as_whole_texts(plain):
    codec = byte_bpe.Codec(RANKS, PATTERN, piece=20)
    for text in random_texts(1500, 2):
        assert codec.encode(text) == plain.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_long_texts_without_boundaries(plain):
    codec = byte_bpe.Codec(RANKS, PATTERN)
    for text in (" " * 150_000 + "a", "a" + " " * 120_000, "x " * 60_000 + "\n" * 70_000 + "y", "ab" * 100_000):
        assert codec.encode(text) == plain.encode_ordinary(text)
    assert codec.decode(codec.encode("a" + " " * 3_000_000)) == b"a" + b" " * 3_000_000  # too long for the library itself


def test_byte_bpe_odd_rows(spark, plain):
    got = byte_bpe.encode_texts(frame(spark, ODD), RANKS, PATTERN).collect()
    want = sorted((str(d), plain.encode_ordinary(t or "")) for d, t in ODD)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()
    assert byte_bpe.encode_texts(frame(spark, []), RANKS, PATTERN).count() == 0


def test_token_files_odd_rows(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for wide in (False, True):
        shards = token_files.write_ids(frame(spark, ODD), WORDS, end_id=2, wide=wide)
        got = sorted(token_files.read_ids(shards).collect(), key=lambda r: r.start)
        want = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in ordered]
        assert [(r.doc_id, r.ids) for r in got] == want
        assert [r.start for r in got] == np.cumsum([0] + [len(i) for _, i in want])[:-1].tolist()
    assert token_files.read_ids(token_files.write_ids(frame(spark, []), WORDS)).count() == 0


def test_repeated_ids_across_shards(spark, monkeypatch):
    """One id with most rows goes to several shards, in the order of its texts' checksums."""
    monkeypatch.setattr(token_files, "REPEATED", 20)
    tokenizer = Tokenizer.from_file(WORDS)
    rows = [(i % 7, f"text {i}") for i in range(60)] + [(7, f"often {i * i}") for i in range(90)] + [(None, f"none {i}") for i in range(30)] + [(9, "last")]
    shards = token_files.write_ids(frame(spark, rows), WORDS, end_id=2)
    assert shards.where("first_id = 7").count() > 1
    hot = {7, None}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()) if r[0] in hot else 0, r[1].encode()))
    got = sorted(token_files.read_ids(shards).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.ids) for r in got] == [(d, tokenizer.encode(t, add_special_tokens=False).ids + [2]) for d, t in ordered]


def test_marks_in_words_and_tokenizers_without_the_mark():
    tokenizer = Tokenizer.from_file(WORDS)
    for mark in (token_files.WordTokenizer(WORDS).mark, None, tokenizer.encode("two", add_special_tokens=False).ids[0]):
        mine = token_files.WordTokenizer(WORDS)
        mine.mark = mark  # the last is an id that words give, too
        for text in ("one two 3 four's", "é", "a|b | || two |", " ".join(f"w{i}|{i}" for i in range(500))):
            assert mine.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_broken_bytes_are_replaced(spark):
    broken = spark.createDataFrame([(1, bytearray(b"a\xffb")), (2, bytearray(b"fine"))], "doc_id bigint, text binary")
    tokenizer = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r.ids for r in token_files.read_ids(token_files.write_ids(broken, WORDS)).collect()}
    assert got == {1: tokenizer.encode("a\ufffdb", add_special_tokens=False).ids, 2: tokenizer.encode("fine", add_special_tokens=False).ids}


def test_a_shard_that_lost_ids_is_refused(spark, tmp_path):
    shards = token_files.write_ids(frame(spark, [(1, "some text")]), WORDS, end_id=2, folder=str(tmp_path / "ids"))
    path = shards.first().shard
    open(f"{path}.bin", "ab").write(b"\0\0")
    with pytest.raises(ValueError, match="does not hold"):
        token_files.Shard(path)


def test_queries_against_the_libraries(spark, plain):
    sf_dir, tokenizer = "/root/testdata/sf0.001", Tokenizer.from_file(WORDS)
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    files = {r.doc_id: r for r in QUERIES["op4_token_files"].run(spark, sf_dir).collect()}
    bpe = {r.doc_id: r for r in QUERIES["op5_byte_bpe"].run(spark, sf_dir).collect()}
    start = 0
    for doc_id, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (files[doc_id].start, files[doc_id].n_tokens, files[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        ids = np.array(plain.encode_ordinary(text or ""), "<u4")
        assert (bpe[doc_id].n_tokens, bpe[doc_id].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert bpe[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert len(files) == len(bpe) == len(docs)
