"""The pipeline against plain versions of its stages."""

import base64

import numpy as np
import public_tokenizers
import tiktoken
from llm_cases import cut_lines, groups

import __spark_entry__
import corpus_pipeline
from controlweave.llm import toxicity

SF_DIR = "/root/testdata/sf0.001"


def test_pipeline_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    scores = [toxicity._score(model, n, h) for n, h in toxicity.Reader(model).hits([t or "" for _, t in rows])]
    rows = [r for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]
    rows = [(d, c[0]) for (d, _), c in zip(rows, cut_lines(rows), strict=True) if c[2] == 0 or c[0].strip()]
    least = groups(rows, 5, 80)
    rows = [r for i, r in enumerate(rows) if least[i] in (r[0], None)]
    clean = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split())
    items = [clean(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(i in clean(r[1]) for i in items)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == {d: encoding.encode_ordinary(t or "") for d, t in rows}


def test_stages_keep_odd_rows_and_columns(spark):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "some words of a text", "en", "a", 20), (3, "plain words", "en", "a", 11), (3, "plain words", "en", "a", 11)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, kinds)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.dtypes == spark.createDataFrame([], kinds).dtypes, name
        assert sorted(map(str, docs.collect())) == sorted(map(str, spark.createDataFrame(given, kinds).collect()))
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == len(given)


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
