"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Toxic documents go; repeated passages of lines are cut, and documents of which nothing is left
go; of each group of near-duplicates the document with the smallest id stays; documents that hold
a benchmark item go; what remains is encoded. Each stage works on all its predecessor kept. Documents without an id
stay in every stage but for their text; rows that repeat an id share the decisions on it. Null and empty
texts are clean, keep their rows and are encoded as empty; an empty table gives an empty table.

What a stage writes on its way is removed when the next one begins, as its result is stored by then.
"""

from __future__ import annotations

import functools
import gc

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from controlweave.llm import byte_bpe, decontaminate, line_chunks, ngram_join, toxicity
from controlweave.llm.tables import collecting, prepared, remove, without, written
from controlweave.session import fresh_folder

_left: dict[str, list[str]] = {}


def stage(function):
    """A stage that first removes what the stage before it has left in the shared folder.

    Unless ``docs`` is that stage's result itself, not yet stored.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        left = _left.pop(application, [])
        if left and not any(folder.rsplit("/", 1)[-1] in file for file in docs.inputFiles() for folder in left):
            remove(spark, left)
            left = []
        gc.collect()  # frames no longer in use release their shuffle files
        with collecting() as folders:
            result = function(spark, docs, sf_dir)
        _left[application] = left + folders
        return result

    return run_stage


@stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, prepared(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


@stage
def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks of lines, ``n_chars`` with them; documents left blank go."""
    cut = line_chunks.remove_repeats(docs)
    kept = cut.where((F.col("removed_chunks") == 0) | F.col("text").rlike(r"\S"))
    n_chars = F.when(F.col("removed_chunks") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(docs.columns)


@stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.near_duplicate_groups(docs, ngram_join.Rule(n=5, percent=80))
    others = written(groups.where("doc_id <> component_id").select("doc_id"), "near-duplicates")
    return without(docs, "doc_id", others)


@stage
def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = prepared(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = written(decontaminate.matches(docs, benchmark).select("doc_id").distinct(), "leaks")
    return without(docs, "doc_id", leaks)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and the digests of ids and decoded bytes."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN, with_decoded=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("decontamination", reject_leaks),
    ("byte_bpe", encode),
]
#: The stages have no SQL form: a learned score, latent vectors, a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, apply in STAGES:
        path = fresh_folder(spark, f"pipeline-{name}")
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove(spark, before)
        before = [path]
    return docs
