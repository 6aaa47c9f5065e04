"""Removal of repeated multi-line chunks, with DataFrame functions only.

A text's lines are cut into chunks where a rolling hash over the last lines says so, so that equal
passages are cut alike wherever they stand. Of every chunk of several lines that occurs more than
once anywhere, the first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from controlweave.llm.tables import prepared, with_maybe, written

#: On average, every so many lines a chunk ends.
LINES = 3
#: Chunks of fewer lines stay, however often they occur.
LEAST_LINES = 2

def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is evaluated once.

    A column used several times would be copied into each place when Spark merges projections.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def _chunks(lines: int) -> str:
    """SQL for the chunks of ``text``: (start line, lines, text) of each.

    A chunk ends after a line if the hash over it and the line before is divisible by ``lines``.
    """
    hashes = "transform(_l, x -> cast(conv(substr(md5(x), 1, 8), 16, 10) AS bigint))"
    ends = f"filter(sequence(1, size(_l)), i -> i = size(_l) OR pmod(_h[i - 1] + 31 * CASE WHEN i > 1 THEN _h[i - 2] ELSE 0 END, {lines}) = 0)"
    start = "CASE WHEN k = 0 THEN 0 ELSE _e[k - 1] END"
    chunk = _let("_s", start, "struct(_s AS start, e - _s AS n, array_join(slice(_l, _s + 1, e - _s), '\n') AS text)")
    return _let("_l", "split(text, '\n', -1)", _let("_h", hashes, _let("_e", ends, f"transform(_e, (e, k) -> {chunk})")))


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lines: int = LINES, least_lines: int = LEAST_LINES,
) -> DataFrame:
    """The rows with their text less all repeated chunks, and what was removed.

    Adds ``n_lines`` (before), ``removed_chunks`` and ``removed_lines``; all other columns stay,
    whatever their names. The first occurrence, by id and line, stays; the bytes of chunks with equal
    hashes are compared. Null texts stay null with 0 lines, an empty text is one empty line; null
    ids come first. Rows that repeat an id and its text are cut alike; an empty table gives no rows.

    Only documents that may hold a repeated chunk are shuffled with their texts, told by a table of
    fixed size; the others pass by. All joins sort and merge, so that plans are alike at every size.
    """
    prepared(docs.sparkSession)
    others = [c for c in docs.columns if c != text_column]
    rows = docs.select(
        F.struct(docs[id_column].cast("bigint").alias("id"), F.xxhash64(docs[text_column]).alias("h")).alias("key"),
        docs[text_column].cast("string").alias("text"),
        F.struct(*[docs[c] for c in others]).alias("others"),
    )
    repeatable = F.col("c.n") >= least_lines

    # 1. hashes that occur more than once, without texts
    every = rows.select("key", F.explode_outer(F.expr(_chunks(lines))).alias("c")).where(repeatable)
    marks = written(every.select("key", F.col("c.start").alias("start"), F.xxhash64("c.text").alias("mark"), F.length("c.text").alias("size")), "chunk-hashes")
    repeated = marks.groupBy("mark", "size").agg(F.count("*").alias("times")).where("times > 1").select("mark", "size")
    candidates = written(marks.join(repeated.hint("merge"), ["mark", "size"], "left_semi").select("key", "start"), "chunk-candidates")

    # 2. texts of those chunks, compared byte by byte; the first occurrence of each stays
    flagged = with_maybe(rows, "key", candidates)
    wanted = candidates.groupBy("key").agg(F.collect_set("start").alias("wanted"))
    holding = flagged.where("maybe").select("key", "text").join(wanted.hint("merge"), "key")
    occurring = holding.select("key", F.explode_outer(F.expr(f"filter({_chunks(lines)}, c -> array_contains(wanted, c.start))")).alias("c"))
    occurrences = written(occurring.select("key", F.col("c.start").alias("start"), F.col("c.text").alias("chunk")).distinct(), "chunk-texts")
    firsts = occurrences.groupBy("chunk").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("times")).where("times > 1").select("chunk", "first")
    # a chunk that very many documents hold is one hot key of this join, which adaptive execution splits
    later = occurrences.join(firsts.hint("merge"), "chunk").where(F.struct("key", "start") != F.col("first"))
    removed = written(later.groupBy("key").agg(F.collect_set("start").alias("removed")), "chunks-removed")

    # 3. texts without them
    touched = flagged.where("maybe").join(removed.hint("merge"), "key", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    gone = _let("g", "filter(c, x -> array_contains(removed, x.start))", "struct(size(g) AS removed_chunks, aggregate(g, 0, (t, x) -> t + x.n) AS removed_lines)")
    kept = "array_join(transform(filter(c, x -> NOT array_contains(removed, x.start)), x -> x.text), '\n')"
    whole = f"struct(aggregate(c, 0, (t, x) -> t + x.n) AS n_lines, {gone} AS gone, {kept} AS kept)"
    cut = touched.select("others", F.explode_outer(F.expr(f"transform(array({_chunks(lines)}), c -> {whole})")).alias("r"))
    cleaned = cut.select("others", "r.n_lines", "r.gone.removed_chunks", "r.gone.removed_lines", F.col("r.kept").alias("text"))
    zero = F.lit(0)
    passing = flagged.where("NOT maybe").select("others", F.coalesce(F.size(F.split("text", "\n", -1)), zero).alias("n_lines"), zero.alias("removed_chunks"), zero.alias("removed_lines"), "text")
    out = cleaned.unionByName(passing)
    added = ["n_lines", "removed_chunks", "removed_lines"]
    columns = [F.col("text").alias(c) if c == text_column else F.col(f"others.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns, *[F.when(F.col("text").isNull(), 0).otherwise(F.col(c)).alias(c) for c in added])
