"""A corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept.  All but the
last return the columns of ``documents``; other columns that docs may have pass through as well.
Missing values, empty tables and repeated rows follow the operators' docstrings.

A stage's result is written before the next stage begins, so a stage removes the intermediate tables of
the stage before it (never those that its own docs still read from).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language, ngram_join, packing, substrings
from tidemark.llm.queries import BYTE_BPE
from tidemark.llm.shared import drop_staged, recorded, staged, table

#: Words of a near-duplicate shingle, and the least similarity in percent.
SHINGLE, SIMILAR = 5, 80
#: Words of a passage that may stand in one document only.
PASSAGE = 50
#: Least probability of the predicted language.
SURE = 0.5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Intermediate tables of the stage that ran last.
_LEFT: list[str] = []


def _stage(function: Stage) -> Stage:
    """Remove what the stage before has left behind, and note what this one stages."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_staged(spark, _LEFT, docs)
        with recorded() as own:
            result = function(spark, docs, sf_dir)
        _LEFT.extend(own)
        return result

    return run_stage


@_stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep rows whose language is told from the text with a score of ``SURE``; no letter or no text means rejected."""
    others = [c for c in docs.columns if c != "text"]
    marked = docs.select(F.struct(*others).alias("_row"), "text")
    labelled = language.predict(marked, language.fit(docs), key="_row", with_text=True)
    kept = labelled.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_row.{c}") for c in docs.columns])


@_stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest doc_id of each group of near duplicates."""
    others = [c for c in docs.columns if c != "text"]
    missing = F.col("text").isNull().alias("_missing")
    grouped = ngram_join.linked_groups(docs.select("*", missing), SHINGLE, SIMILAR, carry=[*others, "_missing"])
    text = F.when(~F.col("carry._missing"), F.col("text"))
    return grouped.filter("first").select(*[text.alias(c) if c == "text" else F.col(f"carry.{c}") for c in docs.columns])


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller doc_id has too; texts that lose nothing stay as they are."""
    cut = substrings.remove_repeated(docs, PASSAGE, carry=[c for c in docs.columns if c != "text"])
    lost = F.col("n_removed") > 0
    texts = cut.select("carry", F.when(lost, F.col("kept")).otherwise(F.col("text")).alias("text"), lost.alias("lost"))
    columns = {c: F.col("text") if c == "text" else F.col(f"carry.{c}") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("lost"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return texts.select(*[value.alias(c) for c, value in columns.items()])


@_stage
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold a benchmark item; other rows with the same doc_id, or also without one, stay."""
    rows = decontamination.numbered(docs)
    found = decontamination.found_rows(rows.select("row", "carry.text"), table(spark, sf_dir, "benchmark"))
    leaked = staged(found.select("row").distinct(), "leaked")
    return rows.join(leaked, "row", "left_anti").select("carry.*")


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, every source at its share."""
    pieces = packing.pack(docs, BYTE_BPE, length=1024)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("benchmark_decontamination", without_leaks),
    ("packing", packed),
]

# A trained network and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with recorded() as own:
            docs = staged(stage(spark, docs, sf_dir), name)
        # The stage before has nothing left to be read from.
        drop_staged(spark, done, docs)
        done = own[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
