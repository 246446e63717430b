"""The corpus pipeline: each stage applies one operator to all that its predecessor kept.

Stages get documents and give documents (their columns, with n_chars brought up to date where the text changed); the last
gives the packed pieces. Quality rules drop what they reject; line deduplication rewrites texts; near-deduplication keeps
the document with the least doc_id of each class; decontamination drops documents with a benchmark window.

Defined results: null, empty and wordless texts fail the quality rules, so only the first stage sees them in a run; later
stages given such rows keep them, as they are like one another (near-deduplication keeps the least doc_id of them) and hold
no window. Rows with a null doc_id are judged by quality rules and decontamination on their own text; line deduplication
counts them and keeps a line with them only if no other document holds it; near-deduplication can't tell them apart as
documents and keeps them. Rows that repeat a doc_id are one document for line and near-deduplication, and are judged row by
row elsewhere. Columns named like a result of an operator keep their own values. Texts of any length are read whole. Empty
tables give empty results of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindra.llm.common import Scratch, drop_scratch, kept_scratch, table
from kindra.llm.decontaminate import decontaminate
from kindra.llm.jaccard import jaccard_duplicates
from kindra.llm.line_dedup import dedup_lines
from kindra.llm.packing import pack
from kindra.llm.quality_rules import RESULTS, fit_line_field, quality_rules
from kindra.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Documents whose columns named like a result are renamed, and the new names."""
    names = {c: f"_own_{c}" for c in docs.columns if c in taken}
    return docs.withColumnsRenamed(names), names


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = fit_line_field(docs, table(spark, sf_dir, "labels"))
    rows, names = _aside(docs, RESULTS.names)
    return quality_rules(rows, field).where("kept").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows stay, also those whose every line is dropped: their text is empty then."""
    rows, names = _aside(docs, ["n_lines", "n_dropped", "kept_text", "kept_sha256", "_doc", "_marks"])
    rows = dedup_lines(rows, keep_text=True)
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.withColumns(changed).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links are five-word Jaccard similarity of 0.8 or more: those among the SimHash classes, and the rest."""
    gone = jaccard_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row goes by its doc_id and a hash of its text, so a row without doc_id goes too, and another text of a doc_id stays."""
    rows, names = _aside(docs, ["_text_hash", "_gone_id", "_gone_hash"])
    rows = rows.withColumn("_text_hash", F.xxhash64("text"))
    found = decontaminate(rows, table(spark, sf_dir, "benchmark"), columns=("doc_id", "_text_hash")).where("contaminated")
    gone = found.select(F.col("doc_id").alias("_gone_id"), F.col("_text_hash").alias("_gone_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_text_hash") == F.col("_gone_hash"))
    return rows.join(gone.hint("shuffle_hash"), same, "left_anti").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The field's verdicts, XXH64 fingerprints and the tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces. What a stage read, and its operator's scratch tables, go when its own output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        mark = kept_scratch()
        written = Scratch(stage(spark, docs, sf_dir), name)
        drop_scratch(mark)
        if before is not None:
            before.drop()
        docs, before = written.read(), written
    written.keep()
    return STAGES[-1][1](spark, docs, sf_dir)
