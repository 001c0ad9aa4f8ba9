"""A corpus from raw documents to packed training bins: five stages, each written and read again.

Each stage works on all rows that the one before it kept, and all but the last return the columns of
``documents``. Rows are named by two hashes of doc_id and text, so that null and repeated ids do not
mix. A null or empty text fails the quality rules and leaves there; an empty table passes through
empty; extra columns go along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import decontam, lines, neardup, packing, quality
from stratakv.llm.common import column, freed, new_name, read, scratch, written

#: No SQL gives the decisions of a fitted field or of best-fit packing.
ORACLE_SQL = None


def _named(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with two more columns that name them, and the names of these columns."""
    names = [new_name(x, *docs.columns) for x in ("row_a", "row_b")]
    typed = docs.select("*", F.col("doc_id").cast("long").alias(i := new_name("id", *docs.columns, *names)), F.col("text").cast("string").alias(t := new_name("t", *docs.columns, *names)))
    return typed.withColumns(dict(zip(names, neardup.row_name(i, t), strict=True))).drop(i, t), names


def _columns(docs: DataFrame) -> list:
    return [column(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    prefix = "quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return quality.quality_rules(docs, model, prefix=prefix).where(F.col(f"{prefix}kept")).select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur, or nearly occur, earlier; those left without any words go."""
    no_text = new_name("no_text", *docs.columns)
    carried = docs.withColumn(no_text, F.col("text").isNull())
    result = lines.line_dedup(carried, carry=[c for c in carried.columns if c != "text"]).where("n_lines = 0 or n_lines > size(removed)")
    rest = lambda c: F.col("rest").getField(c)
    new = {"text": F.when(~rest(no_text), F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(rest("n_chars"))
    return result.select(*[(new[c] if c in new else rest(c)).alias(c) for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The earliest document of each group of near duplicates: five-word shingles, similarity 0.8 or more; null ids come last."""
    named, names = _named(docs)
    keepers = neardup.ngram_components(docs, shingle=5, num=80, den=100).where("keeper").select(*[F.col(c).alias(n) for c, n in zip(("key", "key2"), names, strict=True)])
    return named.join(keepers.distinct(), names, "left_semi").dropDuplicates(names).select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the documents that are left."""
    return packing.best_fit(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir`` to the packed bins."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):  # what a stage writes on its way goes once its result is written
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if before is not None:
            freed(before)
        before = docs
    return docs
