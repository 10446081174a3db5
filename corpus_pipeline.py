"""A training corpus out of `documents`: grade, drop near copies, decontaminate, take secrets out, mix the sources.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written
and read again as the next one's docs; all but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamark.llm import decontam, mixing, neardup, quality, secrets
from seamark.llm.common import Scratch, read, unused


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are probably of a grade above the lowest."""
    model = quality.train(docs, quality.grades_of(read(spark, sf_dir, "labels")), 3)
    own = unused(docs, "_grade")
    return quality.select_quality(docs, model, column=own).filter(F.col(own)["kept"]).select(*_names(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies (five words, 0.8).

    Rows with a null id name no document and all stay; of rows that repeat an id, those stay
    that have no smaller one in their group.
    """
    found = neardup.near_duplicates(spark, docs, shingle=5)
    own = unused(docs, "_gone")
    gone = found.filter("not kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(own), "left_anti").select(*_names(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more is benchmark text."""
    own = unused(docs, "_hits")
    found = decontam.contamination(docs, read(spark, sf_dir, "benchmark"), column=own)
    return found.filter(~F.col(own)["contaminated"]).select(*_names(docs))


def scrub_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes a mark over every secret, found by a rule or by the network; n_chars follows, if there is one."""
    own = unused(docs, "_secrets")
    spans = F.col(own)["all"]
    found = secrets.find_secrets(docs, secrets.train(docs), column=own)
    fresh = unused(found, "_clean")
    clean = found.withColumn(fresh, secrets.redact(F.col("text"), spans))
    changed = {"text": F.col(fresh)}
    if "n_chars" in docs.columns:
        length = F.char_length(fresh).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars"))
    return clean.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: size, source_size, target, taken; 0 leaves a document out."""
    _, report = mixing.mix(spark, docs)
    return report


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES = [("quality classifier", grade), ("near-duplicate removal", near_dedup), ("benchmark decontamination", decontaminate),
          ("secret scan", scrub_secrets), ("source mixing", mix)]

# The trained stages (grades, character network) have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
