"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) and works on everything that its predecessor kept; all but
the last return the columns of ``documents``.  ``run`` applies them to the documents table, each stage
written as Parquet in the shared folder and read back as the next one's input.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontam import decontaminate
from tidemark.llm.langid import UNDETERMINED, identify, learn
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.ngram_join import one_of_each_group
from tidemark.llm.packing import pack
from tidemark.llm.tables import delete_scratch, recorded, staged

#: a text goes if no language holds this share of its words
MIN_SHARE = 0.35


#: scratch tables of the stage before, by application, thread and data
_left: dict[tuple, list[str]] = {}


def stage(f):
    """A stage begins after its predecessor's rows were written and read back, so what the predecessor of the same
    pipeline kept in the shared folder on the way can go."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        pipeline = (spark.sparkContext.applicationId, threading.get_ident(), sf_dir)
        delete_scratch(spark, _left.pop(pipeline, []))
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        _left[pipeline] = paths
        return out

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language; the others keep their rows, a NULL ``lang`` is filled in.  Without a
    labelled text there is nothing to tell languages by, and texts with a letter stay."""
    model = learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, model, id_col=None)
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated and nearly repeated lines; a text of which no word is left goes."""
    done = dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group (five words a shingle, similarity of 0.8 or more)."""
    return one_of_each_group(docs, size=5, num=80, den=100)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents with a verbatim window of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of the packed sequences: one row per piece of a document."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: no SQL: the language model and best-fit packing are iterative
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES:
        docs = staged(step(spark, docs, sf_dir), name)
    return docs
