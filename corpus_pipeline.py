"""The corpus pipeline: from `documents` to packed training windows.

Each stage takes (spark, docs, sf_dir) and calls one operator; what it returns is written as Parquet and read again as the
next one's `docs`. All but the last return the columns of `documents`. Stages need no state but `docs`:

1. quality rules: documents that base rules or the divergence from their language's reference reject go;
2. line dedup: lines that are similar to an earlier one go (five-word shingles, 0.8; lines of 1 to 4 words if an equal one
   came before); `n_chars` follows the text, and documents whose lines all went go with them;
3. n-gram Jaccard join: one document of each class of similar ones stays (five-word shingles, 0.8);
4. mixing: sources are replicated to their target weights and shuffled;
5. packing: windows of at most 1024 tokens.

As a stage's result is stored before the next stage begins, the next one deletes the intermediate tables that the stage
before has left in the shared folder.

Null texts and ids, repeated rows and empty tables are treated as the operators say: a null or empty text fails the quality
rules, and by themselves the later stages keep it; a null id ranks last; of repeated rows the Jaccard join keeps one;
mixing and packing take each row; an empty table stays empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unisift.llm.jaccard import one_of_each
from unisift.llm.lines import dedup_lines
from unisift.llm.mixing import mix
from unisift.llm.packing import pack
from unisift.llm.quality import keep_documents
from unisift.llm.queries import MIX_WEIGHTS, tokenizer_path
from unisift.llm.stage import delete, discard, made, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediate tables of the stage that was called last.
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """The stage, which first deletes what the one before has left."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _left)
        before = set(made())
        out = stage(spark, docs, sf_dir)
        _left[:] = [path for path in made() if path not in before]
        return out

    return run


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_documents(docs)


@_tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a text of spaces alone, or none, has no line to lose
    left = dedup_lines(docs.withColumn("had_text", F.coalesce(F.trim("text") != "", F.lit(False))), percent=80, width=5)
    left = left.where(~F.col("had_text") | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, percent=80, width=5)


@_tidy
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, MIX_WEIGHTS, seed=7, size=F.col("n_chars")).select(*docs.columns)


@_tidy
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path(), capacity=1024)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("source mixing", source_mixing),
    ("packing", packing),
]

#: SQL has no tokenizer; tests hold the pipeline against a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if stored:
            discard(stored)
        stored = docs
    return STAGES[-1][1](spark, docs, sf_dir)
