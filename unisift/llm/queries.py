"""The subpackage's queries with production parameters, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import linked_turns_sql
from .lines import line_dedup_sql
from .mixing import mix_sql
from .search import search_sql
from .units import repeated_units_sql


def tokenizer_path() -> str:
    """The byte-level BPE file of the installed tokenizer collection."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), tokenizer_path(), capacity=1024)


#: Target shares of the mixture; "*" is all other sources together.
MIX_WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.15, "*": 0.55}


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import mix

    documents = _documents(spark, sf_dir).select("doc_id", "text", "source", "n_chars")
    return mix(documents, MIX_WEIGHTS, seed=7, size=F.col("n_chars")).drop("n_chars")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(_documents(spark, sf_dir), tokenizer_path(), limit=1024)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_bytes

    return repeated_bytes(_documents(spark, sf_dir), length=400)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_documents

    return similar_documents(_documents(spark, sf_dir), percent=90, width=3).select("doc_id", "n_shingles", "component_id")


#: Lines and paragraphs, and sentences for passages that were pasted into a line.
UNIT_KINDS = ("line", "paragraph", "sentence")


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .units import repeated_units

    return repeated_units(_documents(spark, sf_dir), UNIT_KINDS, dict.fromkeys(UNIT_KINDS, 5))


def op8_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .chat import REPLY_SCHEMA, link_calls, turns_as_calls

    calls, results = turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    linked = link_calls(calls, results, {"reply": REPLY_SCHEMA})
    return linked.withColumn("errors", F.array_join("errors", "; "))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), percent=80, width=5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(_documents(spark, sf_dir))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .search import search

    documents = _documents(spark, sf_dir)
    return search(documents, documents.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_source_mixing": op2_source_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_unit_dedup": op6_unit_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_tool_linking": op8_tool_linking,
    "op9_line_dedup": op9_line_dedup,
    "op10_topk_search": op10_topk_search,
}

ORACLE: dict[str, str] = {
    "op2_source_mixing": mix_sql(MIX_WEIGHTS, 7, "n_chars", "doc_id, text, source"),
    "op6_unit_dedup": repeated_units_sql(5, UNIT_KINDS),
    "op8_tool_linking": f"SELECT * REPLACE (array_to_string(errors, '; ') AS errors) FROM ({linked_turns_sql()})",
    "op9_line_dedup": line_dedup_sql(80, 5),
    "op10_topk_search": search_sql(10, 20),
}
