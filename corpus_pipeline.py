"""A training corpus from raw documents: each stage works on what the one before kept, read from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm.common import Scratch, table
from chronofold.llm.decontaminate import drop_contaminated
from chronofold.llm.mixing import sample_rows
from chronofold.llm.near_copies import first_of_near_copies
from chronofold.llm.quality import fit, keep_good
from chronofold.llm.queries import tokenizer_path
from chronofold.llm.token_files import token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 7, fitted to ``labels``) doesn't reject, with their columns.

    Null and empty texts are scored like any other; rows without an id are scored too; repeated rows stay or go together; without labels, or
    with labels of one kind, all get the labels' mean; an empty table gives no rows.
    """
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies (operator 6 at five-word shingles and similarity 0.8), with its columns.

    Null and empty texts and white space only are copies of each other; rows without an id stay; rows that share the smallest id stay all;
    an empty table gives no rows.
    """
    return first_of_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without items of ``benchmark`` (operator 1), with their columns.

    Null and empty texts and rows without an id stay; items without an id or text find nothing; an empty table gives no rows.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics (operator 2), with their columns.

    Null sources and languages are values of their own; null and empty texts have no tokens; rows without an id share one draw; repeated
    rows stay or go together; an empty table gives no rows.
    """
    return sample_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' index (operator 4), read back from the files: one row for each document.

    Null and empty texts have the end id alone; rows without an id come first; an empty table gives no rows; other columns are left out.
    """
    return token_files(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL has no quality classifier; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
