"""Offline jobs: building the item dimension, merging result files, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dimension, merge
from ..sources import files


def build_items(spark: SparkSession, pattern: str, order: list[str], more: list[tuple[str, str, int]] = ()) -> DataFrame:
    """Items of all editions: the newest facts, one spelling each, ``more`` where it is missing, ids in code-point order."""
    won = dimension.latest_wins(files.read_editions(spark, pattern, order))
    names = dimension.collapse_spellings(won).select("name").join(won, "name").select("name", "type", "pp")
    if more:
        names = dimension.supplement(names, spark.createDataFrame(list(more), "name string, type string, pp int"))
    return dimension.number_items(names).select("id", "name", "type", "pp")


def merge_results(spark: SparkSession, paths: list[str], collected: str) -> tuple[DataFrame, DataFrame]:
    """The merged result files, and of them the entities that aren't collected yet."""
    rows = files.read_results(spark, paths)
    order = rows.groupBy("entity").agg(F.min(F.struct("file_ord", "ent_pos")).alias("first")).select("entity", "first.*")
    merged = merge.merge_files(rows).join(order, "entity")
    return merged, merge.not_collected(merged, files.read_collected(spark, collected))


def write_merged(spark: SparkSession, paths: list[str], collected: str, out: str, new: str) -> None:
    """Both of ``merge_results`` as result files."""
    for rows, path in zip(merge_results(spark, paths, collected), (out, new), strict=True):
        order = rows.groupBy("entity").agg(F.min(F.struct("file_ord", "ent_pos")).alias("ent_pos"))
        lists = rows.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda s: s["item"]).alias("items"))
        files.write_lists(lists.join(order, "entity"), path)


def compare_names(spark: SparkSession, a: str, b: str) -> DataFrame:
    """Names that only one of two files has."""
    return merge.name_differences(files.read_entities(spark, a), files.read_entities(spark, b))


def character_report(names: DataFrame, allowed: str) -> DataFrame:
    """Characters of the names with counts and categories, and whether a reader's alphabet has them."""
    return dimension.character_counts(names).withColumn("allowed", F.contains(F.lit(allowed), F.col("char")))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """``df``, and an observation that has its number of rows once it has run: progress without another pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
