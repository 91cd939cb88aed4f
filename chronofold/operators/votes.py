"""Votes for items within segments, and acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fuzzy import ACCEPT_ITEM, AUTO_ENTITY, match_items

TRUST = 0.5


def votes(observations: DataFrame, least: int = 1) -> DataFrame:
    """Votes by ``segment_id`` and ``name``, with the place first seen; every observation counts."""
    return observations.groupBy("segment_id", "name").agg(F.count("*").alias("votes"), F.min(F.struct("frame_idx", "row_no")).alias("first_seen")).filter(F.col("votes") >= least)


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Each value once by key, where it first stands; ``pos`` from 1."""
    first = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("first"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("first", value))).drop("first")


def accepted_items(counted: DataFrame, dim: DataFrame, accept: float = ACCEPT_ITEM, ascii_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Voted names matched again without a type: accepted items in order of first sight, an item once by segment; and the doubtful names with their candidates."""
    names = counted.select(F.col("name").alias("raw"), F.lit(None).cast("string").alias("observed_type"))
    found = match_items(names, dim, 3, ascii_only).drop("observed_type")
    top = counted.join(found.filter("rank = 1").drop("rank").withColumnRenamed("name", "item"), counted.name == F.col("raw"))
    yes = top.filter(F.col("score") >= accept)
    once = yes.withColumn("n", F.row_number().over(Window.partitionBy("segment_id", "id").orderBy("first_seen"))).filter("n = 1")
    items = once.select("segment_id", "id", "item", "score", F.row_number().over(Window.partitionBy("segment_id").orderBy("first_seen")).alias("pos"))
    cands = found.groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "name", "score"))).alias("candidates"))
    return items, top.filter(F.col("score") < accept).select("segment_id", "raw").join(cands, "raw")


def header_text(fragments: DataFrame) -> DataFrame:
    """A frame's fragments as one string, in order."""
    return fragments.groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frag_no", "text"))), lambda s: s["text"]), "").alias("text"))


def best_text(fragments: DataFrame) -> DataFrame:
    """The text read with most confidence by ``frame_id`` and ``box_no``; the first on ties; an empty one with 0 for none."""
    out = fragments.groupBy("frame_id", "box_no").agg(F.max_by(F.struct("text", "confidence"), F.when(F.col("text").isNotNull(), F.struct("confidence", -F.col("frag_no")))).alias("best"))
    return out.select("frame_id", "box_no", F.coalesce("best.text", F.lit("")).alias("text"), F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"))


def with_fallback(read: DataFrame, second: DataFrame, keys: list[str], trust: float = TRUST) -> DataFrame:
    """Texts of little confidence give way to a second reading, where that has text; only those rows need the second reader."""
    j = read.join(second.withColumnRenamed("text", "second_text"), keys, "left")
    return j.withColumn("text", F.when(F.col("confidence") < trust, F.coalesce(F.nullif("second_text", F.lit("")), "text")).otherwise(F.col("text"))).drop("second_text")


def split_accepted(scored: DataFrame, accept: float = ACCEPT_ITEM) -> tuple[DataFrame, DataFrame]:
    return scored.filter(F.col("score") >= accept), scored.filter((F.col("score") < accept) | F.col("score").isNull())


def choose_entity(found: DataFrame, auto: float = AUTO_ENTITY, no_prompt: bool = True) -> DataFrame:
    """``name`` of each segment from its best candidate (``top_name``, ``top_score``); ``review`` marks those that a person should decide, as their score is below ``auto``."""
    sure = F.lit(no_prompt) | (F.col("top_score") >= auto)
    return found.withColumns({"name": F.when(F.col("top_name").isNull(), "(unknown)").when(sure, F.col("top_name")), "review": F.col("top_name").isNotNull() & ~F.coalesce(sure, F.lit(False))})
