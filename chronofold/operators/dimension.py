"""Building dimensions from several editions of a list, and reports on their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .scan import KEY, keyed, scan


def latest_wins(rows: DataFrame) -> DataFrame:
    """From ``name``, ``rank`` (edition), ``file_ord``, ``game_pos``, ``type``, ``pp`` (null where an edition has no facts) the newest facts of each name that has any, and its newest edition with facts."""
    has = F.col("type").isNotNull() | F.col("pp").isNotNull()
    facts = rows.filter(has)
    return facts.groupBy("name").agg(F.max("rank").alias("best_rank"), F.max_by(F.struct("type", "pp"), F.struct("rank", "file_ord", "game_pos")).alias("info")).select("name", "best_rank", "info.type", "info.pp")


def collapse_spellings(names: DataFrame, ascii_only: bool = False) -> DataFrame:
    """One name for each spelling key: of the newest edition, then NFKC, then without blanks, then the last in code points; ``dropped`` has the others."""
    is_nfkc = F.lit(True) if ascii_only else text.nfkc(F.col("name")) == F.col("name")
    choice = F.struct("best_rank", is_nfkc.alias("is_nfkc"), (~F.col("name").rlike("[ 　]")).alias("no_blank"), "name")
    by = names.withColumn("key", text.spelling_key(F.col("name"), ascii_only)).groupBy("key").agg(F.max(choice)["name"].alias("name"), F.array_sort(F.collect_set("name")).alias("all"))
    return by.select("key", "name", F.array_except("all", F.array("name")).alias("dropped"))


def supplement(names: DataFrame, more: DataFrame) -> DataFrame:
    """``names`` and those of ``more`` that it lacks, by name."""
    return names.unionByName(more.join(names.select("name"), "name", "left_anti").select(*names.columns))


def number_items(names: DataFrame) -> DataFrame:
    """Ids from 1 in code-point order. Names of one beginning are one task's; how many come before them is told over one row a beginning."""
    begun = keyed(names.withColumn("_one", F.lit(0)), F.substring("name", 1, 2), "_one")
    return scan(begun, ["name"], total={"id": F.lit(1)}).withColumn("id", (F.col("id") + 1).cast("int")).drop(KEY, "_one")


def character_counts(names: DataFrame) -> DataFrame:
    """How often each character occurs, with its category."""
    chars = names.select(F.explode(F.filter(F.split("name", ""), lambda c: c != "")).alias("char")).groupBy("char").agg(F.count("*").alias("n"))
    return chars.withColumn("category", text.char_category(F.col("char")))


def frequent_characters(counts: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("category").orderBy(F.desc("n"), "char")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
