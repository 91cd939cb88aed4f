"""Rows of a list on screen, from profiles of its pixels by height."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Below which grey a pixel is dark; saturation and value of an icon's colour; the share of dark pixels that makes a line of text.
DARK_BELOW, COLOURED, BRIGHT, GREYISH, TEXT_SHARE = 120, 50, 120, 45, 0.02


def profiles(pixels: DataFrame) -> DataFrame:
    """By frame and height: mean saturation and value, share of dark pixels."""
    return pixels.groupBy("frame_id", "y").agg(F.avg("sat").alias("sat"), F.avg("val").alias("val"), F.avg((F.col("gray") < DARK_BELOW).cast("int")).alias("dark"))


def icon_like(rows: DataFrame) -> DataFrame:
    """Coloured, or bright and grey."""
    return rows.withColumn("icon", ((F.col("sat") > COLOURED) | ((F.col("val") > BRIGHT) & (F.col("sat") < GREYISH))).cast("int"))


def comb_phase(rows: DataFrame, spacing: int) -> DataFrame:
    """The offset of a comb of ``spacing`` that hits most icon rows (``y`` from 0, ``icon``); the first on ties."""
    teeth = rows.groupBy("frame_id", (F.col("y") % spacing).alias("offset")).agg(F.sum("icon").alias("hits"))
    return teeth.groupBy("frame_id").agg(F.max_by("offset", F.struct("hits", -F.col("offset"))).alias("offset"))


def icon_rows(rows: DataFrame, phase: DataFrame, spacing: int, row_h: int, ys: tuple[int, ...], vtop: int, vbot: int) -> DataFrame:
    """Tops of the rows whose icon the comb hits: ``icon_top`` as it is, ``text_top`` no higher than the list; rows that don't fit are left out."""
    at = rows.join(phase, "frame_id").filter((F.col("y") % spacing == F.col("offset")) & (F.col("icon") == 1)).withColumn("centre", F.col("y") + vtop)
    at = at.filter(F.col("centre").between(ys[0] + row_h // 2 - spacing // 2, ys[-1] + row_h // 2 + spacing // 2)).withColumn("icon_top", F.col("centre") - row_h // 2)
    return at.withColumn("text_top", F.greatest(F.lit(ys[0]), "icon_top")).filter((F.col("text_top") >= vtop) & (F.col("text_top") + row_h <= vbot)).select("frame_id", "text_top", "icon_top")


def text_band(rows: DataFrame, least: float = TEXT_SHARE) -> DataFrame:
    """The centre of the longest run of dark heights, the first on ties; frames without one are left out."""
    dark = rows.filter(F.col("dark") > least)
    island = dark.withColumn("island", F.col("y") - F.row_number().over(Window.partitionBy("frame_id").orderBy("y")))
    runs = island.groupBy("frame_id", "island").agg(F.min("y").alias("s"), F.max("y").alias("e"))
    best = runs.groupBy("frame_id").agg(F.max_by(F.struct("s", "e"), F.struct(F.col("e") - F.col("s"), -F.col("s"))).alias("run"))
    return best.select("frame_id", F.floor((F.col("run.s") + F.col("run.e")) / 2).cast("long").alias("centre"))


def whole_rows(boxes: DataFrame, top: int, bottom: int) -> DataFrame:
    """Boxes (``centre`` found, ``by``, ``h``) that lie within the list."""
    return boxes.filter(F.col("centre").isNotNull() & (F.col("by") >= top) & (F.col("by") + F.col("h") <= bottom))
