"""Merging item lists: ordered unions and the containment fold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

COVERAGE = 0.9
#: Segment numbers that one task carries a name over.
STRETCH = 10_000
UNKNOWN = "(unknown)"


def keyed_entity(entity: Column, seg_no: Column) -> Column:
    """Unknown entities stay apart by segment."""
    return F.when(entity.isNull() | (entity == UNKNOWN), F.concat(F.lit("(unknown "), seg_no.cast("string"), F.lit(")"))).otherwise(entity)


def merge_segments(items: DataFrame) -> DataFrame:
    """From ``seg_no``, ``entity``, ``pos``, ``item`` the ordered union by entity: ``entity``, ``pos``, ``item``."""
    rows = items.withColumn("entity", keyed_entity(F.col("entity"), F.col("seg_no")))
    first = rows.groupBy("entity", "item").agg(F.min(F.struct("seg_no", "pos")).alias("first"))
    return first.select("entity", F.row_number().over(Window.partitionBy("entity").orderBy("first")).alias("pos"), "item")


def merge_files(rows: DataFrame) -> DataFrame:
    """From ``file_ord``, ``entity``, ``pos``, ``item``: an entity's first list as it is, then what later lists add; repeats within one list stay. Unknown entities are left out."""
    rows = rows.filter(~F.col("entity").startswith(UNKNOWN[:-1]))
    first = rows.groupBy("entity", "item").agg(F.min("file_ord").alias("first_file"))
    new = rows.join(first, ["entity", "item"]).filter("file_ord = first_file")
    return new.select("entity", F.row_number().over(Window.partitionBy("entity").orderBy("file_ord", "pos")).alias("pos"), "item")


def anchors(segments: DataFrame) -> DataFrame:
    """``segments`` with ``anchor``, the last name that isn't unknown up to each, in order of ``seg_no``.

    Stretches of ``STRETCH`` numbers are windows of their own; what a stretch ends with is carried on over one row for each stretch, so no
    task holds all segments.
    """
    rows = segments.withColumn("stretch", F.floor(F.col("seg_no") / STRETCH))
    name = F.when(F.col("name") != UNKNOWN, F.col("name"))
    own = F.last(name, ignorenulls=True).over(Window.partitionBy("stretch").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy("stretch").agg(F.max_by("name", F.when(name.isNotNull(), F.col("seg_no"))).alias("end"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("stretch", F.last("end", ignorenulls=True).over(before).alias("carried"))
    return rows.withColumn("own", own).join(F.broadcast(carried), "stretch").withColumn("anchor", F.coalesce("own", "carried")).drop("own", "carried", "stretch")


def containment_merge(segments: DataFrame, least: float = COVERAGE) -> DataFrame:
    """From ``seg_no``, ``name``, ``items`` (arrays): an unknown segment joins the last named one before it if ``least`` of the smaller list is in the larger; the union is compared with the next.

    Segments come sorted by name, the named ones first, then by number, and are folded as they come: a task holds one name's union, never its
    segments. The fold depends on its order, so a name is one task's. Unknown segments before any name stay as they are. Returns
    ``entity``, ``items``, ``merged`` (numbers of the segments it took in), ``seg_no`` (its first segment).
    """
    named = anchors(segments)
    kind = dict(segments.dtypes)
    schema = f"entity string, items {kind['items']}, merged array<{kind['seg_no']}>, seg_no {kind['seg_no']}"
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, union, merged, first = None, {}, [], None
        for b in batches:
            out = []
            for anchor, known, seg_no, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if anchor != name:
                    if name is not None:
                        out.append((name, list(union), merged, first))
                    name, union, merged, first = anchor, {}, [], seg_no
                own = dict.fromkeys(items or ())
                small = min(len(union), len(own))
                if known:
                    union |= own
                elif small and len(union.keys() & own.keys()) / small >= least:
                    union |= own
                    merged.append(seg_no)
                else:
                    out.append((None, list(own), [], seg_no))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["entity", "items", "merged", "seg_no"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, list(union), merged, first), types, strict=True)], names=["entity", "items", "merged", "seg_no"])

    rows = named.filter("anchor is not null").select("anchor", (F.col("name") != UNKNOWN).alias("known"), "seg_no", "items")
    folded = rows.repartition("anchor").sortWithinPartitions("anchor", F.desc("known"), "seg_no").mapInArrow(fold, schema)
    alone = named.filter("anchor is null").select(F.lit(None).cast("string").alias("entity"), F.array_distinct("items").alias("items"), F.array().cast(f"array<{kind['seg_no']}>").alias("merged"), "seg_no")
    return folded.unionByName(alone).withColumn("entity", F.coalesce("entity", keyed_entity(F.lit(None).cast("string"), F.col("seg_no"))))


def not_collected(merged: DataFrame, collected: DataFrame) -> DataFrame:
    return merged.join(collected.select("entity").distinct(), "entity", "left_anti")


def collected_too(merged: DataFrame, collected: DataFrame) -> DataFrame:
    return merged.join(collected.select("entity").distinct(), "entity", "left_semi")


def name_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names of one list only, with the ``side`` that has them."""
    j = a.select(F.col("name").alias("l")).distinct().join(b.select(F.col("name").alias("r")).distinct(), F.col("l") == F.col("r"), "full_outer")
    return j.filter("l is null or r is null").select(F.coalesce("l", "r").alias("name"), F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def coverage(a: Column, b: Column) -> Column:
    """Shared part of the smaller of two sets."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small)
