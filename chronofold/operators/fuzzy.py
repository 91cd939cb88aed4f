"""Approximate joins of observed texts with dimension tables.

Distinct texts are matched once and joined back. The dimension becomes an index of its names (``name_index``), which answers each text exactly and
compares it only with names that can be among the best: no pairs are formed, shuffled or ranked. An index holds up to ``BROADCAST_ROWS`` rows,
which is checked; a larger dimension becomes several, each giving its best ``k`` before these meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text
from . import name_index

BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 16 << 20
#: What a matching attribute adds to an item's rank (never to its score); the scores that accept an item, an entity, and an entity unseen.
BONUS, ACCEPT_ITEM, ACCEPT_ENTITY, AUTO_ENTITY = 0.15, 0.7, 0.7, 0.85


def slices(dim: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> list[DataFrame]:
    """``dim`` in parts that are small enough for one index, in rows and in bytes of names."""
    n, held = dim.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()
    if n <= rows and held <= size:
        return [dim]
    many = max(-(-n // rows), -(-held // size)) * 2
    part = F.pmod(F.xxhash64("id"), F.lit(many))
    return [dim.filter(part == k) for k in range(many)]


def _best(pairs: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _probed(texts: DataFrame, index, answer: Callable, schema: str) -> DataFrame:
    """The rows that ``answer(index, *row)`` gives for each row of ``texts``; the index is broadcast once. Texts are small and take long: they are dealt
    to tasks by number, where Spark would put some megabytes of them into one.
    """
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(index)
    texts = texts.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in answer(held.value, *row)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(kinds)], schema=kinds)

    return texts.mapInArrow(run, schema)


def match_items(observed: DataFrame, dim: DataFrame, k: int = 3, ascii_only: bool = False, bonus: float = BONUS) -> DataFrame:
    """Top ``k`` items for each distinct (``raw``, ``observed_type``): ranked by edit similarity plus ``bonus`` where the types agree, ties by
    the dimension's order; ``score`` is without the bonus. Empty texts match nothing.

    ``dim``: ``id``, ``name``, ``type``. Returns ``raw``, ``observed_type``, ``rank``, ``id``, ``name``, ``score``.
    """
    texts = observed.select("raw", "observed_type").distinct().filter(F.length("raw") > 0).withColumn("norm", text.kana_fold(F.col("raw"), ascii_only))
    dim = dim.select("id", "name", text.kana_fold(F.col("name"), ascii_only).alias("norm_name"), "type").filter("name is not null")
    keys = ["raw", "observed_type"]

    def answer(index: name_index.Items, raw: str, kind: str | None, norm: str) -> list[tuple]:
        return [(raw, kind, r + 1, *found) for r, found in enumerate(index.best(norm, kind, k, bonus))]

    def part(d: DataFrame) -> DataFrame:
        index = name_index.Items([tuple(r) for r in d.collect()])  # one slice, of checked size
        return _probed(texts, index, answer, "raw string, observed_type string, rank int, id long, name string, score double")

    parts = [part(d) for d in slices(dim)]
    out = parts[0]
    if len(parts) > 1:
        kinds = dim.select("id", "type")
        boosted = F.col("score") + F.when(F.col("type") == F.col("observed_type"), bonus).otherwise(0.0)
        out = _best(reduce(DataFrame.unionByName, parts).drop("rank").join(kinds, "id").withColumn("boosted", boosted), keys, [F.desc("boosted"), "id"], k)
    return out.select(*keys, F.col("rank").cast("int").alias("rank"), F.col("id").cast(dim.schema["id"].dataType).alias("id"), "name", "score")


def canonical_texts(observed: DataFrame, dim: DataFrame, accept: float = ACCEPT_ITEM, ascii_only: bool = False) -> DataFrame:
    """``observed`` with ``canonical``: the best item's name if its score, without the bonus that ranked it, is ``accept`` or more; else the raw text."""
    best = match_items(observed, dim, 1, ascii_only).select("raw", "observed_type", F.when(F.col("score") >= accept, F.col("name")).otherwise(F.col("raw")).alias("canonical"))
    joined = observed.alias("o").join(best.alias("b"), (F.col("o.raw") == F.col("b.raw")) & F.col("o.observed_type").eqNullSafe(F.col("b.observed_type")), "left")
    return joined.select("o.*", F.coalesce("b.canonical", "o.raw").alias("canonical"))


def match_entities(observed: DataFrame, dim: DataFrame, k: int = 5, least: float | None = None) -> DataFrame:
    """Top ``k`` entities for each distinct ``raw``: the ratio of the whole names, or of the name's base and the text's beginning where the
    name has no form or its form is in the text; ties by the whole ratio, then the dimension's order. With ``least``, of those that reach it.
    """
    texts = observed.select("raw").distinct().filter(F.length("raw") > 0).withColumn("norm", text.entity_fold(F.col("raw")))
    base, form = text.base_and_form(F.col("name"))
    dim = dim.select("id", "name", text.kana_fold(F.col("name")).alias("norm_name"), text.kana_fold(base).alias("base"), text.kana_fold(form).alias("form")).filter("name is not null")

    def answer(index: name_index.Entities, raw: str, norm: str) -> list[tuple]:
        return [(raw, r + 1, *found) for r, found in enumerate(index.best(norm, k, least))]

    def part(d: DataFrame) -> DataFrame:
        index = name_index.Entities([tuple(r) for r in d.collect()])  # one slice, of checked size
        return _probed(texts, index, answer, "raw string, rank int, id long, name string, score double, whole double")

    parts = [part(d) for d in slices(dim)]
    out = parts[0] if len(parts) == 1 else _best(reduce(DataFrame.unionByName, parts).drop("rank"), ["raw"], [F.desc("score"), F.desc("whole"), "id"], k)
    return out.select("raw", F.col("rank").cast("int").alias("rank"), F.col("id").cast(dim.schema["id"].dataType).alias("id"), "name", "score", "whole")


def entities_of_fragments(fragments: DataFrame, dim: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` entities for each ``frame_id`` from its text fragments (``frag_no``, ``text``): the joined text, where there are two or more,
    comes first, then each fragment; by score, then longer names, then that order; an entity once.
    """
    frags = fragments.withColumn("raw", text.strip(F.col("text"))).filter(F.length("raw") >= 2).select("frame_id", "frag_no", "raw")
    joined = frags.groupBy("frame_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frag_no", "raw"))), lambda s: s["raw"]), " ").alias("raw")).filter("n >= 2")
    each = joined.select("frame_id", F.lit(-1).alias("frag_no"), "raw").unionByName(frags)
    found = each.join(match_entities(each, dim, k), "raw").withColumn("len", F.length("name"))
    order = [F.desc("score"), F.desc("len"), "frag_no", "rank"]
    # by frame first: both windows then find its rows in one task, without another exchange
    once = found.repartition("frame_id").withColumn("n", F.row_number().over(Window.partitionBy("frame_id", "id").orderBy(*order))).filter("n = 1").drop("rank")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("score"), F.desc("len"), "frag_no", "id"))).filter(F.col("rank") <= k).select("frame_id", "rank", "id", "name", "score")
