"""Line dedup by a suffix array over line ids.

Every document is its sequence of line ids. Distributed prefix doubling ranks the suffixes: level ``k`` has, for each position whose next
2**k lines occur elsewhere too, an order-preserving rank of those lines; level ``k + 1`` ranks the pairs (rank here, rank 2**k lines on)
by a range sort of the distinct pairs. Positions whose lines are unique leave at once, so the tables shrink from level to level. Equal
ranks are the suffix array's intervals with a longest common prefix of 2**k lines or more, and two overlapping ranks tell whether runs
of any length are equal.

A run of lines with ``min_words`` words or more that occurs at an earlier place (smaller ``doc_id``, then text hash, then line) is a
later copy, and is deleted. Every such run is a union of least ones (from a line on, or up to a line, until ``min_words`` words are
reached), so only these are compared: at most two for each line. Their union, merged, gives the maximal runs. The first copy stays.

Defined cases: null and empty texts have one empty line and stay; rows of the same id and text are one document's text (both keep or
lose the same lines); a null ``doc_id`` is after all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, TEXT, Scratch, texts

MIN_WORDS = 50
_LAST = (1 << 63) - 1
PLACE = ["doc", "mix", "line"]


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select(ID, TEXT, F.coalesce(ID, F.lit(_LAST)).alias("doc"), F.xxhash64(TEXT).alias("mix"))


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc``, ``mix``, ``line``, two hashes of the line, ``words``."""
    line = F.col("one")
    words = F.size(F.split(F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")), " +"))
    return _keyed(docs).select("doc", "mix", F.posexplode(F.split(TEXT, "\n", -1)).alias("line", "one")).select(*PLACE, F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"), F.when(F.trim(line) == "", 0).otherwise(words).alias("words"))


def _ranked(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``keys`` with an order-preserving ``rank``, for those that more than one place has."""
    place = F.struct(*PLACE)
    groups = rows.groupBy(*keys).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select(*keys)
    return scratch.save(groups.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()))


def least_runs(min_words: int):
    """From a document's repeated lines in order, the least runs of ``min_words`` words from each line and up to each line."""

    def of(lines: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int]]:
        cuts = [0, *(np.flatnonzero(np.diff(lines) != 1) + 1).tolist(), len(lines)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            total = np.concatenate([[0], np.cumsum(words[a:z])])
            n = z - a
            if total[-1] < min_words:
                continue
            ends = np.searchsorted(total, total[:n] + min_words)  # lines up to this one, from each
            runs = {(i, int(e) - i) for i, e in enumerate(ends) if e <= n}
            starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
            runs |= {(int(s), e + 1 - int(s)) for e, s in enumerate(starts) if s >= 0}
            for s, size in runs:
                yield int(lines[a]) + s, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines, words, out = None, [], [], []

        def settle() -> None:
            if key is not None:
                out.extend((*key, s, size, int(size).bit_length() - 1) for s, size in of(np.array(lines), np.array(words)))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc", "mix", "line", "size", "level"])

        for b in batches:
            for d, m, i, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (d, m) != key:
                    settle()
                    key, lines, words = (d, m), [], []
                    if len(out) > 20_000:
                        yield batch()
                        out = []
                lines.append(i)
                words.append(w)
        settle()
        if out:
            yield batch()

    return run


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal runs of lines to delete: ``doc_id``, ``mix`` (the text's hash), ``start``, ``end`` (line numbers, end exclusive)."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = lines_of(docs)
    rank = _ranked(lines, ["h", "g"], scratch)
    level = scratch.save(lines.join(rank, ["h", "g"]).groupBy(*PLACE).agg(F.first("rank").alias("r"), F.first("words").alias("words")))
    scratch.drop(rank)
    runs = scratch.save(level.select(*PLACE, "words").repartition("doc", "mix").sortWithinPartitions(*PLACE).mapInArrow(least_runs(min_words), "doc long, mix long, line int, size int, level int"))
    most = runs.agg(F.max("level")).first()[0]
    levels = [level.select(*PLACE, "r", F.lit(0).alias("level"))]
    for k in range(most or 0):
        here, on = levels[-1].drop("level"), levels[-1].select("doc", "mix", (F.col("line") - (1 << k)).alias("line"), F.col("r").alias("r2"))
        pairs = here.join(on, PLACE)
        rank = _ranked(pairs, ["r", "r2"], scratch)
        levels.append(scratch.save(pairs.join(rank, ["r", "r2"]).select(*PLACE, F.col("rank").alias("r"), F.lit(k + 1).alias("level"))))
        scratch.drop(rank)
    ranks = reduce(DataFrame.unionByName, levels)
    # a run's lines are told by the ranks of its first and of its last 2**level lines
    tail = ranks.select("doc", "mix", "level", F.col("line").alias("at"), F.col("r").alias("r2"))
    told = runs.join(ranks, [*PLACE, "level"]).withColumn("at", F.col("line") + F.col("size") - F.expr("shiftleft(1, level)")).join(tail, ["doc", "mix", "level", "at"])
    told = scratch.save(told.select(*PLACE, "size", "level", "r", "r2"))
    scratch.drop(level, runs, *levels[1:])
    same = ["level", "size", "r", "r2"]
    place = F.struct(*PLACE)
    # written first: a join of tables, unlike one with an aggregate of the same shuffle, lets Spark split a run that many documents share
    first = scratch.save(told.groupBy(*same).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").drop("hi"))
    copies = told.join(first, same).filter(place > F.col("lo")).select("doc", "mix", F.col("line").alias("start"), (F.col("line") + F.col("size")).alias("end"))
    w = Window.partitionBy("doc", "mix").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach >= F.col("start"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = copies.withColumn("island", island).groupBy("doc", "mix", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(F.nullif("doc", F.lit(_LAST)).alias(ID), "mix", "start", "end")


def drop_later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``text`` without later copies, ``n_lines`` (before), ``n_removed``: one row for each row of ``docs``."""
    gone = later_copies(docs, min_words).groupBy(F.coalesce(ID, F.lit(_LAST)).alias("doc"), "mix").agg(F.collect_list(F.struct("start", "end")).alias("runs"), F.sum(F.col("end") - F.col("start")).alias("n_removed"))
    left = F.filter(F.split(TEXT, "\n", -1), lambda _, i: ~F.exists("runs", lambda r: (i >= r["start"]) & (i < r["end"])))
    return _keyed(docs).join(gone, ["doc", "mix"], "left").select(
        ID, F.when(F.col("runs").isNull(), F.col(TEXT)).otherwise(F.array_join(left, "\n")).alias(TEXT), F.size(F.split(TEXT, "\n", -1)).cast("long").alias("n_lines"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed")
    )
