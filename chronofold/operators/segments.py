"""Segments of a timeline: one for each entry into a detail frame, as windows in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import KEY, SLOT, keyed, time_slot


def segments(timeline: DataFrame, slot: float = SLOT) -> DataFrame:
    """From ``group_id``, ``ts``, ``ord`` (breaks ties), ``kind``, ``box`` (an accepted entity read, or null) the segments that have list frames.

    A segment begins where the kind becomes ``detail``; frames before the first are segment 0. Its ``entity`` is the latest box read in the
    segment before it, or else what a segment before without list frames had. Returns ``group_id``, ``seg``, ``segment_no``, ``entity``,
    ``detail_ts`` (null without an entity), ``list_start``, ``list_end``, ``list_frames``.
    """
    # one scan: whether a slot's first frame is an entry is told among the rows that slots hand on, as it needs the slot before
    w, at = Window.partitionBy(KEY).orderBy("ts", "ord"), F.struct("ts", "ord")
    entered = lambda now, before: F.coalesce((now == "detail") & (F.coalesce(before, F.lit("other")) != "detail"), F.lit(False))
    seen = keyed(timeline, time_slot(F.col("ts"), slot)).withColumn("_kind", F.lag(F.struct("kind")).over(w))
    seen = seen.withColumn("entry", F.col("_kind").isNotNull() & entered(F.col("kind"), F.col("_kind.kind")))
    within = seen.withColumn("_own", F.sum(F.col("entry").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    slots = seen.groupBy(KEY).agg(F.min_by("kind", at).alias("first"), F.max_by("kind", at).alias("end"), F.sum(F.col("entry").cast("int")).alias("n"))
    so = Window.partitionBy(f"{KEY}.of").orderBy(f"{KEY}.slot")
    begun = slots.withColumn("_begins", entered(F.col("first"), F.lag("end").over(so)).cast("int"))
    earlier = F.coalesce(F.sum(F.col("n") + F.col("_begins")).over(so.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = within.join(begun.select(KEY, "_begins", earlier.alias("_earlier")), KEY)
    marked = marked.withColumns({"entry": F.col("entry") | F.col("_kind").isNull() & (F.col("_begins") == 1), "seg": F.col("_own") + F.col("_earlier") + F.col("_begins")}).drop(KEY)
    is_list = F.col("kind") == "move_list"
    each = marked.groupBy("group_id", "seg").agg(
        F.min(F.when(F.col("entry"), F.col("ts"))).alias("entry_ts"), F.min(F.when(is_list, F.col("ts"))).alias("list_start"), F.max(F.when(is_list, F.col("ts"))).alias("list_end"), F.count_if(is_list).alias("list_frames"),
        F.max_by("box", F.when((F.col("kind") == "other") & F.col("box").isNotNull(), F.struct("ts", "ord"))).alias("read"),
    )
    so = Window.partitionBy("group_id").orderBy("seg")
    given = each.withColumn("given", F.lag("read").over(so)).withColumn("run", F.sum(F.when(F.lag("list_frames").over(so) > 0, 1).otherwise(0)).over(so.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("group_id", "run").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    named = given.withColumn("entity", F.when(F.col("seg") > 0, F.last("given", ignorenulls=True).over(run)))
    kept = named.filter("list_frames > 0")
    return kept.select("group_id", "seg", F.row_number().over(so).alias("segment_no"), "entity", F.when(F.col("entity").isNotNull(), F.col("entry_ts")).alias("detail_ts"), "list_start", "list_end", "list_frames")


def with_lists(found: DataFrame, lists: DataFrame) -> DataFrame:
    """``found`` with the ``items`` of ``lists`` (``group_id``, ``segment_no``, ``items``); an empty array for a segment without list frames or items."""
    return found.join(lists, ["group_id", "segment_no"], "left").withColumn("items", F.when(F.col("list_start").isNotNull() & F.col("items").isNotNull(), F.col("items")).otherwise(F.array().cast("array<string>")))


def number_segments(found: DataFrame, group_no: str = "group_no") -> DataFrame:
    """A running number over all groups, from 1: group totals are summed, so only one row a group meets in one task."""
    own = F.row_number().over(Window.partitionBy(group_no).orderBy("segment_no"))
    totals = found.groupBy(group_no).agg(F.count("*").alias("n"))
    before = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(group_no).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return found.withColumn("own", own).join(before, group_no).withColumn("global_no", (F.col("own") + F.col("before")).cast("long")).drop("own", "before")


def frames_of_segments(frames: DataFrame, found: DataFrame, index_fps: float, slot: float = 60.0) -> DataFrame:
    """Frames in [start - 2 / index_fps, end + 2 / index_fps) of each segment; a frame may serve two.

    A range join without a nested loop: segments are spread over the time slots (of ``slot`` seconds) that they touch, and frames join the
    segments of their slot.
    """
    margin = 2.0 / index_fps
    lo, hi = F.greatest(F.lit(0.0), F.col("list_start") - margin), F.col("list_end") + margin
    s = found.filter(F.col("list_start").isNotNull()).withColumns({"lo": lo, "hi": hi})
    s = s.withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo") / slot), F.floor(F.col("hi") / slot)))).select("group_id", "segment_no", "lo", "hi", "slot")
    return frames.withColumn("slot", F.floor(F.col("ts") / slot)).join(s, ["group_id", "slot"]).filter("ts >= lo and ts < hi").drop("slot", "lo", "hi")


def select_segments(found: DataFrame, only: str | None) -> DataFrame:
    """Segments (``global_no``, ``entity``) that a list of numbers and names asks for; a name stands for its last segment; null for all."""
    if only is None:
        return found
    tokens = [t for x in only.split(",") if (t := x.strip())]
    numbers, names = [int(t) for t in tokens if t.isdigit()], [t for t in tokens if not t.isdigit()]
    name = F.coalesce("entity", F.lit("(unknown)"))
    last = found.groupBy(name.alias("name")).agg(F.max("global_no").alias("global_no")).filter(F.col("name").isin(names)).select("global_no")
    wanted = last.unionByName(found.select("global_no").filter(F.col("global_no").isin(numbers))).distinct()
    return found.join(wanted, "global_no", "left_semi")


def unknown_tokens(found: DataFrame, only: str) -> list[str]:
    """Names asked for that no segment has."""
    names = [t for x in only.split(",") if (t := x.strip()) and not t.isdigit()]
    have = {r[0] for r in found.select(F.coalesce("entity", F.lit("(unknown)"))).filter(F.coalesce("entity", F.lit("(unknown)")).isin(names)).distinct().collect()}
    return [n for n in names if n not in have]


def known_candidates(found: DataFrame, dim: DataFrame) -> DataFrame:
    """Candidates (``seg_no``, ``pos``, ``id``, ``score``) with the dimension's names; ids that it lacks are dropped."""
    return found.join(dim.select("id", "name"), "id").select("seg_no", "pos", "id", "name", "score")
