"""The whole run: frames to segments to observations to merged lists. Each step is a function of DataFrames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import fuzzy, merge, segments, timeline, votes
from ..options import Options
from ..sources import files


def index(frames: DataFrame, box_reads: DataFrame, entities: DataFrame, options: Options) -> DataFrame:
    """Phase one. ``frames``: ``group_id``, ``ts``, ``ord``, ``read_kind``, thumbs, ``mean_luma``; ``box_reads``: ``group_id``, ``ord``, ``raw``.

    Only box reads of frames that need reading are matched, each distinct text once.
    """
    known = files.kept(timeline.carry_kind(timeline.in_range(frames, options.start, options.end)))  # scans read what they scan twice
    kinds = files.kept(timeline.to_read(known).select("group_id", "ts", "ord", "kind", "box_read"))
    need = kinds.filter("box_read").select("group_id", "ord").join(box_reads, ["group_id", "ord"])
    best = fuzzy.match_entities(need, entities, 1, least=options.accept_entity).select("raw", F.col("name").alias("box"), F.col("score").alias("box_score"))
    reads = need.join(best, "raw").groupBy("group_id", "ord").agg(F.max_by("box", "box_score").alias("box"))
    return segments.segments(files.kept(kinds.join(reads, ["group_id", "ord"], "left")))


def collect(found: DataFrame, frames: DataFrame, observations: DataFrame, items: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Phase two. Observations (``group_id``, ``ord``, ``row_no``, ``raw``, ``observed_type``) of the list frames in each segment's range, matched, counted
    and accepted: ``group_id``, ``segment_no``, ``item``, ``pos``; and the doubtful names (``raw``) with their ``candidates``.
    """
    marked = timeline.to_read(files.kept(timeline.carry_kind(frames)))
    ranged = segments.frames_of_segments(marked.filter("vote"), found, options.index_fps)
    seen = ranged.select("group_id", "ord", "segment_no").join(observations, ["group_id", "ord"])
    named = fuzzy.canonical_texts(seen, items, options.accept_item, options.ascii_names)
    key = F.struct("group_id", "segment_no")
    counted = votes.votes(named.select(key.alias("segment_id"), F.col("canonical").alias("name"), F.col("ord").alias("frame_idx"), "row_no"), options.least_votes)
    good, doubtful = votes.accepted_items(counted, items, options.accept_item, options.ascii_names)
    return good.select("segment_id.group_id", "segment_id.segment_no", "item", "pos"), doubtful.select("segment_id.group_id", "segment_id.segment_no", "raw", "candidates")


def numbered(found: DataFrame, by: str = "group_id") -> DataFrame:
    """Segments with ``global_no``, a running number over all groups."""
    return segments.number_segments(found, by)


def named(found: DataFrame, options: Options, decided: dict[int, str] | None = None) -> DataFrame:
    """``found`` (``global_no``, ``candidates``) with ``entity``: the best candidate if it is sure enough or nobody is asked, what a person decided, else
    null; and ``review`` for those that wait for a decision.
    """
    top = F.when(F.size("candidates") > 0, F.element_at("candidates", 1))
    scored = found.withColumns({"top_name": top["name"], "top_score": top["score"]})
    out = votes.choose_entity(scored, options.auto_entity, options.no_prompt)
    if decided:
        of = F.element_at(F.create_map(*(F.lit(x) for k, v in decided.items() for x in (int(k), v))), F.col("global_no").cast("int"))
        out = out.withColumns({"name": F.coalesce(of, "name"), "review": F.col("review") & of.isNull()})
    return out.withColumn("entity", F.nullif("name", F.lit(merge.UNKNOWN))).drop("name", "top_name", "top_score")


def with_decided(good: DataFrame, doubtful: DataFrame, decided: dict[str, str]) -> DataFrame:
    """Accepted items, and behind them those that a person chose for doubtful names; an item once by segment."""
    if not decided:
        return good
    chosen = F.element_at(F.create_map(*(F.lit(x) for kv in decided.items() for x in kv)), F.col("raw"))
    more = doubtful.withColumn("item", chosen).filter("item is not null").select("group_id", "segment_no", F.struct(F.lit(1).alias("late"), F.lit(0).alias("pos"), "raw").alias("place"), "item")
    all_ = good.select("group_id", "segment_no", F.struct(F.lit(0).alias("late"), "pos", F.lit("").alias("raw")).alias("place"), "item").unionByName(more)
    return votes.ordered_distinct(all_, ["group_id", "segment_no"], "item", ["place"])


def review_queue(found: DataFrame, doubtful: DataFrame) -> DataFrame:
    """What a person should decide: ``kind`` (segment or item), ``global_no``, ``detail_ts``, ``raw``, ``choices`` as reports write them."""
    shown = lambda c: F.transform(c, lambda x: text.shown(x["name"], x["score"]))
    ask = found.filter("review").select(F.lit("segment").alias("kind"), "global_no", "detail_ts", F.lit(None).cast("string").alias("raw"), shown("candidates").alias("choices"))
    where = found.select("group_id", "segment_no", "global_no", "detail_ts")
    items = doubtful.join(where, ["group_id", "segment_no"]).select(F.lit("item").alias("kind"), "global_no", "detail_ts", "raw", shown("candidates").alias("choices"))
    return ask.unionByName(items)


def results(found: DataFrame, good: DataFrame, options: Options) -> DataFrame:
    """Merged lists: ``entity``, ``items``, ``merged``, ``seg_no``; segments without items, or without list frames, still name their entity."""
    found = found if "global_no" in found.columns else numbered(found)
    chosen = segments.select_segments(found, options.only)
    lists = good.groupBy("group_id", "segment_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda s: s["item"]).alias("items"))
    each = segments.with_lists(chosen, lists).select(F.col("global_no").alias("seg_no"), F.coalesce("entity", F.lit(merge.UNKNOWN)).alias("name"), "items")
    return merge.containment_merge(each, options.coverage)


def run(frames: DataFrame, box_reads: DataFrame, observations: DataFrame, entities: DataFrame, items: DataFrame, options: Options) -> DataFrame:
    """Both phases over observations that readers made before."""
    found = index(frames, box_reads, entities, options)
    return results(found, collect(found, frames, observations, items, options)[0], options)


def stored_segments(stored: DataFrame) -> DataFrame:
    """Segments of a stored index (``files.read_index``) as the phases have them: ``group_id`` is the place and resolution of the group."""
    group = F.concat_ws("x", F.col("group_no").cast("string"), *(F.element_at("resolution", k).cast("string") for k in (1, 2)))
    return stored.select(group.alias("group_id"), "group_no", F.col("seg_no").cast("int").alias("segment_no"), "candidates", "detail_ts", "list_start", "list_end", F.col("list_frames").cast("long").alias("list_frames"))


def recollect(stored: DataFrame, frames: DataFrame, observations: DataFrame, items: DataFrame, options: Options) -> DataFrame:
    """Phase two from a stored index, without phase one. The rate that the index was made with sets the margins."""
    rate = stored.select("index_fps").first()
    found = named(numbered(stored_segments(stored), "group_no"), options)
    if rate:
        options = replace(options, index_fps=rate[0])
    return results(found, collect(found, frames, observations, items, options)[0], options)
