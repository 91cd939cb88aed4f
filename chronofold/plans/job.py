"""The two phases over video files, with what they leave behind: the index of segments, results after each step, and a queue for review."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import select_segments, unknown_tokens
from ..options import Options
from ..sources import files, frames
from . import recording, video
from .offline import observed

#: What a step leaves, as one table: accepted items, doubtful names, the segments that are done, and templates of headers.
STEP = f"kind string, group_id string, segment_no int, pos int, item string, raw string, candidates {files.CANDIDATES}, global_no long, ts double, screen string, thumb array<int>"
#: Steps of a group at most, however many segments it has; time ranges that a step asks for at most.
MOST_STEPS, MOST_RANGES = 64, 4096


def groups_of(spark: SparkSession, paths: list[str], rates: str = "") -> list[dict]:
    """The files by resolution, in order of first sight: ``group_no``, ``width``, ``height``, ``videos`` (rows of ``frames.VIDEOS``)."""
    out: dict[tuple[int, int], list[dict]] = {}
    for v in frames.probed(paths, rates):
        out.setdefault((v["width"], v["height"]), []).append(v)
    return [{"group_no": k, "width": w, "height": h, "videos": vs} for k, ((w, h), vs) in enumerate(out.items())]


def group_id(group: dict) -> str:
    return f"{group['group_no']}x{group['width']}x{group['height']}"


def index(spark: SparkSession, groups: list[dict], entities: DataFrame, options: Options, path: str, store: str, say: Callable[[str], None] = print) -> None:
    """Phase one: finds the segments of each group and writes the index to ``path``, and the templates that headers teach to ``store``."""
    parts = taught = None
    for g in groups:
        pictures = video.frames_of(spark, g["videos"], options.index_fps, options, group_id(g))
        found, known = video.index(pictures, entities, options)
        videos, size = F.array(*(F.lit(v["path"]) for v in g["videos"])), F.array(F.lit(g["width"]), F.lit(g["height"]))
        rows = found.select(F.lit(g["group_no"]).alias("group_no"), videos.alias("videos"), size.alias("resolution"), F.col("segment_no").cast("int").alias("seg_no"), "candidates", "detail_ts", "list_start", "list_end", F.col("list_frames").cast("int").alias("list_frames"))
        parts = rows if parts is None else parts.unionByName(rows)
        new = video.learnt(known, templates(spark, store))
        taught = new if taught is None else taught.unionByName(new)
        say(f"index: {len(g['videos'])} file(s) of {g['width']}x{g['height']} at {options.index_fps:g} frames a second")
    counted, seen = observed(parts, "segments")
    files.write_index(counted, options.index_fps, path)
    commit(spark, store, "index", as_step("template", taught))
    say(f"wrote {path}: {seen.get['rows']} segment(s)")


def as_step(kind: str, rows: DataFrame) -> DataFrame:
    if kind == "template":
        rows = rows.withColumnRenamed("kind", "screen")
    return rows.withColumn("kind", F.lit(kind))


def commit(spark: SparkSession, store: str, step: str, rows: DataFrame) -> None:
    """All that a step leaves, or nothing: it is written under a name that readers don't see and then renamed."""
    hidden = f"{store}/_{step}"
    empty = spark.createDataFrame([], STEP)
    empty.unionByName(rows, allowMissingColumns=True).write.mode("overwrite").parquet(hidden)
    files.rename(spark, hidden, f"{store}/step={step}")


def stored(spark: SparkSession, store: str, kind: str) -> DataFrame:
    """What the steps so far have left of one kind."""
    rows = spark.read.schema(STEP).parquet(f"{store}/step=*") if files.matches(spark, f"{store}/step=*") else spark.createDataFrame([], STEP)
    return rows.filter(F.col("kind") == kind)


def templates(spark: SparkSession, store: str) -> DataFrame:
    return stored(spark, store, "template").select("group_id", "ts", F.col("screen").alias("kind"), "thumb")


def _ranges(some: DataFrame, margin: float) -> list[tuple[float, float]]:
    """The seconds that segments need, joined to at most ``MOST_RANGES`` ranges: the time between is cut into as many slots, and slots that segments touch count whole."""
    lo, hi = F.greatest(F.lit(0.0), F.col("list_start") - margin), F.col("list_end") + margin
    first, last = some.agg(F.min(lo), F.max(hi)).first()
    slot = max((last - first) / MOST_RANGES, 1e-6)
    at = lambda c: F.floor((c - first) / slot)
    touched = sorted(r[0] for r in some.select(F.explode(F.sequence(at(lo), at(hi))).alias("s")).distinct().collect())
    out: list[list[float]] = []
    for s in touched:
        if out and out[-1][1] == s:
            out[-1][1] = s + 1
        else:
            out.append([s, s + 1])
    return [(first + a * slot, first + z * slot) for a, z in out]


def collect(spark: SparkSession, groups: list[dict], found: DataFrame, items: DataFrame, options: Options, store: str, every: int, resume: bool, say: Callable[[str], None] = print) -> Iterator[None]:
    """Phase two in steps of ``every`` segments, or of more where a group would need more than ``MOST_STEPS``. Each step is one plan over all its
    segments, and one commit to ``store``. Yields after each.

    Headers like a template aren't read: phase one's templates hold from the beginning, and a step's new ones for the steps after it. With
    ``resume``, segments that ``store`` has already are left out.
    """
    for g in groups:
        own = found.filter((F.col("group_id") == group_id(g)) & F.col("list_start").isNotNull())
        if resume:
            own = own.join(stored(spark, store, "done").select("global_no"), "global_no", "left_anti")
        own = files.kept(own)
        first, last = own.agg(F.min("global_no"), F.max("global_no")).first()
        if first is None:
            continue
        size = max(every, -(-(last - first + 1) // MOST_STEPS))
        place = F.floor((F.col("global_no") - first) / size).alias("place")
        steps = own.groupBy(place).agg(F.min("global_no").alias("a"), F.max("global_no").alias("z")).orderBy("place").collect()  # at most MOST_STEPS
        for s in steps:
            some = own.filter(F.col("global_no").between(s["a"], s["z"]))
            pictures = video.frames_of(spark, g["videos"], options.fps, replace(options, start=None, end=None), group_id(g), _ranges(some, 2.0 / options.index_fps))
            known = templates(spark, store).filter(F.col("group_id") == group_id(g))
            good, doubtful, kinds = video.collect(pictures, some, items, g["width"], g["height"], options, known)
            counted, seen = observed(good.select("group_id", F.col("segment_no").cast("int").alias("segment_no"), F.col("pos").cast("int").alias("pos"), "item"), f"items {s['a']}")
            shown = F.transform("candidates", lambda c: F.struct(c["id"], c["name"], c["score"])).cast(files.CANDIDATES)
            doubtful = doubtful.select("group_id", F.col("segment_no").cast("int").alias("segment_no"), "raw", shown.alias("candidates"))
            parts = {"item": counted, "doubtful": doubtful, "done": some.select("group_id", F.col("global_no").cast("long").alias("global_no")), "template": video.learnt(kinds, known)}
            commit(spark, store, f"{g['group_no']}-{s['a']}-{s['z']}", reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [as_step(k, rows) for k, rows in parts.items()]))
            if options.verbose:
                say(f"collect: segments {s['a']} to {s['z']}, {seen.get['rows']} item(s)")
            yield


def write_results(found: DataFrame, good: DataFrame, options: Options, path: str) -> None:
    """The result file: lists in order of each entity's first segment."""
    files.write_lists(recording.results(found, good, options).select(F.col("seg_no").alias("ent_pos"), "entity", "items"), path)


def write_review(found: DataFrame, doubtful: DataFrame, path: str) -> None:
    queue = recording.review_queue(found, doubtful)
    all_ = F.array_sort(F.collect_list(F.struct("global_no", "kind", "raw", "detail_ts", "choices")))
    files.write_json(queue.groupBy().agg(F.to_json(all_).alias("value")), path)


def decisions(path: str | None) -> tuple[dict[int, str], dict[str, str]]:
    """What a person chose: ``{"segments": {"3": name}, "items": {raw: name}}``."""
    if not path:
        return {}, {}
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    return {int(k): v for k, v in got.get("segments", {}).items()}, dict(got.get("items", {}))


def dump(spark: SparkSession, groups: list[dict], options: Options, folder: str) -> None:
    """The sampled frames as pictures, for debugging; ``folder`` must be one that all executors see."""

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, r["name"]), "wb") as f:
                f.write(r["png"])

    for g in groups:
        frames.pictures(video.frames_of(spark, g["videos"], options.fps, options, group_id(g))).foreachPartition(write)


def run(spark: SparkSession, paths: list[str], items: DataFrame, entities: DataFrame, options: Options, output: str, segments: str | None = None, rates: str = "", every: int = 16, resume: bool = False, decided: str | None = None, frames_dir: str | None = None, say: Callable[[str], None] = print) -> None:
    """Both phases, or the second alone from a stored index (``segments``); writes ``output``, its index beside it, and what awaits review."""
    groups = groups_of(spark, paths, rates)
    if frames_dir:
        dump(spark, groups, options, frames_dir)
    at, store = segments or files.sidecar(output), f"{output}.collected"
    if not resume:
        files.remove(spark, store)
    if segments is None:
        index(spark, groups, entities, options, at, store, say)
    known = files.read_index(spark, at, entities)
    rate = known.select("index_fps").first()
    options = replace(options, index_fps=rate[0]) if rate else options
    by_segment, by_raw = decisions(decided)
    found = recording.named(recording.numbered(recording.stored_segments(known), "group_no"), options, by_segment).persist()
    say(f"{found.count()} segment(s)")
    if options.only:
        for token in unknown_tokens(found, options.only):
            say(f"no segment is called {token!r}")
    chosen = select_segments(found, options.only)
    files.write_text(spark, output, "{}\n")
    parts = lambda: (stored(spark, store, "item").select("group_id", "segment_no", "pos", "item"), stored(spark, store, "doubtful").select("group_id", "segment_no", "raw", "candidates"))
    for _ in collect(spark, groups, chosen, items, options, store, every, resume, say):
        write_results(found, recording.with_decided(*parts(), by_raw), options, output)
    good, doubtful = parts()
    write_results(found, recording.with_decided(good, doubtful, by_raw), options, output)
    if not options.no_prompt:
        write_review(chosen, doubtful.filter(~F.col("raw").isin(list(by_raw))), f"{output}.review.json")
        say(f"wrote {output}.review.json")
    say(f"wrote {output}")
