"""Scans in slots against windows over whole groups: a group of all rows is many tasks' and has the same rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.operators import scan, segments, timeline


@pytest.fixture(scope="module")
def frames(spark):
    """One long recording, a short one, one of a single frame and one without a name; ties, gaps, nulls and times that are none."""
    rng = random.Random(6)
    rows, ts = [], -50.0
    for k in range(1500):
        ts += rng.choice([0.0, 0.2, 0.2, 0.2, 3.0, 40.0])
        kind = rng.choice(["detail", "move_list", "other", "other", None])
        thumb = lambda: rng.choice([[1, 2], [1, 2], [2, 2], [90, 3], [5], None])
        rows.append((rng.choice(["long"] * 30 + ["short", None]), ts, k, kind, rng.choice(["A", "B", None, None]), thumb(), thumb(), thumb(), rng.choice([10.0, 80.0, None])))
    rows += [("single", 5.0, 0, "detail", None, [1], None, None, 50.0), ("long", None, -1, "detail", "C", [1, 2], [1, 2], None, 50.0), ("long", float("nan"), 9000, "move_list", None, [1, 2], [1, 2], None, 50.0), ("long", float("inf"), 9001, "move_list", None, [7, 2], [1, 2], None, 50.0)]
    return spark.createDataFrame(rows, "group_id string, ts double, ord long, kind string, box string, header_thumb array<int>, slot_thumb array<int>, box_thumb array<int>, mean_luma double").repartition(4).cache()


@pytest.mark.parametrize("slot", [0.3, 7.0, 1e9])
def test_scans(frames, slot):
    order = ["ts", "ord"]
    got = scan.scan(scan.keyed(frames, scan.time_slot(F.col("ts"), slot)), order, before={"b": F.col("kind"), "t": F.col("header_thumb")}, last={"l": F.col("box")}, total={"n": F.lit(1), "s": F.col("mean_luma")})
    w = Window.partitionBy("group_id").orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    want = frames.withColumns({"b": F.lag("kind").over(w), "t": F.lag("header_thumb").over(w), "l": F.last("box", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.coalesce(F.sum(F.lit(1)).over(past), F.lit(0)), "s": F.coalesce(F.sum("mean_luma").over(past), F.lit(0.0))})
    assert sorted(map(str, got.drop(scan.KEY).select(want.columns).collect())) == sorted(map(str, want.collect()))


def _whole(read, frames):
    """The same by windows over whole groups."""
    w = Window.partitionBy("group_id").orderBy("ts", "ord")
    same = timeline.similar(F.col("header_thumb"), F.lag("header_thumb").over(w))
    kinds = read.withColumn("same", same).withColumn("kind", F.last(F.when(~F.col("same"), F.col("read_kind")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("same")
    before = F.lag("kind").over(w)
    still = (before == "move_list") & timeline.similar(F.col("slot_thumb"), F.lag("slot_thumb").over(w))
    bright = (F.col("kind") == "other") & (F.col("mean_luma") > 40)
    was_bright = F.coalesce((before == "other") & (F.lag("mean_luma").over(w) > 40), F.lit(False))
    box = bright & ~(was_bright & timeline.similar(F.col("box_thumb"), F.lag("box_thumb").over(w)))
    return read.withColumn("changed", ~same), kinds, frames.withColumns({"vote": (F.col("kind") == "move_list") & ~F.coalesce(still, F.lit(False)), "box_read": box})


@pytest.mark.parametrize("slot", [0.3, 25.0])
def test_timeline(frames, slot):
    read = frames.withColumn("read_kind", F.col("kind")).drop("kind")
    changed, kinds, marked = _whole(read, frames)
    same = lambda a, b: sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))
    assert same(timeline.changed_headers(read, slot), changed)
    assert same(timeline.carry_kind(read, slot), kinds)
    assert same(timeline.to_read(frames, slot), marked)
    assert same(segments.segments(frames, slot), segments.segments(frames, 1e12))


def test_files_and_frame_numbers(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, v, k) for g in ("a", "b") for v in range(40) for k in range(0, rng.randint(0, 30), 2)]
    df = spark.createDataFrame(rows, "group_id string, video_seq int, frame_idx long")
    monkeypatch.setattr(timeline, "FRAMES", 8)
    want = [(*r, i) for g in ("a", "b") for i, r in enumerate(sorted(x for x in rows if x[0] == g))]
    for files in (1, 7):
        assert sorted(map(tuple, timeline.number_frames(df, files).collect())) == want
    monkeypatch.setattr(timeline, "FILES", 8)
    videos = spark.createDataFrame([("a", k, 10 * k, 25.0) for k in range(40)], "group_id string, video_seq int, frame_count int, src_fps double")
    assert [round(r["offset"], 6) for r in timeline.offsets(videos).orderBy("video_seq").collect()] == [round(sum(10 * j for j in range(k)) / 25, 6) for k in range(40)]


def test_a_long_group_is_many_tasks(spark, small):
    """All events as one recording: its rows are dealt by slot, and kinds are those of the whole."""
    from chronofold.plans import catalog

    f = catalog._thumbs(spark, small).withColumn("group_id", F.lit("one"))
    slot = 86_400.0
    dealt = scan.keyed(f, scan.time_slot(F.col("ts"), slot)).repartition(8, scan.KEY).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 6 and max(r["count"] for r in dealt) < 0.5 * f.count()
    assert sorted(map(str, timeline.carry_kind(f, slot).collect())) == sorted(map(str, timeline.carry_kind(f, 1e12).collect()))
