import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators.segments import segments
from chronofold.sources import files, frames
from chronofold.streaming.segmenter import late_of, segment_stream, segments_of, write_increments


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_dimensions(spark, tmp_path):
    items = files.read_items(spark, put(tmp_path / "i.json", [{"id": 1, "name": "あ", "type": "x", "pp": 5}]))
    assert [tuple(r) for r in items.collect()] == [(1, "あ", "x", 5)]
    assert [tuple(r) for r in files.read_entities(spark, put(tmp_path / "e.json", ["b", "a"])).collect()] == [(1, "b"), (2, "a")]
    with pytest.raises(FileNotFoundError):
        files.read_items(spark, str(tmp_path / "none.json"))
    with pytest.raises(Exception, match="not an array"):
        files.read_entities(spark, put(tmp_path / "bad.json", {"a": 1})).collect()
    assert json.loads(files.items_json(items).first()[0]) == [{"id": 1, "name": "あ", "type": "x", "pp": 5}]


def test_results_round_trip(spark, tmp_path):
    a, b = put(tmp_path / "a.json", {"Z": ["x", "y"], "A": []}), put(tmp_path / "b.json", {"Z": ["q"]})
    rows = files.read_results(spark, [a, b])
    assert {(r["file_ord"], r["entity"], r["pos"], r["item"]) for r in rows.collect()} == {(0, "Z", 0, "x"), (0, "Z", 1, "y"), (1, "Z", 0, "q")}
    one = files.result_json(rows.filter("file_ord = 0"))
    files.write_json(one, str(tmp_path / "out"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect())
    assert text == json.dumps({"Z": ["x", "y"]}, indent=2) + "\n"
    assert {r[0] for r in files.read_collected(spark, put(tmp_path / "c.jsonl", '{"p": 1}\n{"q": {"x": 2}, "r": []}\n')).collect()} == {"p", "q", "r"}
    assert files.read_collected(spark, str(tmp_path / "no.jsonl")).count() == 0


def test_index_round_trip(spark, tmp_path):
    dim = spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string")
    seg = spark.createDataFrame([(0, ["v"], [1280, 720], 1, [(2, "two", 0.9), (9, "gone", 0.8)], 1.0, 2.0, 3.0, 4), (0, ["v"], [1280, 720], 2, [], None, 5.0, 6.0, 1)], f"group_no int, videos array<string>, resolution array<int>, seg_no int, candidates {files.CANDIDATES}, detail_ts double, list_start double, list_end double, list_frames int")
    path = files.sidecar(str(tmp_path / "out.json"))
    put(__import__("pathlib").Path(path), files.index_json(seg, 5.0).first()[0])
    got = files.read_index(spark, path, dim).orderBy("seg_no").collect()
    assert [(r["index_fps"], r["seg_no"], [c["name"] for c in r["candidates"]], r["detail_ts"], r["list_frames"]) for r in got] == [(5.0, 1, ["two"], 1.0, 4), (5.0, 2, [], None, 1)]


def test_index_by_lines(spark, tmp_path):
    """An index is written and read by its lines, in several tasks: the JSON is that of one row, numbers go beyond an int, groups go by place."""
    big = 3 << 40
    seg = spark.range(4000).repartition(3).select(
        (F.col("id") % 3 * 5).cast("int").alias("group_no"), F.array(F.concat(F.lit("あ\n,]"), F.col("id") % 3)).alias("videos"), F.array(F.lit(4), (F.col("id") % 3).cast("int")).alias("resolution"), (F.col("id") + big).alias("seg_no"),
        F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit(7).alias("id"), F.lit("x],").alias("name"), F.lit(0.5).alias("score")))).otherwise(F.array()).cast(files.CANDIDATES).alias("candidates"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 2).alias("detail_ts"), F.lit(1.0).alias("list_start"), F.lit(2.0).alias("list_end"), F.lit(3).alias("list_frames"),
    )
    path, none = str(tmp_path / "index.json"), str(tmp_path / "none.json")
    files.write_index(seg, 5, path)
    assert json.loads(open(path).read()) == json.loads(files.index_json(seg, 5.0).first()[0])
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = files.read_index(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        got = sorted(tuple(r) for r in read.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    names = files.read_index(spark, path, spark.createDataFrame([(7, "own")], "id int, name string")).groupBy(F.get("candidates", F.lit(0))["name"].alias("name")).count()
    assert dict(map(tuple, names.collect())) == {"own": 2000, None: 2000}
    whole = files.read_index(spark, put(tmp_path / "whole.json", files.index_json(seg, 5.0).first()[0]))
    assert read.dtypes == whole.dtypes and got == sorted(tuple(r) for r in whole.collect()) and len(got) == 4000
    files.write_index(seg.limit(0), 5.0, none)
    assert json.loads(open(none).read()) == {"index_fps": 5.0, "groups": []} and files.read_index(spark, none).count() == 0


def test_editions(spark, tmp_path):
    for gen, body in {"New": {"g": {"a": {"type": "t2", "pp": "7"}, "junk": "s"}, "other": "text"}, "Old": {"g": {"a": {"type": "t1", "pp": "x"}}}}.items():
        (tmp_path / gen).mkdir()
        put(tmp_path / gen / "l.json", {"waza_list": body})
    rows = files.read_editions(spark, f"{tmp_path}/*/l.json", ["Old", "New"])
    assert {(r["name"], r["rank"], r["type"], r["pp"]) for r in rows.collect()} == {("a", 1, "t2", 7), ("a", 0, "t1", 0), ("junk", 1, None, None)}


def test_frame_source(spark, tmp_path):
    for k, n in enumerate((50, 40)):
        np.save(tmp_path / f"{k}.npy", np.full((n, 4, 6, 3), k, np.uint8))
    spark.dataSource.register(frames.FrameSource)
    paths = f"{tmp_path}/0.npy,{tmp_path}/1.npy"
    df = spark.read.format("frames").options(paths=paths, group="g", fps=10, src_fps=20, start=1.0, end=3.0, slice=15).load()
    got = sorted((r["video_seq"], r["frame_idx"], r["ts"]) for r in df.collect())
    assert got == [(0, k, k / 20) for k in range(20, 50, 2)] + [(1, k, 2.5 + k / 20) for k in range(0, 10, 2)]
    assert frames.pictures(df).first()["png"][:4] == b"\x89PNG"
    np.save(tmp_path / "bad.npy", np.zeros((3, 0, 0, 3), np.uint8))
    with pytest.raises(ValueError):
        frames.probe(str(tmp_path / "bad.npy"))


def test_stream_gives_the_batch_segments(spark, small, tmp_path):
    from chronofold.plans.catalog import frames as event_frames

    f = event_frames(spark, small).filter("cast(group_id as long) < 20").select("group_id", "ts", "ord", "kind", "box")
    rows = f.orderBy("ts", "ord").toPandas()
    ends = rows.groupby("group_id", as_index=False).ts.max().assign(ord=10**9, kind="end", box=None)
    parts = [rows.iloc[: len(rows) // 2], rows.iloc[len(rows) // 2 :], ends[["group_id", "ts", "ord", "kind", "box"]]]
    src = tmp_path / "src"
    for k, p in enumerate(parts):
        spark.createDataFrame(p.astype(object).where(p.notna(), None), f.schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        write_increments(segment_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    cols = ["group_id", "segment_no", "entity", "detail_ts", "list_start", "list_end", "list_frames"]
    want = sorted(map(tuple, segments(f).select(*cols).collect()), key=str)
    assert sorted(map(tuple, segments_of(spark, str(tmp_path / "out")).select(*cols).collect()), key=str) == want
    assert late_of(spark, str(tmp_path / "out")).count() == 0


def test_filters_reach_the_frames(spark, tmp_path, monkeypatch):
    """Slices that a query's filters rule out aren't opened; the rows are those of filtering all frames."""
    import numpy as np

    for k in range(3):
        np.save(tmp_path / f"{k}.npy", np.full((40, 2, 2, 3), k, np.uint8))
    paths = ",".join(str(tmp_path / f"{k}.npy") for k in range(3))
    read = lambda push: frames.read_frames(spark, push, paths=paths, fps="10", src_fps="10", slice="10")
    shared = read(False)
    for where, slices in (("ts >= 4.5 and ts < 6.0", 2), ("video_seq = 1", 4), ("video_seq in (0, 2) and frame_idx < 10", 2), ("ts > 100", 1), ("frame_idx >= 25 and video_seq > 1", 2), ("ts = 0.3", 1), ("pmod(frame_idx, 2) = 1 or ts < 1", 12), ("video_seq <> 1", 12)):
        got = read(True).filter(where).select("video_seq", "frame_idx", "ts")
        want = [(k, i, (40 * k + i) / 10) for k in range(3) for i in range(40)]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spark.createDataFrame(want, "video_seq int, frame_idx long, ts double").filter(where).collect())), where
        assert got.rdd.getNumPartitions() == slices, where
        assert shared.filter(where).count() == got.count()  # without it, a DataFrame may be used again


def test_many_ranges(tmp_path):
    """A frame's and a slice's range is found by one search, whatever the number of ranges and their order."""
    spans = [(float(k), k + 0.5) for k in range(0, 2000, 2)] + [(5.25, 7.5), (100.0, 100.0)]
    reader = frames.FrameReader({"ranges": ",".join(f"{a}:{z}" for a, z in reversed(spans)), "start": "3"})
    for ts in [k / 8 for k in range(0, 17_000, 3)]:
        assert reader.inside(ts) == (ts >= 3 and any(a <= ts < z for a, z in spans)), ts
        assert reader.wanted(ts, ts + 0.75) == (ts + 0.75 > 3 and any(ts + 0.75 > a and ts < z for a, z in reader.ranges)), ts


def test_a_stream_of_frames(spark, tmp_path):
    """New files and new frames of the last file are picked up from the checkpoint on, each once, on one timeline."""
    import numpy as np

    spark.dataSource.register(frames.FrameSource)
    folder = tmp_path / "in"
    folder.mkdir()

    def save(name, n):
        np.save(tmp_path / "new.npy", np.full((n, 2, 2, 3), 1, np.uint8))
        (tmp_path / "new.npy").rename(folder / name)

    def seen():
        stream = spark.readStream.format("frames").options(folder=str(folder), fps="10", src_fps="10", slice="4", per_trigger="7").load().select("video_seq", "frame_idx", F.round("ts", 6).alias("ts"))
        stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
        return sorted(map(tuple, spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()))

    want = lambda *sizes: [(k, i, (sum(sizes[:k]) + i) / 10) for k, n in enumerate(sizes) for i in range(n)]
    save("a.npy", 5)
    assert seen() == want(5)
    save("b.npy", 6)
    assert seen() == want(5, 6)
    save("b.npy", 9)
    assert seen() == want(5, 9)
    save("c.npy", 20)
    got = [len(seen()) for _ in range(3)]
    assert got == [21, 28, 34] and seen() == want(5, 9, 20)


def streamed(spark, folder, batches, **how):
    """Each batch of (group, ts, kind, box) as one file and one run of the stream: it goes on from its checkpoint every time."""
    out = str(folder / "out")
    for rows in batches:
        df = spark.createDataFrame([(g, float(ts), int(ts * 10), kind, box) for g, ts, kind, box in rows], "group_id string, ts double, ord long, kind string, box string")
        df.coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(folder / "in"))
        write_increments(segment_stream(stream, **how), out, str(folder / "ck")).awaitTermination()
    found = sorted((tuple(r)[:3] + (r["list_start"], r["list_end"], r["list_frames"]) for r in segments_of(spark, out).collect()), key=str)
    return found, sorted((r["group_id"], r["ts"], r["kind"]) for r in late_of(spark, out).collect())


def test_late_frames_go_aside(spark, tmp_path):
    """Frames at or before the last folded one come out as late; the stream is restarted between batches."""
    found, late = streamed(spark, tmp_path, [
        [("g", 2.0, "move_list", None), ("g", 1.0, "other", "A"), ("g", 1.5, "detail", None)],
        [("g", 1.7, "move_list", None), ("g", 3.0, "move_list", None), ("g", 4.0, "detail", None), ("h", 0.5, "move_list", None)],
        [("g", 5.0, "move_list", None), ("g", 5.5, "end", None)],
        [("g", 1.0, "move_list", None), ("g", 2.0, "end", None)],
    ])
    assert sorted(found, key=str) == [("g", 1, "A", 2.0, 3.0, 2), ("g", 1, None, 1.0, 1.0, 1), ("g", 2, None, 5.0, 5.0, 1)] and late == [("g", 1.7, "move_list")]


def test_frames_may_wait_for_earlier_ones(spark, tmp_path):
    """With ``wait``, frames out of order by less than that are folded in order and none is late."""
    frames = [("g", 1.0, "other", "A"), ("g", 2.0, "detail", None), ("g", 3.0, "move_list", None), ("g", 4.0, "move_list", None), ("g", 5.0, "detail", None), ("g", 6.0, "move_list", None), ("g", 7.0, "end", None)]
    shuffled = [[frames[1], frames[0]], [frames[3]], [frames[2], frames[5]], [frames[4]], [frames[6]]]
    found, late = streamed(spark, tmp_path, shuffled, wait=3.0)
    assert found == [("g", 1, "A", 3.0, 4.0, 2), ("g", 2, None, 6.0, 6.0, 1)] and late == []


def test_idle_groups_close_by_event_time(spark, tmp_path):
    """A group without frames for ``idle`` seconds of event time is closed once the watermark is past that, and begins anew."""
    found, _ = streamed(spark, tmp_path, [[("g", 10.0, "move_list", None)], [("h", 500.0, "move_list", None)], [("h", 501.0, "move_list", None)], [("g", 502.0, "move_list", None), ("g", 503.0, "end", None)]], idle=60.0, forget="1 second")
    assert [f for f in found if f[0] == "g"] == [("g", 1, None, 10.0, 10.0, 1), ("g", 1, None, 502.0, 502.0, 1)]


def test_a_stream_goes_on_behind_a_stored_index(spark, tmp_path):
    stored = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 9.0), ("x", 7, 3.0)], "group_id string, segment_no int, list_end double")
    found, late = streamed(spark, tmp_path, [[("g", 8.0, "move_list", None), ("g", 10.0, "move_list", None), ("g", 11.0, "end", None), ("n", 1.0, "move_list", None), ("n", 2.0, "end", None)]], stored=stored)
    assert found == [("g", 3, None, 10.0, 10.0, 1), ("n", 1, None, 1.0, 1.0, 1)] and late == [("g", 8.0, "move_list")]


def test_corners(spark):
    df = spark.createDataFrame([(1, 0, 0, "t", 0.5, [{"x": k, "y": k} for k in range(4)])], "frame_id int, box_no int, frag_no int, text string, confidence double, box array<struct<x:int,y:int>>")
    r = files.text_corners(df).select(F.col("first_corner.x").alias("a"), F.col("third_corner.x").alias("b")).first()
    assert tuple(r) == (0, 2)


def test_offline_jobs(spark, tmp_path):
    from chronofold.functions.text import ALLOWED
    from chronofold.plans import offline

    for gen, body in {"New": {"g": {"あ い": {"type": "t2", "pp": "7"}}}, "Old": {"g": {"あい": {"type": "t1", "pp": "5"}}}}.items():
        (tmp_path / gen).mkdir()
        put(tmp_path / gen / "l.json", {"waza_list": body})
    items = offline.build_items(spark, f"{tmp_path}/*/l.json", ["Old", "New"], [("z", "t", 1), ("あ い", "no", 0)])
    assert [tuple(r) for r in items.orderBy("id").collect()] == [(1, "z", "t", 1), (2, "あ い", "t2", 7)]
    a = put(tmp_path / "a.json", {"Z": ["x"], "(unknown 1)": ["q"], "Y": ["y"]})
    merged, new = offline.merge_results(spark, [a], put(tmp_path / "c.jsonl", '{"Z": 1}\n'))
    assert {r["entity"] for r in merged.collect()} == {"Z", "Y"} and {r["entity"] for r in new.collect()} == {"Y"}
    diff = offline.compare_names(spark, put(tmp_path / "l.json", ["a", "b"]), put(tmp_path / "r.json", ["b", "c"]))
    assert {tuple(r) for r in diff.collect()} == {("a", "left"), ("c", "right")}
    df, seen = offline.observed(items, "items")
    assert not offline.character_report(df, ALLOWED).filter("char = 'z'").first()["allowed"] and seen.get["rows"] == 2


def test_run_from_a_stored_index(spark, tmp_path):
    from chronofold.cli import parser
    from chronofold.options import Options
    from chronofold.plans import recording

    seg = spark.createDataFrame([(0, ["v"], [1280, 720], 1, [(1, "one", 0.9)], 1.0, 2.0, 3.0, 2), (0, ["v"], [1280, 720], 2, [], None, 5.0, 5.0, 1)], f"group_no int, videos array<string>, resolution array<int>, seg_no int, candidates {files.CANDIDATES}, detail_ts double, list_start double, list_end double, list_frames int")
    path = put(tmp_path / "index.json", files.index_json(seg, 4.0).first()[0])
    dim = spark.createDataFrame([(1, "one")], "id int, name string")
    f = [("0x1280x720", float(k), k, "move_list" if k in (2, 3, 5) else "other", [k * 50], [k * 50], [0], 99.0) for k in range(7)]
    frames_ = spark.createDataFrame(f, "group_id string, ts double, ord int, read_kind string, header_thumb array<int>, slot_thumb array<int>, box_thumb array<int>, mean_luma double")
    obs = spark.createDataFrame([("0x1280x720", 2, 0, "alpha", None), ("0x1280x720", 5, 0, "gamma", None)], "group_id string, ord int, row_no int, raw string, observed_type string")
    items = spark.createDataFrame([(1, "alpha", "x", 1), (2, "gamma", "y", 1)], "id int, name string, type string, pp int")
    got = recording.recollect(files.read_index(spark, path, dim), frames_, obs, items, Options(ascii_names=True)).collect()
    assert {(r["entity"], tuple(r["items"])) for r in got} == {("one", ("alpha",)), ("(unknown 2)", ("gamma",))}
    only = recording.recollect(files.read_index(spark, path, dim), frames_, obs, items, Options(ascii_names=True, only="one, 9")).collect()
    assert [r["entity"] for r in only] == ["one"]
    with pytest.raises(SystemExit):
        parser().parse_args(["--fps", "x"])
