"""From stacks of frames to result files, with a reader that decodes what the frames were painted with."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold import cli
from chronofold.functions import recognize
from chronofold.operators import nearest, timeline
from chronofold.options import Options
from chronofold.plans import job, video
from chronofold.sources import files, frames

WIDTH, HEIGHT = 320, 180
AT = timeline.resolved(WIDTH, HEIGHT)
HEADERS = {130: "教える技", 140: "能力", 150: "設定"}
NAMES = ["alpha", "gamma", "delta", "omega"]
ENTITIES = ["ロトム", "ミミロップ"]


class Painted:
    """Reads the grey levels that ``paint`` writes."""

    def recognize_batch(self, images, boxes, allowed=None):
        return [[self._row(recognize.crop(i, b)) for b in bs] for i, bs in zip(images, boxes, strict=True)]

    def _row(self, part):
        code = (int(part[6, 50, 0]) - 125) // 30
        return [(NAMES[code], 0.9, [])] if 0 <= code < len(NAMES) else []

    def read_line(self, image, box):
        x, y, w, h = box
        return [(HEADERS[int(image[y + h // 2, x + w // 2, 0])], 0.9, [])]

    def read_texts(self, image, box, factor):
        x, y, w, h = box
        code = int(image[y + h // 2, x + w // 2, 0]) - 160
        return [(ENTITIES[code // 10], 0.9, [])] if code in (0, 10) else []


def paint(header, rows=(), box=90):
    image = np.full((HEIGHT, WIDTH, 3), 90, np.uint8)
    for region, value in (("header", header), ("box_name", box)):
        x, y, w, h = AT[region]
        image[y : y + h, x : x + w] = value
    x, w, h = AT["move_slot_x"], AT["move_slot_w"], AT["move_slot_h"]
    ys = AT["move_slot_ys"]
    image[ys[0] - 5 : ys[-1] + h + 5, x : x + w] = 200
    for k, name in enumerate(rows):
        centre = ys[0] + k * (ys[1] - ys[0]) + h // 2
        image[centre - 2 : centre + 3, x : x + 20] = 10
        image[centre - 6 : centre + 7, x + 45 : x + 55] = 125 + 30 * NAMES.index(name)
        image[centre - 4 : centre + 5, AT["type_icon_x"] : AT["type_icon_x"] + 2] = 161
        image[centre, 10:30] = 161
    return image


STACKS = [
    [paint(150, box=160), paint(150, box=160), paint(140), paint(130, ["alpha", "gamma"]), paint(130, ["alpha", "gamma"]), paint(130, ["gamma", "delta"]), paint(140)],
    [paint(130, ["alpha", "gamma", "delta"]), paint(150, box=170), paint(140), paint(130, ["omega"]), paint(130, ["omega", "alpha"])],
]


@pytest.fixture()
def inputs(tmp_path):
    for k, stack in enumerate(STACKS):
        np.save(tmp_path / f"{k}.npy", np.stack(stack))
    items = [{"id": k + 1, "name": n, "type": "ノーマル", "pp": 5} for k, n in enumerate(NAMES)]
    (tmp_path / "items.json").write_text(json.dumps(items, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "entities.json").write_text(json.dumps(ENTITIES, ensure_ascii=False), encoding="utf-8")
    return tmp_path


def call(inputs, *more):
    out = str(inputs / "out.json")
    code = cli.main([str(inputs / "0.npy"), str(inputs / "1.npy"), "-o", out, "--master-dir", str(inputs), "--src-fps", "5", *more], reader=Painted)
    return code, json.loads((inputs / "out.json").read_text(encoding="utf-8")) if code == 0 else None


def test_from_videos_to_results(spark, inputs):
    code, got = call(inputs, "--no-prompt", "--frames-dir", str(inputs / "pictures"), "-v", "--every", "1")
    assert code == 0 and got == {"ロトム": ["alpha", "gamma", "delta"], "ミミロップ": ["omega", "alpha"]}
    assert (inputs / "out.json").read_text(encoding="utf-8") == json.dumps(got, ensure_ascii=False, indent=2) + "\n"
    index = json.loads((inputs / "out.json.segments.json").read_text(encoding="utf-8"))
    assert index["index_fps"] == 5.0 and [[c["name"] for c in s["candidates"]][:1] for s in index["groups"][0]["segments"]] == [["ロトム"], [], ["ミミロップ"]]
    assert len(list((inputs / "pictures").iterdir())) > 5
    # the second phase alone, and some segments only
    assert call(inputs, "--no-prompt", "--segments", str(inputs / "out.json.segments.json"), "--only", "ミミロップ, 9, nobody") == (0, {"ミミロップ": ["omega", "alpha"]})
    assert call(inputs, "--no-prompt", "--segments", str(inputs / "out.json.segments.json"), "--resume") == (0, got)
    assert sorted(r[0] for r in job.stored(spark, str(inputs / "out.json.collected"), "done").select("global_no").collect()) == [1, 2, 3]


def counting(path):
    class Counting(Painted):
        def read_line(self, image, box):
            with open(path, "a") as f:
                f.write("x")
            return super().read_line(image, box)

    return Counting


def test_templates_spare_reads(spark, inputs):
    """Phase one's templates hold in phase two, a step's for the steps after it; results are those of reading all."""
    reads = inputs / "reads"

    def headers(*more):
        reads.write_text("")
        out = str(inputs / "out.json")
        said = [str(inputs / "0.npy"), str(inputs / "1.npy"), "-o", out, "--master-dir", str(inputs), "--src-fps", "5", "--no-prompt", *more]
        assert cli.main(said, reader=counting(str(reads))) == 0
        return len(reads.read_text()), json.loads((inputs / "out.json").read_text(encoding="utf-8"))

    both, got = headers()
    index = str(inputs / "out.json.segments.json")
    cold, same = headers("--segments", index)
    assert got == same == {"ロトム": ["alpha", "gamma", "delta"], "ミミロップ": ["omega", "alpha"]}
    first = both  # phase two read none: each header is like one of phase one
    reads.write_text("")
    known = video.kinds(video.frames_of(spark, [{"path": str(inputs / f"{k}.npy"), "src_fps": 5.0} for k in (0, 1)], 5.0, Options(reader=counting(str(reads))), "g"), Options(reader=counting(str(reads))))
    assert known.filter("was_read").count() == len(reads.read_text()) == first and cold > 0
    steps, same = headers("--segments", index, "--every", "1")
    assert same == got and 0 < steps <= cold
    kept = job.templates(spark, str(inputs / "out.json.collected")).select("kind").distinct().collect()
    assert {"detail", "move_list"} <= {r[0] for r in kept}


def test_templates_of_slots(spark):
    """Templates by slots and then by recording: none nearer than the least distance to another of its kind, every frame near one, at most ``limit``."""
    rng = np.random.default_rng(0)
    rows = [("g", float(k), str(rng.choice(["detail", "move_list", "other"])), [int(x), int(x)]) for k, x in enumerate(rng.integers(0, 60, 400))]
    read = spark.createDataFrame(rows, "group_id string, ts double, kind string, thumb array<int>")
    known = spark.createDataFrame([("g", -1.0, "detail", [30, 30]), ("h", 0.0, "detail", [1, 1])], nearest.TEMPLATES)
    new = [(r["kind"], r["thumb"][0]) for r in nearest.new_templates(read, known, slot=50.0).collect()]
    for kind in ("detail", "move_list", "other"):
        own = sorted([x for k, x in new if k == kind] + [30] * (kind == "detail"))
        assert all(b - a >= 5 for a, b in zip(own, own[1:], strict=False)) and len(own) > 5
        assert all(min(abs(x[0] - t) for t in own) < 10 for _, _, k, x in rows if k == kind)
    assert nearest.new_templates(read, known, limit=2, slot=50.0).groupBy("kind").count().agg(F.max("count")).first()[0] == 2
    assert nearest.new_templates(read.limit(0), known).count() == 0


@pytest.mark.parametrize("when", ["before", "hidden", "renamed"])
def test_a_killed_step_leaves_nothing_or_all(spark, inputs, monkeypatch, when):
    """A run that dies around a commit is resumed to the same files, without repeated rows."""
    real, calls = job.commit, []

    def dies(spark, store, step, rows):
        calls.append(step)
        if len(calls) != 3:
            return real(spark, store, step, rows)
        if when == "hidden":
            monkeypatch.setattr(files, "rename", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        if when != "before":
            real(spark, store, step, rows)
        raise RuntimeError("killed")

    whole = call(inputs, "--no-prompt", "--every", "1")[1]
    index = str(inputs / "out.json.segments.json")
    want = sorted(map(str, job.stored(spark, str(inputs / "out.json.collected"), "item").collect()))
    renames = files.rename
    monkeypatch.setattr(job, "commit", dies)
    assert call(inputs, "--no-prompt", "--every", "1")[0] == 2 and len(calls) == 3
    monkeypatch.setattr(job, "commit", real)
    monkeypatch.setattr(files, "rename", renames)
    assert call(inputs, "--no-prompt", "--every", "1", "--segments", index, "--resume") == (0, whole)
    assert sorted(map(str, job.stored(spark, str(inputs / "out.json.collected"), "item").collect())) == want
    done = [r[0] for r in job.stored(spark, str(inputs / "out.json.collected"), "done").select("global_no").collect()]
    assert sorted(done) == [1, 2, 3]


@pytest.mark.parametrize("most", [500_000, 0])
def test_frames_among_keys(spark, monkeypatch, most):
    """By bits of 64 neighbours, also the highest and negative ones; keys that repeat or that no frame has change nothing."""
    monkeypatch.setattr(video, "MOST_WORDS", most)
    rng = np.random.default_rng(1)
    all_ = [(g, int(o)) for g in ("a", "b") for o in [*range(300), (3 << 40) + 63, (3 << 40) + 64, -1, -64]]
    keys = [all_[k] for k in rng.integers(0, len(all_), 150)] + [("c", 5), ("a", 10**6), ("a", (3 << 40) + 63), ("b", -1), ("b", 63)]
    frames_, asked = (spark.createDataFrame(x, "group_id string, ord long") for x in (all_, keys))
    got = video.among(frames_.withColumn("image", F.lit(b"x")), asked)
    assert got.columns == ["group_id", "ord", "image"]
    assert sorted((r["group_id"], r["ord"]) for r in got.collect()) == sorted(set(all_) & set(keys))


def test_ranges_are_few(spark, monkeypatch):
    monkeypatch.setattr(job, "MOST_RANGES", 8)
    spans = [(float(k), k + 0.25) for k in range(0, 1000, 3)] + [(5000.0, 5001.0)]
    got = job._ranges(spark.createDataFrame(spans, "list_start double, list_end double"), 0.5)
    assert len(got) <= 8 and all(any(a <= max(0, s - 0.5) and e + 0.5 <= z for a, z in got) for s, e in spans)
    assert sum(z - a for a, z in got) < 3000


def test_lists_as_one_file(spark, tmp_path):
    """Many tasks write one file, byte for byte what a dump of the whole gives."""
    lists = [(k, f"n{k} é\n\"", [f"i{j} ü" for j in range(k % 4)]) for k in range(50)]
    df = spark.createDataFrame(lists, "ent_pos long, entity string, items array<string>").repartition(7)
    files.write_lists(df, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text(encoding="utf-8") == json.dumps({e: i for _, e, i in lists}, ensure_ascii=False, indent=2) + "\n"
    files.write_lists(df.limit(0), str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text() == "{}\n"


def test_review(spark, inputs):
    class Unsure(Painted):
        def read_texts(self, image, box, factor):
            return [(t.replace("ロトム", "ロトミ").replace("プ", "フ"), p, c) for t, p, c in super().read_texts(image, box, factor)]

        def _row(self, part):
            return [(t.replace("omega", "oxxgx"), p, c) for t, p, c in super()._row(part)]

    out = str(inputs / "out.json")
    args = [str(inputs / "0.npy"), str(inputs / "1.npy"), "-o", out, "--master-dir", str(inputs), "--src-fps", "5", "--threshold", "0.8"]
    entities = spark.createDataFrame([(1, "ロトム"), (2, "ミミロップ")], "id int, name string")
    assert entities.count() == 2
    assert cli.main(args, reader=Unsure) == 0
    queue = json.loads((inputs / "out.json.review.json").read_text(encoding="utf-8"))
    assert any(q["kind"] == "item" and q["raw"] == "oxxgx" and len(q["choices"]) == 3 for q in queue)
    (inputs / "d.json").write_text(json.dumps({"segments": {"2": "ロトム"}, "items": {"oxxgx": "omega"}}, ensure_ascii=False), encoding="utf-8")
    assert cli.main([*args, "--segments", f"{out}.segments.json", "--decisions", str(inputs / "d.json")], reader=Unsure) == 0
    got = json.loads((inputs / "out.json").read_text(encoding="utf-8"))
    assert any("omega" in v for v in got.values())


def test_bad_arguments(inputs, capsys):
    assert cli.main(["none.npy"]) == 2
    assert call(inputs, "--fps", "0")[0] == 2
    assert call(inputs, "--start", "3", "--end", "3")[0] == 2
    assert call(inputs, "--master-dir", str(inputs / "no"))[0] == 2
    np.save(inputs / "0.npy", np.zeros((3, 0, 0, 3), np.uint8))
    assert call(inputs)[0] == 2


def test_rows_and_sink(spark, inputs):
    seen = []
    options = Options(reader=Painted, row_sink=seen.append, ascii_names=True)
    stack = [{"path": str(inputs / "0.npy"), "src_fps": 5.0}]
    pictures = video.frames_of(spark, stack, 5.0, options, "g")
    served = pictures.filter("frame_idx in (3, 5)").select("group_id", "ord", F.lit(1).alias("segment_no"))
    items = files.read_items(spark, str(inputs / "items.json"))
    got = {(r["ord"], r["row_no"]): (r["raw"], r["observed_type"], r["canonical"]) for r in video.observations(pictures, served, items, WIDTH, HEIGHT, options).collect()}
    kind = "ノーマル"
    assert got == {(3, 1): ("alpha", kind, "alpha"), (3, 2): ("gamma", kind, "gamma"), (5, 1): ("gamma", kind, "gamma"), (5, 2): ("delta", kind, "delta")}
    assert sorted(r["text"] for r in seen[0].select("text", "crop").collect()) == ["alpha", "delta", "gamma", "gamma"]


def test_manifest(spark, inputs):
    paths = [str(inputs / "0.npy"), str(inputs / "1.npy")]
    got = [tuple(r)[2:] for r in frames.manifest(spark, paths, "5,10").orderBy("video_seq").collect()]
    assert got == [(7, 5.0, WIDTH, HEIGHT), (5, 10.0, WIDTH, HEIGHT)]
    with pytest.raises(ValueError):
        frames.probed(paths, "1,2,3")


class Lines:
    """An engine whose results are the boxes it is given, in an order of its own."""

    def __init__(self, drop=0):
        self.drop = drop

    def detect(self, image):
        return [([(0, 0), (4, 0), (4, 2), (0, 2)], f"{image.shape[0]}x{image.shape[1]}", 0.5)]

    def read(self, image, boxes, allowed=None):
        return [([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], f"t{k}", 0.9) for k, (x, y, w, h) in enumerate(boxes)][self.drop :]


def test_engine_primitives():
    image = np.arange(24 * 16 * 3, dtype=np.uint8).reshape(24, 16, 3)
    boxes = [(0, 0, 4, 4), (0, 8, 4, 4), (0, 16, 4, 4)]
    assert recognize.picture_texts(Lines(), image)[0][0] == "24x16"
    assert recognize.region_texts(Lines(), image, (2, 4, 5, 6), 2.0) == [("12x10", 0.5, [(2, 4), (4, 4), (4, 5), (2, 5)])]
    assert recognize.region_texts(Lines(), image, (2, 4, 0, 6)) == [] == recognize.region_line(Lines(), image, (2, 4, 0, 6))
    assert recognize.region_line(Lines(), image, (2, 4, 5, 6), 2.0)[0][2] == [(2, 4), (7, 4), (7, 10), (2, 10)]
    texts = lambda found: [[t for t, _, _ in b] for b in found]
    assert texts(recognize.boxes_texts(Lines(), image, boxes)) == [["t0"], ["t1"], ["t2"]]
    assert texts(recognize.boxes_texts(Lines(1), image, boxes)) == [[], ["t1"], ["t2"]]  # fewer results: by height
    got = recognize.EngineRecognizer(Lines()).recognize_batch([image, image[:, :8]], [boxes, boxes[:1]])
    assert [texts(x) for x in got] == [[["t0"], ["t1"], ["t2"]], [["t3"]]]
    assert recognize.stacked_texts(Lines(), [image], [[]]) == [[]]
    with pytest.raises(ValueError):
        recognize.stacked_texts(Lines(), [image], [])
    with pytest.raises(RuntimeError):
        recognize.EasyEngine()


def test_colours_and_enlargement():
    pixels = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [90, 90, 90], [0, 255, 255], [128, 0, 128]]], np.uint8)
    assert recognize.hue_saturation_value(pixels).tolist() == [[[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 90], [30, 255, 255], [150, 255, 128]]]
    flat = np.full((3, 5, 3), 77, np.uint8)
    assert recognize.enlarge(flat, 2.0).shape == (6, 10, 3) and (recognize.enlarge(flat, 2.0) == 77).all()
    ramp = np.tile(np.arange(0, 200, 10, dtype=np.uint8), (4, 1))
    big = recognize.enlarge(ramp, 2.0).astype(int)
    assert (np.diff(big[3, 4:-4]) > 0).all() and abs(int(big[3, 10]) - 47) <= 2
