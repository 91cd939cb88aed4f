"""Sources, sinks, streams and readers as queries over the test tables, with their SQL.

Each query writes its table in a format of its own (JSON files, stacks of pictures, a stream's files) to a scratch folder, reads it back
through the operator, and gives what the table itself has.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recognize as vision
from ..functions import text
from ..operators import nearest, segments, timeline, votes
from ..options import Options
from ..sources import files
from ..sources import frames as pictures
from ..streaming.segmenter import segment_stream, segments_of, write_increments
from . import catalog, offline, video
from .catalog import MARKED, QUERIES, SQL, frames, query, t

__all__ = ["QUERIES", "SQL"]

# ---- dimensions and results as JSON files


def _local(path: str) -> str:
    return path.removeprefix("file:") if path.startswith("file:") else path


@query("SELECT p_partkey::INT AS id, p_name AS name, p_type AS type, p_size::INT AS pp FROM part")
def items_file(spark: SparkSession, d: str) -> DataFrame:
    """A dimension written as an array of objects and read back."""
    path = f"{files.scratch(spark)}/items.json"
    items = t(spark, d, "part").select(F.col("p_partkey").cast("int").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_size").cast("int").alias("pp"))
    files.write_json(files.items_json(items), path)
    return files.read_items(spark, path)


@query("SELECT (row_number() OVER (ORDER BY c_custkey))::INT AS id, c_name AS name FROM customer")
def entities_file(spark, d):
    """An array of names; ids are places. What is no array of names fails."""
    path = f"{files.scratch(spark)}/entities.json"
    names = t(spark, d, "customer").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda s: s["c_name"])).alias("value"))
    files.write_json(names, path)
    return files.read_entities(spark, path)


LISTS = """l AS (SELECT 0 AS file_ord, 'S' || (l_suppkey % 40)::VARCHAR AS entity, l_suppkey % 40 AS ent, l_orderkey AS place, 'item' || (l_partkey % 60)::VARCHAR AS item FROM lineitem
UNION ALL SELECT 1, 'S' || (l_suppkey % 43)::VARCHAR, l_suppkey % 43, l_orderkey, 'item' || (l_partkey % 70)::VARCHAR FROM lineitem WHERE l_returnflag = 'R'),
u AS (SELECT file_ord, entity, ent, item, min(place) AS place FROM l GROUP BY ALL),
r AS (SELECT file_ord, entity, item, row_number() OVER (PARTITION BY file_ord, entity ORDER BY place, item) - 1 AS pos, dense_rank() OVER (PARTITION BY file_ord ORDER BY ent) - 1 AS ent_pos FROM u)"""


def _lists(spark, d):
    """Two result files' rows."""
    li = t(spark, d, "lineitem")
    parts = []
    for k, (rows, s, i) in enumerate(((li, 40, 60), (li.filter("l_returnflag = 'R'"), 43, 70))):
        ent = F.col("l_suppkey") % s
        one = rows.select(F.lit(k).alias("file_ord"), F.concat(F.lit("S"), ent.cast("string")).alias("entity"), ent.alias("ent_pos"), F.col("l_orderkey").alias("place"), F.concat(F.lit("item"), (F.col("l_partkey") % i).cast("string")).alias("item"))
        parts.append(votes.ordered_distinct(one, ["file_ord", "entity", "ent_pos"], "item", ["place"]))
    return parts


def _result_files(spark, d) -> list[str]:
    folder, out = files.scratch(spark), []
    for k, rows in enumerate(_lists(spark, d)):
        out.append(f"{folder}/result{k}.json")
        files.write_json(files.result_json(rows), out[-1])
    return out


@query(f"WITH {LISTS} SELECT file_ord::INT AS file_ord, entity, ent_pos::INT AS ent_pos, pos::INT AS pos, item FROM r")
def result_files(spark, d):
    """Result files, objects of lists in order, written and read back with each file's place."""
    return files.read_results(spark, _result_files(spark, d))


@query(f"""WITH {LISTS}, f AS (SELECT entity, item, min(file_ord) AS file_ord FROM r GROUP BY 1, 2),
m AS (SELECT entity, item, row_number() OVER (PARTITION BY entity ORDER BY file_ord, pos)::INT AS pos FROM r JOIN f USING (entity, item, file_ord))
SELECT 'merged' AS file, entity, pos, item FROM m UNION ALL SELECT 'new', entity, pos, item FROM m WHERE entity NOT IN (SELECT 'S' || (n_nationkey % 25)::VARCHAR FROM nation)""")
def merged_outputs(spark, d):
    """Merged files and those not collected yet, both written and read back."""
    folder = files.scratch(spark)
    have = t(spark, d, "nation").select(F.to_json(F.create_map(F.concat(F.lit("S"), (F.col("n_nationkey") % 25).cast("string")), F.col("n_name"))).alias("value"))
    have.write.text(f"{folder}/collected.jsonl")
    paths = (f"{folder}/merged.json", f"{folder}/merged_new.json")
    offline.write_merged(spark, _result_files(spark, d), f"{folder}/collected.jsonl", *paths)
    read = files.read_results(spark, list(paths))
    return read.select(F.when(F.col("file_ord") == 0, "merged").otherwise("new").alias("file"), "entity", (F.col("pos") + 1).alias("pos"), "item")


@query("SELECT DISTINCT c_name AS entity FROM customer")
def collected_file(spark, d):
    """Keys of objects, one a line; a file that isn't there has none."""
    path = f"{files.scratch(spark)}/collected.jsonl"
    t(spark, d, "customer").select(F.to_json(F.create_map("c_name", F.col("c_custkey").cast("string"))).alias("value")).write.text(path)
    return files.read_collected(spark, path).unionByName(files.read_collected(spark, f"{path}.none"))


EDITION_ORDER = ["g0", "g1", "g2"]


@query("""SELECT p_name AS name, CASE WHEN p_size % 4 = 3 THEN -1 ELSE p_size % 4 END::INT AS rank, CASE WHEN p_size % 4 = 3 THEN 1 ELSE p_size % 4 + 2 END::INT AS file_ord, 0 AS game_pos,
 CASE WHEN p_partkey % 5 > 0 THEN p_type END AS type, CASE WHEN p_partkey % 5 > 0 THEN p_size::INT END AS pp
FROM (SELECT *, row_number() OVER (PARTITION BY p_size % 4, p_name ORDER BY p_partkey) AS k FROM part) WHERE k = 1""")
def edition_files(spark, d):
    """Lists by edition, one file in each edition's folder; folders that the order doesn't know come first."""
    folder = files.scratch(spark)
    one = t(spark, d, "part").groupBy((F.col("p_size") % 4).alias("g"), "p_name").agg(F.min_by(F.struct("p_partkey", "p_type", "p_size"), "p_partkey").alias("p"))
    facts = F.when(F.col("p.p_partkey") % 5 > 0, F.to_json(F.struct(F.col("p.p_type").alias("type"), F.concat(F.lit(" "), F.col("p.p_size").cast("string")).alias("pp")))).otherwise(F.lit('"none"'))
    entry = F.concat(F.lit('"'), "p_name", F.lit('": '), facts)
    for g in range(4):
        body = one.filter(F.col("g") == g).agg(F.concat(F.lit('{"waza_list": {"game": {'), F.array_join(F.array_sort(F.collect_list(entry)), ", "), F.lit("}}}")).alias("value"))
        files.write_text(spark, f"{folder}/g{g}/list.json", body.first()["value"])
    return files.read_editions(spark, f"{folder}/*/list.json", EDITION_ORDER)


# ---- the index of segments, and segments of a stream

#: Numbers of a recording's segments in an index of one group: as many as an int has.
RECORDING = 1 << 31


@query(f"""WITH {MARKED} SELECT 5.0::DOUBLE AS index_fps, 0 AS group_no, segs.group_id, segs.segment_no::INT AS segment_no, entity, detail_ts, list_start, list_end, list_frames::INT AS list_frames FROM segs""")
def index_file(spark, d):
    """The index beside a result file, written, read back and looked up in the dimension."""
    path = files.sidecar(f"{files.scratch(spark)}/out.json")
    found = segments.segments(frames(spark, d), catalog.SLOT)
    one = F.struct(F.ascii(F.substring("entity", 2, 1)).alias("id"), F.col("entity").alias("name"), F.lit(0.9).alias("score"))
    lost = F.struct(F.lit(-1).alias("id"), F.lit("gone").alias("name"), F.lit(0.8).alias("score"))
    candidates = F.when(F.col("entity").isNotNull(), F.array(one, lost)).otherwise(F.array()).cast(files.CANDIDATES)
    # a segment's own number tells its recording apart: the index has one group
    rows = found.select(F.lit(0).alias("group_no"), F.array(F.lit("v")).alias("videos"), F.array(F.lit(1280), F.lit(720)).alias("resolution"), (F.col("group_id").cast("long") * RECORDING + F.col("segment_no")).alias("seg_no"), candidates.alias("candidates"), "detail_ts", "list_start", "list_end", F.col("list_frames").cast("int").alias("list_frames"))
    files.write_index(rows, 5.0, path)
    dim = spark.createDataFrame([(ord(c), f"E{c}") for c in "0123456"], "id int, name string")
    got = files.read_index(spark, path, dim)
    name = F.when(F.size("candidates") > 0, F.element_at("candidates", 1)["name"])
    return got.select("index_fps", "group_no", F.expr(f"seg_no div {RECORDING}").cast("string").alias("group_id"), (F.col("seg_no") % RECORDING).cast("int").alias("segment_no"), name.alias("entity"), "detail_ts", "list_start", "list_end", "list_frames")


@query(f"WITH {MARKED} SELECT group_id, segment_no::INT AS segment_no, entity, detail_ts, list_start, list_end, list_frames FROM segs")
def segment_increments(spark, d):
    """The state machine over a stream, results appended as segments close; a last frame closes what is open."""
    folder = files.scratch(spark)
    f = frames(spark, d).select("group_id", "ts", "ord", "kind", "box")
    ends = f.groupBy("group_id").agg((F.max("ts") + 1).alias("ts")).select("group_id", "ts", F.lit(1 << 60).alias("ord"), F.lit("end").alias("kind"), F.lit(None).cast("string").alias("box"))
    half = f.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0] or 0.0
    for part in (f.filter(F.col("ts") <= half), f.filter(F.col("ts") > half), ends):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/frames")
        stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/frames")
        write_increments(segment_stream(stream), f"{folder}/segments", f"{folder}/progress").awaitTermination()
    return segments_of(spark, f"{folder}/segments")


# ---- recordings as files


def _stacks(spark, d) -> list[str]:
    """A stack of frames for each nation, a frame of 2 by 3 pixels for each supplier, whose first number is the supplier's key modulo 251."""
    folder = _local(files.scratch(spark))

    def save(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(rows["s_suppkey"].to_numpy()) % 251
        path = f"{folder}/{int(key[0]):02d}.npy"
        os.makedirs(folder, exist_ok=True)
        np.save(path, np.broadcast_to(keys.astype(np.uint8)[:, None, None, None], (len(keys), 2, 3, 3)))
        return pd.DataFrame({"path": [path]})

    made = t(spark, d, "supplier").select("s_nationkey", "s_suppkey").groupBy("s_nationkey").applyInPandas(save, "path string")
    return sorted(r[0] for r in made.collect())


STACKS = """n AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS frame_idx FROM supplier),
v AS (SELECT s_nationkey, row_number() OVER (ORDER BY s_nationkey) - 1 AS video_seq, count(*) AS frame_count FROM supplier GROUP BY 1),
o AS (SELECT *, coalesce(sum(frame_count / 10.0) OVER (ORDER BY video_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v)"""


@query(f"WITH {STACKS} SELECT video_seq::INT AS video_seq, frame_idx, round(before + frame_idx / 10.0, 6) AS ts, 2 AS height, 3 AS width, (s_suppkey % 251)::INT AS pixel FROM n JOIN o USING (s_nationkey) WHERE frame_idx % 2 = 0")
def video_frames(spark, d):
    """Files decoded into frames on the grid of half their rate, on one timeline."""
    got = pictures.read_frames(spark, paths=",".join(_stacks(spark, d)), fps="5", src_fps="10", slice="7")
    pixel = F.conv(F.hex(F.substring("image", 1, 1)), 16, 10).cast("int")
    return got.select("video_seq", "frame_idx", F.round("ts", 6).alias("ts"), "height", "width", pixel.alias("pixel"))


@query(f"WITH {STACKS} SELECT video_seq::INT AS video_seq, frame_idx, (s_suppkey % 251)::INT AS pixel FROM n JOIN o USING (s_nationkey) WHERE before + frame_idx / 10.0 >= 0.35 AND before + frame_idx / 10.0 < 61.25 AND video_seq <> 3 AND video_seq < 20")
def ranged_frames(spark, d):
    """A time range and some files, pushed into the source, which opens no other slices."""
    got = pictures.read_frames(spark, paths=",".join(_stacks(spark, d)), fps="10", src_fps="10", slice="4", push=True)
    few = timeline.in_range(got, 0.35, 61.25).filter("video_seq <> 3 and video_seq < 20")
    return few.select("video_seq", "frame_idx", F.conv(F.hex(F.substring("image", 1, 1)), 16, 10).cast("int").alias("pixel"))


@query(f"WITH {STACKS} SELECT video_seq::INT AS video_seq, frame_idx, round(before + frame_idx / 10.0, 6) AS ts, (s_suppkey % 251)::INT AS pixel FROM n JOIN o USING (s_nationkey)")
def streamed_frames(spark, d):
    """Files of a folder as a stream of frames, a bounded number read ahead in each micro-batch."""
    folder, out = os.path.dirname(_stacks(spark, d)[0]), files.scratch(spark)
    spark.dataSource.register(pictures.FrameSource)
    stream = spark.readStream.format("frames").options(folder=folder, fps="10", src_fps="10", slice="16").load()
    pixel = F.conv(F.hex(F.substring("image", 1, 1)), 16, 10).cast("int").alias("pixel")
    seen = stream.select("video_seq", "frame_idx", F.round("ts", 6).alias("ts"), pixel)
    seen.writeStream.option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).format("parquet").start(f"{out}/frames").awaitTermination()
    return spark.read.schema(seen.schema).parquet(f"{out}/frames")


@query(f"WITH {STACKS} SELECT video_seq::INT AS video_seq, frame_count, 10.0::DOUBLE AS src_fps, 3 AS width, 2 AS height FROM v")
def video_manifest(spark, d):
    """S3: what is known of files without decoding them."""
    return pictures.manifest(spark, _stacks(spark, d), "10").drop("path")


@query("""SELECT 'frame_' || lpad((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::VARCHAR, 6, '0') || '.png' AS name, '89504E470D0A1A0A' AS signature, '0000000300000002' AS size FROM supplier""")
def frame_pictures(spark, d):
    """Frames as PNG."""
    got = pictures.pictures(pictures.read_frames(spark, paths=",".join(_stacks(spark, d)), fps="10", src_fps="10"))
    return got.select("name", F.hex(F.substring("png", 1, 8)).alias("signature"), F.hex(F.substring("png", 17, 8)).alias("size"))


@query("SELECT l_orderkey AS frame_id, l_linenumber AS box_no, l_partkey::INT AS first_x, (l_suppkey + 7)::INT AS third_y FROM lineitem")
def reader_dump(spark, d):
    """A reader's fragments with their first and third corners."""
    x, y = F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int")
    box = F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (9, 0), (9, 7), (0, 7))))
    f = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("box_no"), F.lit(0).alias("frag_no"), F.lit("t").alias("text"), F.lit(0.5).alias("confidence"), box.alias("box"))
    return files.text_corners(f).select("frame_id", "box_no", F.col("first_corner.x").alias("first_x"), F.col("third_corner.y").alias("third_y"))


@query("SELECT count(*) AS rows FROM events")
def progress(spark, d):
    """Rows counted while another job ran over them."""
    counted, seen = offline.observed(t(spark, d, "events").select("event_id"), "progress")
    counted.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "rows long")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN false WHEN event_id % 7 = 1 THEN false ELSE value > 5 END AS valid FROM events")
def valid_rates(spark, d):
    """Rates that are finite and positive."""
    k = F.col("event_id") % 7
    rate = F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("value") - 5)
    return t(spark, d, "events").select("event_id", timeline.valid_rate(rate).alias("valid"))


# ---- pictures

PIXEL = "p AS (SELECT p_partkey, (p_partkey * 7 % 256)::DOUBLE AS b, (p_size * 5 % 256)::DOUBLE AS g, (p_partkey * 13 % 256)::DOUBLE AS r FROM part), m AS (SELECT *, greatest(b, g, r) AS top, least(b, g, r) AS low FROM p)"


@query(f"""WITH {PIXEL}, h AS (SELECT *, CASE WHEN top = low THEN 0 WHEN top = r THEN 60 * (g - b) / (top - low) WHEN top = g THEN 120 + 60 * (b - r) / (top - low) ELSE 240 + 60 * (r - g) / (top - low) END AS deg FROM m)
SELECT p_partkey, floor(b * 0.114 + g * 0.587 + r * 0.299 + 0.5)::INT AS gray, floor((CASE WHEN deg < 0 THEN deg + 360 ELSE deg END) / 2 + 0.5)::INT % 180 AS hue,
 CASE WHEN top > 0 THEN floor((top - low) * 255 / greatest(top, 1) + 0.5) ELSE 0 END::INT AS saturation, top::INT AS value FROM h""")
def colour_spaces(spark, d):
    """luma, hue, saturation and value of pixels."""
    p = t(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7 % 256).alias("b"), (F.col("p_size") * 5 % 256).alias("g"), (F.col("p_partkey") * 13 % 256).alias("r"))

    def run(batches):
        for x in batches:
            image = x[["b", "g", "r"]].to_numpy().astype(np.uint8)[None]
            hsv = vision.hue_saturation_value(image)[0].astype(int)
            yield pd.DataFrame({"p_partkey": x["p_partkey"], "gray": vision.gray(image)[0].astype(int), "hue": hsv[:, 0], "saturation": hsv[:, 1], "value": hsv[:, 2]})

    return p.mapInPandas(run, "p_partkey long, gray int, hue int, saturation int, value int")


@query("""SELECT p_partkey, x::INT AS x, y::INT AS y, floor((((p_partkey + 2 * x + 3 * 2 * y) * 7 % 256) + ((p_partkey + 2 * x + 1 + 3 * 2 * y) * 7 % 256) + ((p_partkey + 2 * x + 3 * (2 * y + 1)) * 7 % 256) + ((p_partkey + 2 * x + 1 + 3 * (2 * y + 1)) * 7 % 256)) / 4.0 + 0.5)::INT AS value
FROM part, range(2) a(x), range(3) b(y)""")
def shrunk_pictures(spark, d):
    """A crop's area means at half its size. A batch's pictures are shrunk at once, each of them a channel."""

    def run(batches):
        for b in batches:
            k = b["p_partkey"].to_numpy()
            big = np.full((10, 10, len(k)), 99, np.uint8)
            big[2:8, 3:7] = (k + (np.arange(4) + 3 * np.arange(6)[:, None])[..., None]) * 7 % 256
            small = vision.shrink(vision.crop(big, (3, 2, 4, 6)), 2, 3)
            y, x = (n.ravel() for n in np.indices(small.shape[:2]))
            yield pd.DataFrame({"p_partkey": np.repeat(k, len(x)), "x": np.tile(x, len(k)), "y": np.tile(y, len(k)), "value": small.reshape(len(x), -1).T.ravel().astype(int)})

    return t(spark, d, "part").select("p_partkey").mapInPandas(run, "p_partkey long, x int, y int, value int")


@query("SELECT l_orderkey, l_linenumber, trunc(l_quantity / 2.5)::INT + 10 AS x, trunc(l_discount * 100 / 2.5)::INT + 20 AS y FROM lineitem")
def mapped_corners(spark, d):
    """corners of an enlarged crop in the picture's coordinates."""
    corner = F.array(F.struct(F.col("l_quantity").cast("double").alias("x"), F.round(F.col("l_discount") * 100, 0).cast("double").alias("y")))
    at = vision.corners_to_source(corner, F.lit(10), F.lit(20), 2.5)[0]
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", at["x"].alias("x"), at["y"].alias("y"))


class PixelEngine:
    """An engine that reads ``t`` and the first grey level of each box, in order of height, and leaves boxes of level 255 out."""

    def detect(self, image):
        return [([(0, 0), (1, 0), (1, 1), (0, 1)], f"t{int(vision.gray(image)[0, 0])}", 0.5)]

    def read(self, image, boxes, allowed=None):
        levels = [(b, int(image[b[1], b[0]])) for b in boxes]
        return [([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], f"t{v}", 0.75) for (x, y, w, h), v in levels if v < 255]


@query("""SELECT s_suppkey AS frame_idx, box_no::INT AS box_no, 't' || (s_suppkey * 3 % 200 + box_no * 10)::VARCHAR AS text, 0.75::DOUBLE AS confidence FROM supplier, range(3) r(box_no)""")
def reader_texts(spark, d):
    """Pictures read in batches by a recognizer over an engine, passed on by a wrapper."""

    def paint(batches):
        for b in batches:
            made = []
            for k in b["s_suppkey"]:
                image = np.zeros((12, 5, 3), np.uint8)
                for box in range(3):
                    image[4 * box : 4 * box + 4] = k * 3 % 200 + box * 10
                made.append(image.tobytes())
            yield pd.DataFrame({"frame_idx": b["s_suppkey"], "height": 12, "width": 5, "image": made})

    painted = t(spark, d, "supplier").select("s_suppkey").mapInPandas(paint, "frame_idx long, height int, width int, image binary")
    boxes = [(0, 0, 5, 4), (0, 4, 5, 4), (0, 8, 5, 4)]
    found = vision.recognize(painted, lambda: vision.Wrapped(vision.EngineRecognizer(PixelEngine())), boxes)
    return found.select("frame_idx", "box_no", "text", "confidence")


ROW_NAMES = ("alpha", "gamma", "delta", "omega")


class PaintedRows:
    """Reads the grey level that ``_painted_list`` gives a row."""

    def recognize_batch(self, images, boxes, allowed=None):
        return [[self._row(vision.crop(i, b)) for b in bs] for i, bs in zip(images, boxes, strict=True)]

    def _row(self, part):
        code = (int(part[6, 50, 0]) - 125) // 30
        return [(ROW_NAMES[code], 0.9, [])] if 0 <= code < len(ROW_NAMES) else []

    def read_line(self, image, box):
        return []

    def read_texts(self, image, box, factor):
        return []


def _painted_list(at: dict, codes: list[int]) -> np.ndarray:
    image = np.full((180, 320, 3), 90, np.uint8)
    x, w, h, ys = at["move_slot_x"], at["move_slot_w"], at["move_slot_h"], at["move_slot_ys"]
    image[ys[0] - 5 : ys[-1] + h + 5, x : x + w] = 200
    for k, code in enumerate(codes):
        centre = ys[0] + k * (ys[1] - ys[0]) + h // 2
        image[centre - 2 : centre + 3, x : x + 20] = 10
        image[centre - 6 : centre + 7, x + 45 : x + 55] = 125 + 30 * code
        image[centre - 4 : centre + 5, at["type_icon_x"] : at["type_icon_x"] + 2] = 161
        image[centre, 10:30] = 161
    return image


@query("""SELECT n_nationkey::BIGINT AS ord, k::INT + 1 AS row_no, ['alpha', 'gamma', 'delta', 'omega'][((n_nationkey + k * (1 + n_nationkey % 3)) % 4 + 1)::INT] AS raw, 'ノーマル' AS observed_type,
 ['alpha', 'gamma', 'delta', 'omega'][((n_nationkey + k * (1 + n_nationkey % 3)) % 4 + 1)::INT] AS canonical, true AS sunk FROM nation, range(2) r(k)""")
def rows_of_pictures(spark, d):
    """Rows found in pictures, read once for each look, matched with items, and shown to an observer."""
    at = timeline.resolved(320, 180)

    def paint(batches):
        for b in batches:
            made = [_painted_list(at, [int((k + j * (1 + k % 3)) % 4) for j in range(2)]).tobytes() for k in b["ord"]]
            yield pd.DataFrame({"group_id": "g", "ord": b["ord"], "ts": b["ord"].astype(float), "height": 180, "width": 320, "image": made})

    lists = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord")).mapInPandas(paint, "group_id string, ord long, ts double, height int, width int, image binary")
    items = spark.createDataFrame([(k + 1, n, "ノーマル", 5) for k, n in enumerate(ROW_NAMES)], "id int, name string, type string, pp int")
    sunk: list[DataFrame] = []
    served = lists.select("group_id", "ord", F.lit(1).alias("segment_no"))
    seen = video.observations(lists, served, items, 320, 180, Options(reader=PaintedRows, row_sink=sunk.append, ascii_names=True))
    shown = sunk[0].select("ord", "row_no", (F.length("crop") > 0).alias("sunk"))
    return seen.join(shown, ["ord", "row_no"]).select("ord", "row_no", "raw", "observed_type", "canonical", "sunk")


# ---- names and boxes

KANA_FROM = "abcdefghijklmnopqrst"
KANA = "アァイゥガギグゴザダッツャヤパバヴかぎぇ"
KANA_PLAIN = "アアイウカキクコサタツツヤヤハハウかきえ"


@query(f"""SELECT p_partkey, translate(p_name, '{KANA_FROM}', '{KANA_PLAIN}') || p_size::VARCHAR AS fold,
 CASE p_partkey % 3 WHEN 0 THEN '♂' WHEN 1 THEN '♀' ELSE 'ミロハ' END || translate(p_name, '{KANA_FROM}', '{KANA_PLAIN}') AS entity_fold FROM part""")
def folded_names(spark, d):
    """Width, small and voiced kana, look-alike kanji and written genders."""
    name = F.translate("p_name", KANA_FROM, KANA)
    wide = F.translate(F.col("p_size").cast("string"), "0123456789", "０１２３４５６７８９")
    head = F.when(F.col("p_partkey") % 3 == 0, "オスのすがた").when(F.col("p_partkey") % 3 == 1, "メスのすがた").otherwise("三口八")
    return t(spark, d, "part").select("p_partkey", text.kana_fold(F.concat(name, wide)).alias("fold"), text.entity_fold(F.concat(head, name)).alias("entity_fold"))


@query(r"""SELECT p_partkey, p_name AS base, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS form, CASE p_partkey % 4 WHEN 0 THEN p_size::INT WHEN 1 THEN p_size::INT WHEN 2 THEN 12 ELSE 0 END AS pp,
 CASE p_partkey % 4 WHEN 0 THEN 'digit' WHEN 1 THEN 'digit' WHEN 2 THEN 'digit' ELSE 'space' END AS category FROM part""")
def trimmed_names(spark, d):
    """white space around bases and forms; numbers and digits of other scripts."""
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("　 "), "p_name", F.lit(" "))).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" （ "), "p_type", F.lit(" ) ")))
    number = F.when(k == 0, F.translate(size, "0123456789", "０１２３４５６７８９")).when(k == 1, F.translate(size, "0123456789", "٠١٢٣٤٥٦٧٨٩")).when(k == 2, "1_2").otherwise("1__2")
    char = F.when(k == 0, "①").when(k == 1, "５").when(k == 2, "²").otherwise("\x1f")
    base, form = text.base_and_form(name)
    return t(spark, d, "part").select("p_partkey", base.alias("base"), form.alias("form"), text.int_or_zero(number).alias("pp"), text.char_category(char).alias("category"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS frame_id, l_linenumber AS res_no FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS frame_id, l_linenumber + 10 AS box_no, l_linenumber * 15 AS box_y FROM lineitem WHERE l_quantity > 10),
p AS (SELECT *, (frame_id * 7 + res_no * 31) % 100 AS cy, row_number() OVER (PARTITION BY frame_id ORDER BY res_no) AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY box_no) AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM b),
z AS (SELECT p.frame_id, res_no, box_no FROM p JOIN q ON p.frame_id = q.frame_id AND p.k = q.k AND p.n = q.n),
j AS (SELECT p.frame_id, res_no, box_no, row_number() OVER (PARTITION BY p.frame_id, res_no ORDER BY abs(cy - box_y), box_no) AS k FROM p JOIN q ON p.frame_id = q.frame_id AND p.n <> q.n)
SELECT * FROM z UNION ALL SELECT frame_id, res_no, box_no FROM j WHERE k = 1""")
def assigned_boxes(spark, d):
    """By place where counts agree, else the nearest box."""
    li = nearest.dealt(t(spark, d, "lineitem"), "l_orderkey")
    r = li.select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("res_no")).distinct().withColumn("cy", (F.col("frame_id") * 7 + F.col("res_no") * 31) % 100)
    b = li.filter("l_quantity > 10").select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("line")).distinct().select("frame_id", (F.col("line") + 10).alias("box_no"), (F.col("line") * 15).alias("by"))
    return nearest.assign_boxes(r, b)


VOTED = """d AS (SELECT p_name AS name, min(p_partkey)::INT AS id FROM part GROUP BY 1),
v AS (SELECT p_partkey % 50 AS segment_id, CASE WHEN p_partkey % 4 = 0 THEN substr(p_name, 2, 99) || 'x' WHEN p_partkey % 4 = 1 THEN replace(p_name, 'e', 'c') WHEN p_partkey % 4 = 2 THEN substr(p_name, 1, 4) ELSE p_name END AS raw, min(p_partkey) AS first_seen FROM part GROUP BY ALL),
x AS (SELECT DISTINCT raw FROM v WHERE length(raw) > 0), s AS (SELECT raw, id, name, 1 - levenshtein(raw, name) / greatest(length(raw), length(name)) AS score FROM x CROSS JOIN d),
b AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY score DESC, id) AS k FROM s),
y AS (SELECT segment_id, id, name, first_seen, row_number() OVER (PARTITION BY segment_id, id ORDER BY first_seen) AS n FROM v JOIN b USING (raw) WHERE k = 1 AND score >= 0.7)"""


@query(f"WITH {VOTED} SELECT segment_id, id, name AS item, row_number() OVER (PARTITION BY segment_id ORDER BY first_seen)::INT AS pos FROM y WHERE n = 1")
def accepted_names(spark, d):
    """Voted names matched again without a type; an item once, where it was first seen."""
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.when(k % 4 == 0, F.concat(F.substring(name, 2, 99), F.lit("x"))).when(k % 4 == 1, F.replace(name, F.lit("e"), F.lit("c"))).when(k % 4 == 2, F.substring(name, 1, 4)).otherwise(name)
    seen = t(spark, d, "part").select((k % 50).alias("segment_id"), raw.alias("name"), k.alias("frame_idx"), F.lit(0).alias("row_no"))
    dim = t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("int").alias("id"), F.min_by("p_type", "p_partkey").alias("type"))
    return votes.accepted_items(votes.votes(seen), dim, ascii_only=True)[0].select("segment_id", "id", "item", "pos")


@query("""WITH s AS (SELECT o_custkey AS group_id, o_orderkey AS segment_no, CASE WHEN o_orderkey % 3 > 0 THEN 1.0 END AS list_start FROM orders),
l AS (SELECT l_orderkey AS segment_no, string_agg(DISTINCT 'i' || l_linenumber::VARCHAR, ',' ORDER BY 'i' || l_linenumber::VARCHAR) AS items FROM lineitem WHERE l_quantity > 20 GROUP BY 1)
SELECT segment_no, CASE WHEN list_start IS NOT NULL THEN coalesce(items, '') ELSE '' END AS items FROM s LEFT JOIN l USING (segment_no)""")
def listed_segments(spark, d):
    """Segments with their items; none for those without list frames."""
    s = t(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("segment_no"), F.when(F.col("o_orderkey") % 3 > 0, 1.0).alias("list_start"))
    own = t(spark, d, "lineitem").filter("l_quantity > 20").groupBy(F.col("l_orderkey").alias("segment_no")).agg(F.array_sort(F.collect_set(F.concat(F.lit("i"), F.col("l_linenumber").cast("string")))).alias("items"))
    lists = s.select("group_id", "segment_no").join(own, "segment_no")
    return segments.with_lists(s, lists).select("segment_no", F.array_join("items", ",").alias("items"))
