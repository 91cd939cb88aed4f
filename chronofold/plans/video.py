"""From videos to segments and observations: the vision steps in Arrow batches, everything else as plans.

Pictures are decoded where they are used and never shuffled, but for the rows' crops that a reader needs. What readers and vision steps
give is written (``files.kept``) before it is used, so functions here start jobs. Readers, the costly step, see a
header only if it changed since the frame before, a box only if a bright frame's box changed, and of a segment's rows only those that are
unlike all rows before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import recognize as vision
from ..functions import text
from ..operators import fuzzy, nearest, rows, segments, timeline, votes
from ..options import Options
from ..sources import files
from ..sources.frames import read_frames

# Sizes (width, height) of the pictures that frames are compared by.
HEADER_THUMB, SLOT_THUMB, ROW_THUMB = (40, 12), (32, 80), (96, 24)
BOX_FACTOR = 3.0


def frames_of(spark: SparkSession, videos: list[dict], fps: float, options: Options, group: str, ranges: list[tuple[float, float]] | None = None) -> DataFrame:
    """Frames of some files of one resolution (rows of ``frames.VIDEOS``), with ``ord``, unique in the group and in its order."""
    given = {"paths": ",".join(v["path"] for v in videos), "src_fps": ",".join(str(v["src_fps"]) for v in videos), "group": group, "fps": str(fps)}
    for name, value in (("start", options.start), ("end", options.end)):
        if value is not None:
            given[name] = str(value)
    if ranges:
        given["ranges"] = ",".join(f"{a}:{z}" for a, z in ranges)
    return read_frames(spark, **given).withColumn("ord", F.shiftleft(F.col("video_seq").cast("long"), 40) + F.col("frame_idx"))


#: Rows, each of 64 frames, that are broadcast at most.
MOST_WORDS = 500_000


def among(frames: DataFrame, keys: DataFrame) -> DataFrame:
    """The frames whose ``group_id`` and ``ord`` are in ``keys``. The keys travel as bits, one row for 64 neighbouring frames, so that pictures aren't shuffled;
    beyond ``MOST_WORDS`` such rows, which is checked, Spark joins as it will.
    """
    word, bit = F.shiftright("ord", 6), F.col("ord").bitwiseAND(F.lit(63)).cast("int")
    words = files.kept(keys.groupBy("group_id", word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits")))
    few = F.broadcast(words) if words.count() <= MOST_WORDS else words
    hit = F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1
    return frames.withColumn("_word", word).join(few, ["group_id", "_word"]).filter(hit).select(*frames.columns)


def _thumb(image: np.ndarray, box: vision.Box, size: tuple[int, int]) -> list[int] | None:
    part = vision.crop(image, box)
    return vision.shrink(part, *size).ravel().tolist() if part.size else None


FEATURES = "group_id string, ord long, ts double, header_thumb array<short>, slot_thumb array<short>, box_thumb array<short>, mean_luma double"


def features(frames: DataFrame) -> DataFrame:
    """What frames are compared by, without their pictures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for (_, r), image in zip(b.iterrows(), vision.pictures(b), strict=True):
                at = timeline.resolved(r["width"], r["height"])
                ys = at["move_slot_ys"]
                slots = (at["move_slot_x"], ys[0], at["move_slot_w"], ys[-1] + at["move_slot_h"] - ys[0])
                thumbs = [_thumb(image, at["header"], HEADER_THUMB), _thumb(image, slots, SLOT_THUMB), _thumb(image, at["box_name"], HEADER_THUMB)]
                out.append((r["group_id"], r["ord"], r["ts"], *thumbs, float(image.mean())))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return frames.mapInPandas(run, FEATURES)


def read_regions(frames: DataFrame, region: str, options: Options, line: bool) -> DataFrame:
    """Texts of one region of the layout: ``group_id``, ``ord``, ``frag_no``, ``text``; read as one line, or found in its enlargement."""
    make = options.reader

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for b in batches:
            out = []
            for (_, r), image in zip(b.iterrows(), vision.pictures(b), strict=True):
                box = timeline.resolved(r["width"], r["height"])[region]
                found = reader.read_line(image, box) if line else reader.read_texts(image, box, BOX_FACTOR)
                out += [(r["group_id"], r["ord"], k, t) for k, (t, _, _) in enumerate(found)]
            yield pd.DataFrame(out, columns=["group_id", "ord", "frag_no", "text"])

    return frames.mapInPandas(run, "group_id string, ord long, frag_no int, text string")


def kinds(frames: DataFrame, options: Options, templates: DataFrame | None = None) -> DataFrame:
    """``features`` with the ``kind`` of each frame: read where the header changed, carried on where it didn't. With ``templates`` (of this group,
    learnt before, of both kinds that matter), only headers unlike all of them are read. ``was_read`` marks those that were.
    """
    seen = files.kept(timeline.changed_headers(files.kept(features(frames))))
    ask = seen.filter("changed")
    if templates is not None and not nearest.ready(templates):
        templates = None
    if templates is not None:
        refs = templates.select(F.col("ts").alias("ord"), "kind", F.col("thumb").alias("ref"))
        known = files.kept(nearest.classify_by_templates(ask.withColumn("thumb", F.col("header_thumb")), refs).filter("kind is not null").select("group_id", "ord", F.col("kind").alias("known_kind")))
        ask = ask.join(known, ["group_id", "ord"], "left_anti")
    headers = read_regions(among(frames, ask), "header", options, line=True)
    texts = votes.header_text(headers.withColumn("frame_id", F.struct("group_id", "ord"))).select("frame_id.*", F.col("text").alias("header_text"))
    out = seen.join(texts, ["group_id", "ord"], "left").withColumns({"read_kind": F.when(F.col("changed"), text.kind_by_words(F.coalesce("header_text", F.lit("")))), "was_read": F.col("changed")})
    if templates is not None:
        out = out.join(known, ["group_id", "ord"], "left").withColumns({"read_kind": F.coalesce("known_kind", "read_kind"), "was_read": F.col("changed") & F.col("known_kind").isNull()}).drop("known_kind")
    return files.kept(timeline.carry_kind(files.kept(out.drop("changed", "header_text"))))


def learnt(known: DataFrame, templates: DataFrame) -> DataFrame:
    """What the headers that were read (of ``kinds``) add to the templates of their groups."""
    read = known.filter("was_read").select("group_id", "ts", F.col("read_kind").alias("kind"), F.col("header_thumb").alias("thumb"))
    return files.kept(nearest.new_templates(read, templates))


def index(frames: DataFrame, entities: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Phase one: segments with ``candidates`` (best first), and the frames' kinds, which teach templates."""
    known = kinds(frames, options)
    marked = files.kept(timeline.to_read(known).select("group_id", "ts", "ord", "kind", "box_read"))
    ask = marked.filter("box_read").select("group_id", "ord")
    boxes = files.kept(read_regions(among(frames, ask), "box_name", options, line=False))
    found = fuzzy.entities_of_fragments(boxes.withColumn("frame_id", F.struct("group_id", "ord")), entities, 5)
    lists = found.groupBy("frame_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.array_sort(F.collect_list(F.struct("rank", F.struct("id", "name", "score").alias("c")))).alias("all"))
    box = F.transform("all", lambda c: c["c"]).cast(files.CANDIDATES)
    accepted = lists.filter(F.col("top") >= options.accept_entity).select("frame_id.*", box.alias("box"))
    out = segments.segments(files.kept(marked.join(accepted, ["group_id", "ord"], "left")))
    return out.withColumn("candidates", F.coalesce("entity", F.array().cast(files.CANDIDATES))).drop("entity"), known


def row_boxes(frames: DataFrame, width: int, height: int) -> DataFrame:
    """The rows of list frames of one resolution: ``group_id``, ``ord``, ``row_no`` (from the top), ``by`` (top of the text's box), ``icon_top``.

    Profiles by height come from the pictures; comb, bands and limits are plans over them.
    """
    at = timeline.resolved(width, height)
    ys, row_h = at["move_slot_ys"], at["move_slot_h"]
    spacing = ys[1] - ys[0]
    top, bottom = max(0, ys[0] - spacing), min(height, ys[-1] + row_h + spacing)
    icon = (max(0, at["type_icon_x"] - 2), at["type_icon_x"] + at["type_icon_w"] + 2)
    words = (at["move_slot_x"], at["move_slot_x"] + at["move_slot_w"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (_, r), image in zip(b.iterrows(), vision.pictures(b), strict=True):
                saturation, value = vision.saturation_value(image[:, icon[0] : icon[1]])
                dark = vision.gray(image[:, words[0] : words[1]]) < rows.DARK_BELOW
                yield pd.DataFrame({"group_id": r["group_id"], "ord": r["ord"], "y": np.arange(len(image)), "sat": saturation.mean(axis=1), "val": value.mean(axis=1), "dark": dark.mean(axis=1)})

    profile = frames.mapInPandas(run, "group_id string, ord long, y int, sat double, val double, dark double").withColumn("frame_id", F.struct("group_id", "ord"))
    column = rows.icon_like(profile.filter(F.col("y").between(top, bottom - 1)).withColumn("y", F.col("y") - top))
    tops = rows.icon_rows(column, rows.comb_phase(column, spacing), spacing, row_h, ys, top, bottom)
    inside = profile.join(tops, "frame_id").filter((F.col("y") >= F.col("text_top")) & (F.col("y") < F.col("text_top") + spacing))
    bands = rows.text_band(inside.select(F.struct("frame_id", "text_top", "icon_top").alias("frame_id"), "y", "dark"))
    found = bands.withColumns({"by": F.greatest(F.lit(0), F.col("centre") - row_h // 2), "h": F.lit(row_h)})
    whole = rows.whole_rows(found, ys[0], ys[-1] + row_h).select("frame_id.frame_id", "frame_id.icon_top", "by")
    return whole.select("frame_id.*", F.row_number().over(Window.partitionBy("frame_id").orderBy("by", "icon_top")).alias("row_no"), F.col("by").cast("int").alias("by"), F.col("icon_top").cast("int").alias("icon_top"))


CROPS = "group_id string, segment_no int, ord long, row_no int, thumb array<short>, crop binary, height int, width int, cb double, cg double, cr double"


def row_crops(frames: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Each row's picture, its thumb, and the median colour of its icon; ``boxes`` have ``segment_no`` too."""
    at = timeline.resolved(width, height)
    x, w, h = at["move_slot_x"], at["move_slot_w"], at["move_slot_h"]
    lists = boxes.groupBy("group_id", "ord").agg(F.collect_list(F.struct("segment_no", "row_no", "by", "icon_top")).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for (_, r), image in zip(b.iterrows(), vision.pictures(b), strict=True):
                for row in r["rows"]:
                    part = np.ascontiguousarray(vision.crop(image, (x, row["by"], w, h)))
                    thumb = vision.shrink(vision.gray(part), *ROW_THUMB).ravel().tolist()
                    patch = vision.crop(image, (at["type_icon_x"], row["icon_top"] + at["type_icon_dy"], at["type_icon_w"], at["type_icon_h"])).reshape(-1, 3)
                    colour = np.median(patch, axis=0).tolist() if len(patch) else [None] * 3
                    out.append((r["group_id"], row["segment_no"], r["ord"], row["row_no"], thumb, part.tobytes(), part.shape[0], part.shape[1], *colour))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CROPS.split(", ")])

    return frames.join(lists, ["group_id", "ord"]).mapInPandas(run, CROPS)


def read_rows(crops: DataFrame, options: Options) -> DataFrame:
    """The texts of rows: ``group_id``, ``segment_no``, ``ord``, ``row_no``, ``text``, ``confidence``.

    A segment's rows that look like one before have its text; only the others are read, ``BATCH`` at a time, and once more in an enlargement
    where the reader has little confidence.
    """
    key = ["group_id", "segment_no", "ord", "row_no"]
    place = F.col("ord") * 64 + F.col("row_no")  # a frame has a handful of rows
    keyed = crops.withColumns({"segment_id": F.xxhash64("group_id", "segment_no"), "place": place})
    led = nearest.row_leaders(keyed.select("segment_id", F.col("place").alias("ord"), "thumb"))
    leaders = keyed.join(led.filter("is_leader").select("segment_id", F.col("ord").alias("place")), ["segment_id", "place"], "left_semi")
    make = options.reader

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for b in batches:
            out = []
            for at in range(0, len(b), vision.BATCH):
                some = b.iloc[at : at + vision.BATCH]
                images = [np.frombuffer(c, np.uint8).reshape(h, w, 3) for c, h, w in zip(some["crop"], some["height"], some["width"], strict=True)]
                boxes = [(0, 0, i.shape[1], i.shape[0]) for i in images]
                for s, p, image, box, found in zip(some["segment_id"], some["place"], images, boxes, reader.recognize_batch(images, [[b] for b in boxes], text.ALLOWED), strict=True):
                    best = max(found[0], key=lambda r: r[1], default=("", 0.0, []))
                    if best[1] < votes.TRUST and (again := max(reader.read_texts(image, box, vision.ENLARGED), key=lambda r: r[1], default=("", 0.0, []))[0]):
                        best = (again, best[1], [])
                    out.append((s, p, best[0], float(best[1])))
            yield pd.DataFrame(out, columns=["segment_id", "leader", "text", "confidence"])

    texts = leaders.select("segment_id", "place", "crop", "height", "width").mapInPandas(run, "segment_id long, leader long, text string, confidence double")
    of = led.select("segment_id", F.col("ord").alias("place"), "leader").join(texts, ["segment_id", "leader"])
    return keyed.select(*key, "segment_id", "place").join(of, ["segment_id", "place"]).select(*key, "text", "confidence")


def observations(frames: DataFrame, served: DataFrame, items: DataFrame, width: int, height: int, options: Options) -> DataFrame:
    """What the rows of list frames say: ``group_id``, ``segment_no``, ``ord``, ``row_no``, ``raw``, ``observed_type``, ``canonical``.

    ``served``: ``group_id``, ``ord``, ``segment_no`` of the frames to read; a frame may serve two segments. Rows without text are left out.
    """
    images = among(frames, served)
    boxes = row_boxes(images, width, height).join(served, ["group_id", "ord"])
    crops = files.kept(row_crops(images, files.kept(boxes), width, height))
    typed = nearest.nearest_colour(crops, nearest.reference_colours(frames.sparkSession)).select("group_id", "segment_no", "ord", "row_no", "crop", F.col("type").alias("observed_type"))
    read = files.kept(read_rows(crops, options).filter("text <> ''").withColumnRenamed("text", "raw"))
    seen = fuzzy.canonical_texts(read.join(typed, ["group_id", "segment_no", "ord", "row_no"]), items, options.accept_item, options.ascii_names)
    if options.row_sink:
        options.row_sink(seen.select("group_id", "segment_no", "ord", "row_no", "crop", F.col("canonical").alias("text"), "observed_type"))
    return seen.select("group_id", "segment_no", "ord", "row_no", "raw", "observed_type", "canonical")


def collect(frames: DataFrame, found: DataFrame, items: DataFrame, width: int, height: int, options: Options, templates: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phase two: accepted items (``group_id``, ``segment_no``, ``pos``, ``item``) of the segments ``found``, doubtful names with their candidates, and
    the frames' kinds, which teach more templates.
    """
    known = kinds(frames, options, templates)
    marked = timeline.to_read(known).filter("vote")
    served = files.kept(segments.frames_of_segments(marked, found, options.index_fps).select("group_id", "ord", "segment_no"))
    seen = files.kept(observations(frames, served, items, width, height, options))
    counted = votes.votes(seen.select(F.struct("group_id", "segment_no").alias("segment_id"), F.col("canonical").alias("name"), F.col("ord").alias("frame_idx"), "row_no"), options.least_votes)
    good, doubtful = votes.accepted_items(counted, items, options.accept_item, options.ascii_names)
    return good.select("segment_id.*", "pos", "item"), doubtful.select("segment_id.*", "raw", "candidates"), known
