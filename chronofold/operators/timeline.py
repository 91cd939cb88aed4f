"""Frames to a classified timeline. A timeline is one sequence by ``group_id``, scanned in slots of time (``scan``), so a long recording is many tasks'."""

from __future__ import annotations

import math
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, TimestampNTZType, TimestampType

from ..functions.similarity import mean_abs_diff
from .scan import KEY, SLOT, keyed, scan, time_slot

#: Files, and frames of a file, that are one slot of a scan.
FILES, FRAMES = 4096, 1 << 18
FALLBACK_FPS = 30.0
SAME_FRAME = 2.0
DARK = 40.0


def check_rates(fps: float, start: float | None = None, end: float | None = None) -> None:
    if not (math.isfinite(fps) and fps > 0):
        raise ValueError(f"fps must be finite and positive: {fps}")
    if start is not None and end is not None and end <= start:
        raise ValueError(f"end {end} must be after start {start}")


def safe_fps(c: Column) -> Column:
    """A usable rate: what is null, not finite or not positive becomes 30."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (c <= 0) | (c == float("inf")), FALLBACK_FPS).otherwise(c)


def thin(frames: DataFrame, fps: float) -> DataFrame:
    """Frames on the grid of a target rate: every ``max(1, round(src_fps / fps))``-th of each file, rounding halves to even."""
    check_rates(fps)
    step = F.greatest(F.lit(1), F.bround(safe_fps(F.col("src_fps")) / fps).cast("int"))
    return frames.withColumn("step", step).filter(F.col("frame_idx") % F.col("step") == 0)


def valid_rate(c: Column) -> Column:
    """Whether a target rate is finite and positive: ``check_rates`` for a column."""
    c = c.cast("double")
    return F.coalesce((c > 0) & (c < float("inf")) & ~F.isnan(c), F.lit(False))


def in_range(frames: DataFrame, start: float | None = None, end: float | None = None, column: str = "ts") -> DataFrame:
    """Frames of [start, end) seconds on the joined timeline.

    The bounds are written in the column's own type (seconds as a double or whole number, or a timestamp as seconds since 1970), so they
    reach the scan.
    """
    kind = frames.schema[column].dataType

    def bound(seconds: float) -> Column:
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            at = datetime(1970, 1, 1, tzinfo=None if isinstance(kind, TimestampNTZType) else UTC) + timedelta(seconds=seconds)
            return F.lit(at).cast(kind)
        return F.lit(math.ceil(seconds) if isinstance(kind, IntegralType) else float(seconds)).cast(kind)

    if start is not None:
        frames = frames.filter(F.col(column) >= bound(start))
    return frames if end is None else frames.filter(F.col(column) < bound(end))


def offsets(videos: DataFrame) -> DataFrame:
    """``videos`` (``group_id``, ``video_seq``, ``frame_count``, ``src_fps``) with ``offset``, seconds before each on the joined timeline."""
    files = keyed(videos, F.floor(F.col("video_seq") / FILES))
    return scan(files, ["video_seq"], total={"offset": F.col("frame_count") / safe_fps(F.col("src_fps"))}).drop(KEY)


def number_frames(frames: DataFrame, files: int = 1) -> DataFrame:
    """A running frame number over a group's files, from 0. ``files``: how many of them are one slot; a long file is several."""
    slot = F.struct(F.floor(F.col("video_seq") / files).alias("files"), (F.floor(F.col("frame_idx") / FRAMES) if files == 1 else F.lit(0)).alias("part"))
    return scan(keyed(frames, slot), ["video_seq", "frame_idx"], total={"global_idx": F.lit(1)}).drop(KEY)


def group_videos(videos: DataFrame) -> DataFrame:
    """One row for each resolution, in order of first sight, with its files in order."""
    return videos.groupBy("width", "height").agg(F.min("video_seq").alias("first_seq"), F.transform(F.array_sort(F.collect_list(F.struct("video_seq", "path"))), lambda s: s["path"]).alias("paths")).withColumn("group_no", F.row_number().over(Window.orderBy("first_seq")))


# Where things are on a screen of 1280 by 720.
LAYOUT = {
    "header": (80, 95, 400, 50), "box_name": (817, 113, 315, 38), "move_slot_x": 142, "move_slot_w": 228, "move_slot_h": 50, "move_slot_ys": (220, 287, 354, 421, 488, 555),
    "type_icon_x": 86, "type_icon_w": 9, "type_icon_dy": 19, "type_icon_h": 12,
}
_SIZED = ("move_slot_w", "move_slot_h", "type_icon_w", "type_icon_h")


def layout(width: Column, height: Column, base: dict = LAYOUT) -> list[Column]:
    """The layout's columns for a resolution: truncated products, sizes at least 1."""
    if len(base["move_slot_ys"]) < 2:
        raise ValueError("a layout needs two rows to tell their distance")
    sx, sy = width / 1280, height / 720
    cut = lambda v, s: (F.lit(float(v)) * s).cast("int")
    box = lambda b: F.struct(cut(b[0], sx).alias("x"), cut(b[1], sy).alias("y"), F.greatest(F.lit(1), cut(b[2], sx)).alias("w"), F.greatest(F.lit(1), cut(b[3], sy)).alias("h"))
    out = [box(base["header"]).alias("header"), box(base["box_name"]).alias("box_name"), F.array(*(cut(y, sy) for y in base["move_slot_ys"])).alias("move_slot_ys")]
    for k, v in base.items():
        if isinstance(v, int):
            one = cut(v, sx if k.endswith(("_x", "_w")) else sy)
            out.append((F.greatest(F.lit(1), one) if k in _SIZED else one).alias(k))
    return out


def resolved(width: int, height: int, base: dict = LAYOUT) -> dict:
    """The layout of one resolution as plain numbers, as ``layout`` gives it in columns."""
    sx, sy = width / 1280, height / 720
    out = {}
    for k, v in base.items():
        if k == "move_slot_ys":
            out[k] = tuple(int(y * sy) for y in v)
        elif isinstance(v, tuple):
            out[k] = (int(v[0] * sx), int(v[1] * sy), max(1, int(v[2] * sx)), max(1, int(v[3] * sy)))
        else:
            one = int(v * (sx if k.endswith(("_x", "_w")) else sy))
            out[k] = max(1, one) if k in _SIZED else one
    return out


def _order(frames: DataFrame) -> list[str]:
    """A group's frames go by time; those of one time by ``ord``, where there is one."""
    return ["ts", *(c for c in ("ord",) if c in frames.columns)]


def similar(now: Column, before: Column, most: float = SAME_FRAME) -> Column:
    """Whether two thumbs are one picture; false where one is missing or shapes differ."""
    return F.coalesce(mean_abs_diff(now, before) < most, F.lit(False))


def changed_headers(frames: DataFrame, slot: float = SLOT) -> DataFrame:
    """Marks (``changed``) frames whose header isn't that of the frame before: those whose kind must be read."""
    seen = scan(keyed(frames, time_slot(F.col("ts"), slot)), _order(frames), before={"_header": F.col("header_thumb")})
    return seen.withColumn("changed", ~similar(F.col("header_thumb"), F.col("_header"))).drop("_header", KEY)


def carry_kind(frames: DataFrame, slot: float = SLOT) -> DataFrame:
    """``kind`` of each frame: what a reader says (``read_kind``), or the kind before while the header stays the same from frame to frame.

    One scan: whether a slot's first header is the one before is told among the rows that slots hand on, as it needs the slot before.
    """
    order = _order(frames)
    w, at = Window.partitionBy(KEY).orderBy(*order), F.struct(*order)
    before = F.lag(F.struct(F.col("header_thumb").alias("v"))).over(w)
    seen = keyed(frames, time_slot(F.col("ts"), slot)).withColumn("_header", before)
    own = F.when(F.col("_header").isNotNull() & ~similar(F.col("header_thumb"), F.col("_header.v")), F.col("read_kind"))
    seen = seen.withColumn("_own", own)
    within = seen.withColumn("_own", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    slots = seen.groupBy(KEY).agg(F.min_by(F.struct("header_thumb", "read_kind"), at).alias("first"), F.max_by("header_thumb", at).alias("end"), F.max_by("_own", F.when(F.col("_own").isNotNull(), at)).alias("told"))
    so = Window.partitionBy(f"{KEY}.of").orderBy(f"{KEY}.slot")
    begun = slots.withColumn("begins", F.when(~similar(F.col("first.header_thumb"), F.lag("end").over(so)), F.col("first.read_kind")))
    told = F.last(F.coalesce("told", "begins"), ignorenulls=True).over(so.rowsBetween(Window.unboundedPreceding, -1))
    handed = begun.select(KEY, F.coalesce("begins", told).alias("_before"))
    return within.join(handed, KEY).withColumn("kind", F.coalesce("_own", "_before")).drop("_own", "_header", "_before", KEY)


def to_read(frames: DataFrame, slot: float = SLOT) -> DataFrame:
    """Marks for the costly readers. ``vote``: list frames whose rows need reading (not a still after a list frame). ``box_read``: bright other frames whose box changed since the last bright other frame in a row."""
    before = {f"_{c}": F.col(c) for c in ("kind", "slot_thumb", "box_thumb", "mean_luma")}
    seen = scan(keyed(frames, time_slot(F.col("ts"), slot)), _order(frames), before=before)
    still = (F.col("_kind") == "move_list") & similar(F.col("slot_thumb"), F.col("_slot_thumb"))
    bright = (F.col("kind") == "other") & (F.col("mean_luma") > DARK)
    was_bright = F.coalesce((F.col("_kind") == "other") & (F.col("_mean_luma") > DARK), F.lit(False))
    marks = {"vote": (F.col("kind") == "move_list") & ~F.coalesce(still, F.lit(False)), "box_read": bright & ~(was_bright & similar(F.col("box_thumb"), F.col("_box_thumb")))}
    return seen.withColumns(marks).drop(*before, KEY)
