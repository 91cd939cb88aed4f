"""Nearest-neighbour joins with small tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity

# Reference colours (blue, green, red) of the types, in the order that ties follow.
COLOURS = {
    "あく": (64, 60, 79), "ノーマル": (161, 160, 161), "ほのお": (42, 19, 215), "ひこう": (238, 187, 134), "ゴースト": (112, 54, 109), "はがね": (185, 164, 102),
    "ドラゴン": (221, 88, 85), "かくとう": (9, 123, 241), "エスパー": (119, 41, 224), "じめん": (38, 75, 138), "フェアリー": (238, 88, 232), "くさ": (45, 178, 71),
    "いわ": (132, 169, 176), "むし": (34, 172, 147), "みず": (235, 128, 48), "でんき": (10, 197, 244), "どく": (199, 45, 138), "こおり": (251, 228, 79),
}
MOST_COLOUR_DISTANCE = 2500
TEMPLATE_DISTANCE, ROW_DISTANCE = 5.0, 12.0
ROW_SHAPE, ROW_LIMIT = (24, 96), 1024
MOST_TEMPLATES, MOST_COLOURS = 1000, 1000


def reference_colours(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t, float(b), float(g), float(r)) for k, (t, (b, g, r)) in enumerate(COLOURS.items())], "ord int, type string, b double, g double, r double")


def nearest_colour(samples: DataFrame, colours: DataFrame, most: float = MOST_COLOUR_DISTANCE) -> DataFrame:
    """``samples`` (``cb``, ``cg``, ``cr``) with the ``type`` of the nearest colour within ``most`` (squared, inclusive), else null; first in ``ord`` on ties.

    The colours become one array literal of a handful of rows: the join is an expression, without shuffle or join.
    """
    rows = [tuple(r) for r in colours.select("ord", "type", "b", "g", "r").orderBy("ord").limit(MOST_COLOURS + 1).collect()]
    if not 0 < len(rows) <= MOST_COLOURS:
        raise ValueError(f"from 1 to {MOST_COLOURS} reference colours")
    near = F.least(*[F.struct(similarity.squared_distance([F.col("cb"), F.col("cg"), F.col("cr")], [F.lit(b), F.lit(g), F.lit(r)]).alias("d2"), F.lit(o).alias("ord"), F.lit(t).alias("type")) for o, t, b, g, r in [*rows, rows[0]]])
    return samples.withColumn("near", near).withColumn("type", F.when(F.col("near.d2") <= most, F.col("near.type"))).withColumn("d2", F.col("near.d2")).drop("near")


def median_colour(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The median of each channel (``b``, ``g``, ``r``) by patch."""
    return pixels.groupBy(*keys).agg(*(F.median(c).alias(f"c{c}") for c in "bgr"))


def classify_by_templates(frames: DataFrame, templates: DataFrame, most: float = TEMPLATE_DISTANCE) -> DataFrame:
    """``frames`` with the ``kind`` of the nearest template (``ord``, ``kind``, ``ref``) if nearer than ``most``; null otherwise, for a reader to decide.

    The templates, capped when learnt and checked here, travel as one array in one broadcast row: no frame is multiplied or shuffled.
    """
    n = templates.count()
    if n > MOST_TEMPLATES:
        raise ValueError(f"{n} templates; at most {MOST_TEMPLATES} fit one row")
    known = templates.agg(F.collect_list(F.struct("ord", "kind", "ref")).alias("known"))
    near = F.array_min(F.transform("known", lambda t: F.struct(similarity.mean_abs_diff(F.col("thumb"), t["ref"]).alias("d"), t["ord"].alias("ord"), t["kind"].alias("kind"))))
    best = frames.crossJoin(F.broadcast(known)).withColumn("best", near).drop("known")
    return best.withColumn("distance", F.col("best.d")).withColumn("kind", F.when(F.col("best.d") < most, F.col("best.kind"))).drop("best")


#: Rows of frames that one task takes.
FRAME_ROWS = 250_000


def dealt(rows: DataFrame, frame: str) -> DataFrame:
    """``rows`` dealt to tasks by ``frame``, so many that a task's share doesn't grow with the input; what follows by frame needs no other exchange."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FRAME_ROWS)), frame)


def nearest_box(results: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each result (``frame_id``, ``res_no``, ``cy``) goes to its frame's box (``box_no``, ``by``) of the nearest centre; the first on ties."""
    return results.join(boxes, "frame_id").groupBy("frame_id", "res_no").agg(F.min_by("box_no", F.struct(F.abs(F.col("cy") - F.col("by")), "box_no")).alias("box_no"))


def _placed(rows: DataFrame, by: str, count: str) -> DataFrame:
    """``rows`` with their place ``k`` in their frame, and how many the frame has."""
    w = Window.partitionBy("frame_id")
    return rows.withColumns({"k": F.row_number().over(w.orderBy(by)), count: F.count("*").over(w)})


def zip_boxes(results: DataFrame, boxes: DataFrame) -> DataFrame:
    """Results and boxes of a frame by their places in order, where the frame has as many of either; other frames give nothing."""
    r, b = _placed(results.select("frame_id", "res_no"), "res_no", "n_results"), _placed(boxes.select("frame_id", "box_no"), "box_no", "n_boxes")
    return r.join(b, ["frame_id", "k"]).filter("n_results = n_boxes").select("frame_id", "res_no", "box_no")


def assign_boxes(results: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each result's box: by place where a frame has as many results as boxes, else the nearest. Results in frames without boxes go."""
    count = lambda rows, name: rows.groupBy("frame_id").agg(F.count("*").alias(name))
    odd = count(results, "n_results").join(count(boxes, "n_boxes"), "frame_id").filter("n_results <> n_boxes").select("frame_id")
    return zip_boxes(results, boxes).unionByName(nearest_box(results.join(odd, "frame_id", "left_semi"), boxes))


LEADER = "segment_id long, ord long, leader long, is_leader boolean"


class Leaders:
    """Known thumbs of one segment, up to ``limit``, in arrays that never grow beyond that.

    The difference of two cells' means is at most the mean difference of their pixels. So a known thumb whose cell means tell that it is no
    nearer than ``most`` is left out, at a sixtieth of a comparison's cost; ``compared`` counts the others.
    """

    def __init__(self, limit: int, most: float, shape: tuple[int, int] = ROW_SHAPE, grid: tuple[int, int] = (12, 3)) -> None:
        self.limit, self.most, self.shape, self.grid, self.n, self.compared = limit, most, shape, grid, 0, 0
        self.thumbs, self.cells = np.zeros((16, *shape), np.int16), np.zeros((16, grid[0] * grid[1]), np.int64)
        self.seen: dict[bytes, tuple[int | None, float, int]] = {}  # up to ``limit`` thumbs: the nearest, how far, of how many

    def _cells(self, one: np.ndarray) -> np.ndarray:
        (h, w), (cols, rows) = self.shape, self.grid
        return one.reshape(rows, h // rows, cols, w // cols).sum(axis=(1, 3), dtype=np.int64).ravel()

    def nearest(self, one: np.ndarray) -> int | None:
        """The place of the nearest known thumb that is nearer than ``most``, the first on ties. A thumb seen before is compared only with those known since."""
        pixels, key = self.shape[0] // self.grid[1] * (self.shape[1] // self.grid[0]), one.astype(np.int16, copy=False).tobytes()
        best, least, since = self.seen.get(key, (None, self.most, 0))
        if since < self.n:
            near = since + np.flatnonzero(np.abs(self.cells[since : self.n] - self._cells(one)).max(axis=1, initial=0) < self.most * pixels)
            self.compared += len(near)
            if len(near):
                far = similarity.cell_max_all(self.thumbs[near], one, self.grid)
                k = int(far.argmin())
                if far[k] < least:
                    best, least = int(near[k]), float(far[k])
            if since or len(self.seen) < self.limit:
                self.seen[key] = best, least, self.n
        return best

    def add(self, one: np.ndarray) -> bool:
        if self.n == self.limit:
            return False
        if self.n == len(self.thumbs):
            more = min(self.limit, 2 * self.n) - self.n
            self.thumbs, self.cells = (np.concatenate([x, np.zeros((more, *x.shape[1:]), x.dtype)]) for x in (self.thumbs, self.cells))
        self.thumbs[self.n], self.cells[self.n] = one, self._cells(one)
        self.n += 1
        return True


def row_leaders(rows: DataFrame, limit: int = ROW_LIMIT, most: float = ROW_DISTANCE) -> DataFrame:
    """Online leader clustering of row thumbs by segment: a row within ``most`` (strict, by grid cells) of a known one follows it, else it leads and is remembered, up to ``limit``.

    ``rows``: ``segment_id``, ``ord`` (unique in a segment), ``thumb``. Returns ``segment_id``, ``ord``, ``leader`` (the ``ord`` whose text the row
    has; its own if it leads), ``is_leader``. So only leaders need a reader. Rows come sorted, and a task holds the known thumbs of one segment
    beside a batch of rows, however long the segment is.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, known, names = None, Leaders(limit, most), []
        for b in (whole.slice(k, ROW_LIMIT) for whole in batches for k in range(0, whole.num_rows, ROW_LIMIT)):
            leaders = []
            thumbs = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int16).reshape(-1, *ROW_SHAPE)
            for s, at, one in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), thumbs, strict=True):
                if s != segment:
                    segment, known, names = s, Leaders(limit, most), []
                best = known.nearest(one)
                if best is not None:
                    leaders.append(names[best])
                    continue
                if known.add(one):
                    names.append(at)
                leaders.append(at)
            leader = pa.array(leaders, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), leader, pc.equal(leader, b.column(1))], names=["segment_id", "ord", "leader", "is_leader"])

    placed = rows.select(F.col("segment_id").cast("long").alias("segment_id"), F.col("ord").cast("long").alias("ord"), "thumb")
    return placed.repartition("segment_id").sortWithinPartitions("segment_id", "ord").mapInArrow(fold, LEADER)


def row_texts(rows: DataFrame, limit: int = ROW_LIMIT, most: float = ROW_DISTANCE) -> DataFrame:
    """``row_leaders`` for rows that have a ``text`` (what a reader gives): ``segment_id``, ``ord``, ``cached_text`` (the leader's), ``was_cached``."""
    led = row_leaders(rows, limit, most)
    texts = rows.select("segment_id", F.col("ord").alias("leader"), F.col("text").alias("cached_text"))
    return led.join(texts, ["segment_id", "leader"]).select("segment_id", "ord", "cached_text", (~F.col("is_leader")).alias("was_cached"))


def learn_templates(frames: DataFrame, limit: int = 32, most: float = TEMPLATE_DISTANCE) -> DataFrame:
    """Online template learning by group: frames (``group_id``, ``ts``, ``thumb``, ``read_kind``) in order; once a detail and a list template are
    known, near ones classify a frame, and all others are read and remembered by kind, up to ``limit``. ``learnt`` marks the remembered ones.
    """

    def fold(batches: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        pdf = batches.sort_values("ts", kind="stable")
        known: dict[str, list[np.ndarray]] = {}
        kinds, by_template, learnt = [], [], []
        for thumb, read in zip(pdf["thumb"], pdf["read_kind"], strict=True):
            one, kind = np.asarray(thumb, np.int32), None
            if "detail" in known and "move_list" in known:
                near = [(np.abs(one - t).mean(), k) for k, ts in known.items() for t in ts]
                d, k = min(near, key=lambda x: x[0])
                kind = k if d < most else None
            by_template.append(kind is not None)
            learnt.append(False)
            if kind is None:
                kind = read
                own = known.setdefault(kind, [])
                if len(own) < limit and all(np.abs(one - t).mean() >= most for t in own):
                    own.append(one)
                    learnt[-1] = True
            kinds.append(kind)
        return pd.DataFrame({"group_id": pdf["group_id"], "ts": pdf["ts"], "kind": kinds, "by_template": by_template, "learnt": learnt})

    return frames.groupBy("group_id").applyInPandas(fold, "group_id string, ts double, kind string, by_template boolean, learnt boolean")


#: Seconds whose frames one task looks through for templates.
TEMPLATE_SLOT = 600.0
TEMPLATES = "group_id string, ts double, kind string, thumb array<int>"


def _remembered(rows: pd.DataFrame, known: pd.DataFrame, limit: int, most: float) -> pd.DataFrame:
    """Rows in order that are no nearer than ``most`` to a known one of their kind, each of which is known from then on."""
    store: dict[str, list[np.ndarray]] = {}
    for kind, thumb in zip(known["kind"], known["thumb"], strict=True):
        store.setdefault(kind, []).append(np.asarray(thumb, np.int32))
    rows, new = rows.sort_values("ts", kind="stable"), []
    for k, (kind, thumb) in enumerate(zip(rows["kind"], rows["thumb"], strict=True)):
        one, own = np.asarray(thumb, np.int32), store.setdefault(kind, [])
        if len(own) < limit and all(len(one) != len(t) or np.abs(one - t).mean() >= most for t in own):
            own.append(one)
            new.append(k)
    return rows.iloc[new][["group_id", "ts", "kind", "thumb"]]


def new_templates(read: DataFrame, known: DataFrame, limit: int = 32, most: float = TEMPLATE_DISTANCE, slot: float = TEMPLATE_SLOT) -> DataFrame:
    """Templates (``TEMPLATES``) that frames which were read (``group_id``, ``ts``, ``kind``, ``thumb``) add to ``known`` ones of their groups.

    A recording's frames are looked through by slots of time, each in a task of its own; what these find, at most ``limit`` a kind and slot,
    is taken up in order by the recording.
    """
    read = read.select("group_id", F.col("ts").cast("double").alias("ts"), "kind", F.col("thumb").cast("array<int>").alias("thumb")).filter("kind is not null and thumb is not null")
    none = pd.DataFrame({"kind": [], "thumb": []})
    found = read.groupBy("group_id", F.floor(F.col("ts") / slot).alias("slot")).applyInPandas(lambda _, rows: _remembered(rows, none, limit, most), TEMPLATES)
    return found.groupBy("group_id").cogroup(known.select("group_id", "ts", "kind", "thumb").groupBy("group_id")).applyInPandas(lambda rows, old: _remembered(rows, old.sort_values("ts", kind="stable"), limit, most), TEMPLATES)


def ready(templates: DataFrame) -> bool:
    """Whether templates can tell frames: only once there are ones of a detail and of a list."""
    return templates.filter("kind in ('detail', 'move_list')").select("kind").distinct().count() == 2
