"""Frames of recordings as a Spark data source, one partition for each slice of a file.

``.npy`` stacks (frames, height, width, 3) are read with numpy; other files with OpenCV where it is installed.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "group_id string, video_seq int, frame_idx long, ts double, height int, width int, image binary"


class Slice(InputPartition):
    def __init__(self, path: str, seq: int, first: int, last: int, fps: float, offset: float) -> None:
        self.path, self.seq, self.first, self.last, self.fps, self.offset = path, seq, first, last, fps, offset


def probe(path: str) -> tuple[int, int, int]:
    """Frames, height and width of a file; an error for one that can't be read or has no picture."""
    if path.endswith(".npy"):
        shape = np.load(path, mmap_mode="r").shape
        n, h, w = shape[:3] if len(shape) == 4 else (0, 0, 0)
    else:
        try:
            import cv2
        except ImportError as e:
            raise RuntimeError(f"OpenCV is needed to read {path}") from e
        cap = cv2.VideoCapture(path)
        n, h, w = (int(cap.get(x)) for x in (cv2.CAP_PROP_FRAME_COUNT, cv2.CAP_PROP_FRAME_HEIGHT, cv2.CAP_PROP_FRAME_WIDTH))
        cap.release()
    if min(h, w) <= 0:
        raise ValueError(f"no picture in {path}")
    return n, h, w


def decode(path: str, first: int, last: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """Frames of [first, last) on the grid of ``step`` from the file's beginning; others aren't decoded."""
    begin = -(-first // step) * step
    if path.endswith(".npy"):
        stack = np.load(path, mmap_mode="r")
        for k in range(begin, min(last, len(stack)), step):
            yield k, np.array(stack[k])
        return
    import cv2

    cap = cv2.VideoCapture(path)
    try:
        cap.set(cv2.CAP_PROP_POS_FRAMES, begin)
        for k in range(begin, last):
            if not cap.grab():
                return
            if k % step == 0:
                ok, image = cap.retrieve()
                if ok:
                    yield k, image
    finally:
        cap.release()


class FrameSource(DataSource):
    """Options: ``paths`` (comma-separated, on a folder that all executors see), ``group``, ``fps`` (target), ``src_fps`` (one rate, or one for each path,
    comma-separated; a video file's own where it isn't given), ``start``, ``end``, ``ranges`` (``from:to`` in seconds, comma-separated: only
    frames within one of them), ``slice`` (frames).

    With ``push``, bounds on ``ts``, and bounds and lists of ``video_seq`` and ``frame_idx``, that a query filters by reach the reader (by
    ``spark.sql.python.filterPushdown.enabled``, which ``read_frames`` sets): slices that can't have such frames aren't opened. This is for a
    DataFrame that one query uses: Spark keeps what a query has pushed into a Python source for the later ones over the same DataFrame.

    As a stream: instead of ``paths`` a ``folder``, whose files come one after the other in the order of their names, and ``per_trigger``, frames
    of a micro-batch at most. The last file may still grow: offsets are by file and frame.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushedFrameReader if self.options.get("push") == "true" else FrameReader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FrameStream(self.options)


def read_frames(spark: SparkSession, push: bool = False, **options: str) -> DataFrame:
    """The frames of ``FrameSource``'s options; with ``push``, for one query, whose filters then reach the source."""
    spark.dataSource.register(FrameSource)
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("frames").options(push=str(push).lower(), **options).load()


class Bounds:
    """The least and the largest value that pushed filters leave, and the list of those allowed."""

    def __init__(self) -> None:
        self.least, self.most, self.only = (float("-inf"), False), (float("inf"), True), None  # the second: whether the bound itself is out, or in

    def take(self, f: Filter) -> bool:
        """Whether ``f`` bounds slices."""
        if isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.least = max(self.least, (float(f.value), isinstance(f, GreaterThan)))
        elif isinstance(f, LessThan | LessThanOrEqual):
            self.most = min(self.most, (float(f.value), isinstance(f, LessThanOrEqual)))
        elif isinstance(f, EqualTo | In):
            values = {float(v) for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
            self.only = values if self.only is None else self.only & values
        else:
            return False
        return True

    def meets(self, first: float, last: float) -> bool:
        """Whether a value of [first, last] may be asked for."""
        (a, out), (z, in_) = self.least, self.most
        return (last > a or last == a and not out) and (first < z or first == z and in_) and (self.only is None or any(first <= v <= last for v in self.only))


class FrameReader(DataSourceReader):
    def __init__(self, options) -> None:
        from ..operators.timeline import check_rates

        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.group, self.fps, self.rates = options.get("group", ""), float(options.get("fps", 5)), options.get("src_fps", "")
        self.start, self.end, self.slice = float(options.get("start", 0)), float(options.get("end", "inf")), int(options.get("slice", 3000))
        ranges = sorted((float(a), float(z)) for a, z in (x.split(":") for x in options.get("ranges", "").split(",") if x))
        self.ranges: list[tuple[float, float]] = []
        for a, z in ranges:  # joined, so that one search finds a time's range
            if self.ranges and a <= self.ranges[-1][1]:
                self.ranges[-1] = (self.ranges[-1][0], max(z, self.ranges[-1][1]))
            else:
                self.ranges.append((a, z))
        self.begins = [a for a, _ in self.ranges]
        self.bounds = {name: Bounds() for name in ("ts", "video_seq", "frame_idx")}
        check_rates(self.fps, self.start, self.end)

    def partitions(self) -> list[Slice]:
        out, offset = [], 0.0
        for video in probed(self.paths, self.rates):
            n, src = video["frame_count"], video["src_fps"]
            for a in range(0, n, self.slice):
                z = min(n, a + self.slice)
                known = self.bounds["video_seq"].meets(video["video_seq"], video["video_seq"]) and self.bounds["frame_idx"].meets(a, z - 1) and self.bounds["ts"].meets(offset + a / src, offset + (z - 1) / src)
                if known and self.wanted(offset + a / src, offset + z / src):  # slices out of range aren't opened
                    out.append(Slice(video["path"], video["video_seq"], a, z, src, offset))
            offset += n / src
        return out or [Slice("", 0, 0, 0, FALLBACK_FPS, 0.0)]

    def wanted(self, first: float, last: float) -> bool:
        """Whether frames of [first, last) may be asked for."""
        if last <= self.start or first >= self.end:
            return False
        k = bisect_right(self.begins, last)
        return not self.ranges or any(last > a and first < z for a, z in self.ranges[max(0, bisect_right(self.begins, first) - 1) : k])

    def inside(self, ts: float) -> bool:
        """Whether a frame of this time is asked for."""
        k = bisect_right(self.begins, ts) - 1
        return self.start <= ts < self.end and (not self.ranges or k >= 0 and ts < self.ranges[k][1])

    def read(self, part: Slice) -> Iterator[tuple]:
        if not part.path:
            return
        step = max(1, round(part.fps / self.fps))
        for k, image in decode(part.path, part.first, part.last, step):
            ts = part.offset + k / part.fps
            if self.inside(ts):
                yield self.group, part.seq, k, ts, image.shape[0], image.shape[1], image.tobytes()


class PushedFrameReader(FrameReader):
    """A reader that takes a query's filters; a class of its own, as Spark lets no reader have them while its setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes bounds for slices; all filters stay Spark's too, frame by frame."""
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in self.bounds:
                self.bounds[f.attribute[0]].take(f)
            yield f


class FrameStream(DataSourceStreamReader):
    """Offsets: how many files are done, the file being read and its frames so far, and the seconds before it."""

    def __init__(self, options) -> None:
        self.whole = FrameReader(options)
        self.folder, self.most = options["folder"], int(options.get("per_trigger", 1 << 20))
        self.at = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "seq": -1, "frame": 0, "frames": 0, "seconds": 0.0}

    def _steps(self, start: dict, end: dict | None = None) -> Iterator[tuple[dict, str, int, int, float]]:
        """Offsets after ``start``, each with the path, the frames from and to, and the rate that lead to it."""
        names = sorted(n for n in os.listdir(self.folder) if not n.startswith((".", "_")) and n >= start["file"])
        now, left = dict(start), self.most
        for name in names:
            if end is not None and (name > end["file"]):
                return
            path = f"{self.folder}/{name}"
            n = probe(path)[0] if end is None or name < end["file"] else end["frame"]
            rate = safe_rate(float(self.whole.rates.split(",")[0])) if self.whole.rates else own_rate(path)
            if name != now["file"]:
                now = {"file": name, "seq": now["seq"] + 1, "frame": 0, "frames": 0, "seconds": now["seconds"] + now["frames"] / rate}
            first, last = now["frame"], n if end is not None else min(n, now["frame"] + left)
            if last > first:
                now = now | {"frame": last, "frames": last}
                left -= last - first
                yield now, path, first, last, rate
            if last < n or left <= 0 and end is None:
                return

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = self.at or self.initialOffset()
        for now, *_ in self._steps(self.at):
            self.at = now
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.at = end if self.at is None else self.at
        out = []
        for now, path, first, last, rate in self._steps(start, end):
            out += [Slice(path, now["seq"], a, min(last, a + self.whole.slice), rate, now["seconds"]) for a in range(first, last, self.whole.slice)]
        return out

    def read(self, part: Slice) -> Iterator[tuple]:
        return self.whole.read(part)


FALLBACK_FPS = 30.0
VIDEOS = "video_seq int, path string, frame_count long, src_fps double, width int, height int"


def safe_rate(rate: float) -> float:
    """A usable rate: what isn't finite and positive becomes 30."""
    return rate if 0 < rate < float("inf") else FALLBACK_FPS


def own_rate(path: str) -> float:
    """The rate that a video file names; stacks name none."""
    if path.endswith(".npy"):
        return FALLBACK_FPS
    import cv2

    cap = cv2.VideoCapture(path)
    try:
        return safe_rate(float(cap.get(cv2.CAP_PROP_FPS)))
    finally:
        cap.release()


def probed(paths: list[str], rates: str = "") -> list[dict]:
    """What is known of each file without decoding it: a row of ``VIDEOS``. An error for one that can't be read or has no picture."""
    given = [safe_rate(float(r)) for r in rates.split(",") if r]
    if len(given) not in (0, 1, len(paths)):
        raise ValueError(f"{len(given)} rates for {len(paths)} files")
    out = []
    for seq, path in enumerate(paths):
        n, h, w = probe(path)
        rate = given[seq if len(given) > 1 else 0] if given else own_rate(path)
        out.append({"video_seq": seq, "path": path, "frame_count": n, "src_fps": rate, "width": w, "height": h})
    return out


def manifest(spark: SparkSession, paths: list[str], rates: str = "") -> DataFrame:
    """The files as a table: ``VIDEOS``, in the order given."""
    return spark.createDataFrame([tuple(v.values()) for v in probed(paths, rates)], VIDEOS)


def png(image: np.ndarray) -> bytes:
    """A picture (blue, green, red) as PNG."""
    h, w = image.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(image[:, :, ::-1]))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pictures(frames: DataFrame) -> DataFrame:
    """``name`` and ``png`` of each frame, for debugging; write it with any binary sink."""

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"name": [f"frame_{k:06d}.png" for k in b["frame_idx"]], "png": [png(np.frombuffer(i, np.uint8).reshape(h, w, 3)) for i, h, w in zip(b["image"], b["height"], b["width"], strict=True)]})

    return frames.mapInPandas(run, "name string, png binary")
