"""Readers of text in pictures: a protocol, composition, and the vision steps around them in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[int, int, int, int]
Corners = list[tuple[float, float]]
Result = tuple[str, float, list[tuple[int, int]]]
BATCH = 8
#: How much a region is enlarged before it is read, and the cubic kernel's parameter.
ENLARGED, CUBIC = 2.0, -0.75


class Recognizer(Protocol):
    """Reads boxes (x, y, w, h) in pictures: for each picture, for each box, its fragments (text, confidence, corners)."""

    def recognize_batch(self, images: list[np.ndarray], boxes: list[list[tuple[int, int, int, int]]], allowed: str | None) -> list[list[list[Result]]]: ...


class Reader(Recognizer, Protocol):
    """A recognizer that also reads a region as one line, and finds and reads all texts of a region."""

    def read_line(self, image: np.ndarray, box: tuple[int, int, int, int]) -> list[Result]: ...

    def read_texts(self, image: np.ndarray, box: tuple[int, int, int, int], factor: float) -> list[Result]: ...


class _OneBox:
    """Regions as boxes of a batch, for recognizers that know nothing else."""

    def read_line(self, image, box):
        return self.recognize_batch([image], [[box]], None)[0][0]

    def read_texts(self, image, box, factor=1.0):
        return self.read_line(image, box)


class TableRecognizer(_OneBox):
    """Gives texts known in advance by (picture's hash, box): readers for tests and for precomputed text."""

    def __init__(self, known: dict[tuple[int, tuple[int, int, int, int]], list[Result]]) -> None:
        self.known = known

    @staticmethod
    def key(image: np.ndarray) -> int:
        import zlib

        return zlib.crc32(np.ascontiguousarray(image).tobytes())

    def recognize_batch(self, images, boxes, allowed=None):
        return [[self.known.get((self.key(i), tuple(b)), []) for b in bs] for i, bs in zip(images, boxes, strict=True)]


class Engine(Protocol):
    """What reads pixels: ``detect`` finds and reads every text of a picture, ``read`` reads given boxes of a grey picture.

    Both give (corners, text, confidence); ``read`` may give its results by height and leave some out.
    """

    def detect(self, image: np.ndarray) -> list[tuple[Corners, str, float]]: ...

    def read(self, image: np.ndarray, boxes: list[Box], allowed: str | None) -> list[tuple[Corners, str, float]]: ...


class EngineRecognizer:
    """A recognizer over an engine: all boxes of a batch of pictures are read at once."""

    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def recognize_batch(self, images, boxes, allowed=None):
        return stacked_texts(self.engine, images, boxes, allowed)

    def read_line(self, image, box):
        return region_line(self.engine, image, box)

    def read_texts(self, image, box, factor=2.0):
        return region_texts(self.engine, image, box, factor)


class EasyEngine:
    """An engine on EasyOCR, where that is installed."""

    def __init__(self, languages: tuple[str, ...] = ("ja", "en")) -> None:
        try:
            import easyocr
        except ImportError as e:
            raise RuntimeError("no text reader is installed: give one, or a table of texts known in advance") from e
        self.reader = easyocr.Reader(list(languages))

    def detect(self, image):
        return [(c, str(t), float(p)) for c, t, p in self.reader.readtext(image)]

    def read(self, image, boxes, allowed=None):
        spans = [[x, x + w, y, y + h] for x, y, w, h in boxes]
        found = self.reader.recognize(image, horizontal_list=spans, free_list=[], detail=1, batch_size=max(1, len(spans)), allowlist=allowed)
        return [(c or [], str(t), float(p)) for c, t, p in found or []]


@lru_cache(1)
def default_engine() -> Engine:
    """One engine for each worker."""
    return EasyEngine()


def default_reader() -> Reader:
    return EngineRecognizer(default_engine())


class Wrapped:
    """A reader that passes on what another reads, perhaps changed."""

    def __init__(self, inner: Recognizer, change: Callable[[Result], Result] = lambda r: r) -> None:
        self.inner, self.change = inner, change

    def recognize_batch(self, images, boxes, allowed=None):
        return [[[self.change(r) for r in b] for b in i] for i in self.inner.recognize_batch(images, boxes, allowed)]

    def read_line(self, image, box):
        return [self.change(r) for r in self.inner.read_line(image, box)]

    def read_texts(self, image, box, factor=2.0):
        return [self.change(r) for r in self.inner.read_texts(image, box, factor)]


def crop(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    x, y, w, h = box
    return image[y : y + h, x : x + w]


def gray(image: np.ndarray) -> np.ndarray:
    """Luma with the usual weights, rounded."""
    return image if image.ndim == 2 else np.floor(image[..., 0] * 0.114 + image[..., 1] * 0.587 + image[..., 2] * 0.299 + 0.5).astype(np.uint8)


def shrink(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area-averaged resize to smaller sizes."""
    a = image.astype(float)
    for axis, size in ((0, height), (1, width)):
        n = a.shape[axis]
        edges = np.linspace(0, n, size + 1)
        total = np.concatenate([np.zeros_like(a.take([0], axis)), a.cumsum(axis)], axis)
        lo = np.floor(edges).astype(int)
        part = edges - lo
        shape = [1] * a.ndim
        shape[axis] = -1
        at = total.take(lo, axis) + a.take(np.minimum(lo, n - 1), axis) * part.reshape(shape)
        a = np.diff(at, axis=axis) / (n / size)
    return np.floor(a + 0.5).astype(image.dtype)


def hue_saturation_value(image: np.ndarray) -> np.ndarray:
    """Hue (half degrees, 0 to 179), saturation and value (0 to 255) of a picture of blue, green and red."""
    b, g, r = (image[..., k].astype(float) for k in range(3))
    top, low = image.max(-1).astype(float), image.min(-1).astype(float)
    span = np.where(top > low, top - low, 1.0)
    degrees = np.where(top == r, 60 * (g - b) / span, np.where(top == g, 120 + 60 * (b - r) / span, 240 + 60 * (r - g) / span))
    hue = np.where(top > low, np.floor(np.where(degrees < 0, degrees + 360, degrees) / 2 + 0.5), 0) % 180
    saturation, value = saturation_value(image)
    return np.stack([hue, saturation, value], axis=-1).astype(np.uint8)


def _cubic_weights(size: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``out`` places the four source places that it is made of, and their weights."""
    at = (np.arange(out) + 0.5) * size / out - 0.5
    first = np.floor(at).astype(int)
    x = np.abs((at - first)[:, None] - np.arange(-1, 3)[None, :])
    near = ((CUBIC + 2) * x - (CUBIC + 3)) * x * x + 1
    far = ((CUBIC * x - 5 * CUBIC) * x + 8 * CUBIC) * x - 4 * CUBIC
    return np.clip(first[:, None] + np.arange(-1, 3)[None, :], 0, size - 1), np.where(x <= 1, near, np.where(x < 2, far, 0.0))


def enlarge(image: np.ndarray, factor: float = ENLARGED) -> np.ndarray:
    """Enlarged by cubic convolution."""
    a = image.astype(float)
    for axis in (0, 1):
        places, weights = _cubic_weights(image.shape[axis], int(image.shape[axis] * factor))
        shape = [1] * a.ndim
        shape[axis] = -1
        a = sum(a.take(places[:, k], axis) * weights[:, k].reshape(shape) for k in range(4))
    return np.clip(np.floor(a + 0.5), 0, 255).astype(image.dtype)


def saturation_value(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Saturation and value, 0 to 255."""
    top, low = image.max(-1).astype(float), image.min(-1)
    return np.where(top > 0, np.floor((top - low) * 255 / np.maximum(top, 1) + 0.5), 0), top


def corners_to_source(corners: Column, x: Column, y: Column, factor: float) -> Column:
    """``to_source`` for a column of corners (``x``, ``y``)."""
    return F.transform(corners, lambda p: F.struct(((p["x"] / factor).cast("int") + x).alias("x"), ((p["y"] / factor).cast("int") + y).alias("y")))


def to_source(corners: list[tuple[float, float]], box: tuple[int, int, int, int], factor: float) -> list[tuple[int, int]]:
    """Corners in an enlarged crop, in the picture's coordinates."""
    return [(int(x / factor) + box[0], int(y / factor) + box[1]) for x, y in corners]


def _results(found: list[tuple[Corners, str, float]], box: Box = (0, 0, 0, 0), factor: float = 1.0) -> list[Result]:
    return [(t, float(p), to_source(c, box, factor)) for c, t, p in found]


def picture_texts(engine: Engine, image: np.ndarray) -> list[Result]:
    """Every text of a picture."""
    return _results(engine.detect(image))


def region_texts(engine: Engine, image: np.ndarray, box: Box, factor: float = ENLARGED) -> list[Result]:
    """Every text of a region, found and read in its enlargement; corners are the picture's. Nothing for an empty region."""
    part = crop(image, box)
    return _results(engine.detect(part if factor == 1 else enlarge(part, factor)), box, factor) if part.size else []


def region_line(engine: Engine, image: np.ndarray, box: Box, factor: float = ENLARGED, allowed: str | None = None) -> list[Result]:
    """A region read as one line, without looking for texts first."""
    part = crop(image, box)
    if not part.size:
        return []
    part = gray(part if factor == 1 else enlarge(part, factor))
    return _results(engine.read(part, [(0, 0, part.shape[1], part.shape[0])], allowed), box, factor)


def by_box(found: list[tuple[Corners, str, float]], boxes: list[Box]) -> list[list[Result]]:
    """Results by box: in order where there are as many as boxes, which go down the picture; else by the nearest centre, the first on ties."""
    out: list[list[Result]] = [[] for _ in boxes]
    placed = zip(range(len(boxes)), found, strict=True) if len(found) == len(boxes) else ((None, f) for f in found)
    centres = np.array([y + h / 2 for _, y, _, h in boxes])
    for k, f in placed:
        if k is None:
            if not len(f[0]) or not boxes:
                continue
            k = int(np.abs(centres - np.mean([y for _, y in f[0]])).argmin())
        out[k] += _results([f])
    return out


def boxes_texts(engine: Engine, image: np.ndarray, boxes: list[Box], allowed: str | None = None) -> list[list[Result]]:
    """The texts of a picture's boxes, read together."""
    return by_box(engine.read(gray(image), boxes, allowed), boxes) if boxes else []


def stacked_texts(engine: Engine, images: list[np.ndarray], boxes: list[list[Box]], allowed: str | None = None) -> list[list[list[Result]]]:
    """The texts of several pictures' boxes, read at once from one picture in which they stand below each other. Corners are that picture's."""
    if len(images) != len(boxes):
        raise ValueError(f"{len(images)} pictures, and boxes for {len(boxes)}")
    if not any(boxes):
        return [[] for _ in boxes]
    greys = [gray(i) for i in images]
    width, tops = max(g.shape[1] for g in greys), np.cumsum([0, *(g.shape[0] for g in greys)]).tolist()
    stack = np.vstack([np.pad(g, ((0, 0), (0, width - g.shape[1]))) for g in greys])
    flat = [(x, y + top, w, h) for top, bs in zip(tops, boxes, strict=False) for x, y, w, h in bs]
    found = iter(by_box(engine.read(stack, flat, allowed), flat))
    return [[next(found) for _ in bs] for bs in boxes]


def pictures(b: pd.DataFrame) -> list[np.ndarray]:
    """The pictures of some frames."""
    return [np.frombuffer(i, np.uint8).reshape(h, w, 3) for i, h, w in zip(b["image"], b["height"], b["width"], strict=True)]


def recognize(frames: DataFrame, make: Callable[[], Recognizer], boxes: list[tuple[int, int, int, int]], allowed: str | None = None) -> DataFrame:
    """Fragments of each frame's boxes: ``frame_idx``, ``box_no``, ``frag_no``, ``text``, ``confidence``, ``box``. ``make`` gives the reader once for each task; pictures go to it ``BATCH`` at a time.

    Filter the frames first: Spark doesn't move filters below this step.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for b in batches:
            for at in range(0, len(b), BATCH):
                some = b.iloc[at : at + BATCH]
                images = pictures(some)
                found = reader.recognize_batch(images, [boxes] * len(images), allowed)
                rows = [(f, n, k, t, c, [{"x": x, "y": y} for x, y in p]) for f, bs in zip(some["frame_idx"], found, strict=True) for n, rs in enumerate(bs) for k, (t, c, p) in enumerate(rs)]
                yield pd.DataFrame(rows, columns=["frame_idx", "box_no", "frag_no", "text", "confidence", "box"])

    return frames.mapInPandas(run, "frame_idx long, box_no int, frag_no int, text string, confidence double, box array<struct<x:int,y:int>>")
