"""The segmenter over a stream: the same segments as the windows give, one group's state at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

SEGMENT = "segment_no int, entity string, detail_ts double, list_start double, list_end double, list_frames long"
OUT = f"what string, group_id string, {SEGMENT}, ts double, ord long, kind string, box string"
_COLUMNS = [x.split()[0] for x in OUT.split(", ")]
_SEGMENT = [x.split()[0] for x in SEGMENT.split(", ")]
FRAME = "ts double, ord long, kind string, box string"
FOLD = "before string, read string, open boolean, entity string, detail double, start double, end double, n long, no int"
_FOLD = [x.split()[0] for x in FOLD.split(", ")]
END = "end"
#: Event time that Spark waits before it drops a frame unseen; frames that are late by less come out as late ones.
FORGET = "1 hour"


class SegmentFold:
    """The state machine on one group's frames in order."""

    def __init__(self, state: dict | None = None) -> None:
        self.s = state or {"before": "other", "read": None, "open": False, "entity": None, "detail": None, "start": None, "end": None, "n": 0, "no": 0}

    def close(self) -> dict | None:
        s, out = self.s, None
        if s["open"] and s["n"]:
            s["no"] += 1
            out = {"segment_no": s["no"], "entity": s["entity"], "detail_ts": s["detail"], "list_start": s["start"], "list_end": s["end"], "list_frames": s["n"]}
        elif s["open"] and s["entity"] is not None and s["read"] is None:
            s["read"] = s["entity"]  # an empty segment hands its entity on
        s |= {"open": False, "entity": None, "detail": None, "start": None, "end": None, "n": 0}
        return out

    def frame(self, ts: float, kind: str, box: str | None) -> dict | None:
        """The segment that this frame ends, if it has list frames."""
        s, out = self.s, None
        if kind == END:
            return self.close()
        if kind == "detail" and s["before"] != "detail":
            out = self.close()
            s["open"] = True
            if s["read"] is not None:
                s["entity"], s["detail"] = s["read"], ts
            s["read"] = None
        elif kind == "move_list":
            s["open"] = True
            s["start"] = ts if s["start"] is None else s["start"]
            s["end"], s["n"] = ts, s["n"] + 1
        elif kind == "other" and box is not None:
            s["read"] = box
        s["before"] = kind
        return out


class Segmenter(StatefulProcessor):
    """State of a group, each part typed: the fold, the place up to which it has folded, and frames that wait for earlier ones (by place)."""

    def __init__(self, wait: float, idle: float | None) -> None:
        self.wait, self.idle = wait, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", FOLD)
        self.place = handle.getValueState("place", "ts double, ord long, latest double")
        self.waiting = handle.getListState("waiting", FRAME)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N803
        """A group goes on behind its stored segments: with their numbers, and frames up to their end are late."""
        fold, end = SegmentFold(), float(initialState["list_end"].max())
        fold.s["no"] = int(initialState["segment_no"].max())
        self._keep(fold)
        self.place.update((end, 1 << 62, end))

    def _known(self) -> SegmentFold:
        kept = self.fold.get() if self.fold.exists() else None
        return SegmentFold(dict(zip(_FOLD, kept, strict=True)) if kept else None)

    def _keep(self, fold: SegmentFold) -> None:
        self.fold.update(tuple(fold.s[c] for c in _FOLD))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        new, event = [], None
        for b in rows:
            new += [(float(ts), int(no), kind, None if box is None or box != box else box) for ts, no, kind, box in zip(b["ts"], b["ord"], b["kind"], b["box"], strict=True)]
            latest = b["at"].max()
            event = latest if event is None else max(event, latest)
        at, no, latest = self.place.get() if self.place.exists() else (float("-inf"), -1, float("-inf"))
        out = [{"what": "late", "ts": f[0], "ord": f[1], "kind": f[2], "box": f[3]} for f in new if (f[0], f[1]) <= (at, no)]
        new = [f for f in new if (f[0], f[1]) > (at, no)]
        latest = max([latest, *(f[0] for f in new)])
        held = sorted([*(self.waiting.get() if self.waiting.exists() else ()), *new], key=lambda f: (f[0], f[1]))
        ended = any(f[2] == END for f in held)
        ripe = len(held) if ended else sum(f[0] <= latest - self.wait for f in held)
        fold = self._known()
        out += self._folded(fold, held[:ripe])
        for t in list(self.handle.listTimers()) if self.idle is not None else []:
            self.handle.deleteTimer(t)
        if ended:
            self._forget()
        else:
            self._keep(fold)
            at, no = held[ripe - 1][:2] if ripe else (at, no)
            self.place.update((at, no, latest))
            self.waiting.put(held[ripe:]) if held[ripe:] else self.waiting.clear()
            if self.idle is not None:
                self.handle.registerTimer(int(event.timestamp() * 1000 + self.idle * 1000))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        """No frame for so long: what waits is folded, the last segment closes, the group is forgotten."""
        fold = self._known()
        out = self._folded(fold, sorted(self.waiting.get() if self.waiting.exists() else (), key=lambda f: (f[0], f[1])))
        if last := fold.close():
            out.append({"what": "segment", **last})
        self._forget()
        yield self._rows(key, out)

    def _folded(self, fold: SegmentFold, frames: list[tuple]) -> list[dict]:
        return [{"what": "segment", **x} for ts, _, kind, box in frames if (x := fold.frame(ts, kind, box))]

    def _forget(self) -> None:
        for state in (self.fold, self.place, self.waiting):
            state.clear()

    def _rows(self, key: tuple, out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([{"group_id": key[0], **x} for x in out], columns=_COLUMNS).astype(object)

    def close(self) -> None:
        pass


def segment_stream(timeline: DataFrame, wait: float = 0.0, idle: float | None = None, stored: DataFrame | None = None, forget: str = FORGET) -> DataFrame:
    """Segments of a stream of ``group_id``, ``ts``, ``ord``, ``kind``, ``box``, each as soon as the next one begins, and late frames: rows of ``OUT``, told
    apart by ``what`` (``segment``, ``late``).

    Within a micro-batch frames are sorted. A frame is folded once its group has frames ``wait`` seconds beyond it, so frames may be that much out
    of order; one at or before the last folded frame of its group is late. A frame of kind ``end``, or ``idle`` seconds of event time without
    frames, closes a group's last segment and forgets the group; its numbers begin anew if it comes again.

    Event time is the column ``at`` (a timestamp), or ``ts`` as seconds since 1970. Its watermark, ``forget`` behind the latest frame of all
    groups, fires the timers; frames even older are dropped by Spark before they can be called late. ``stored`` (``group_id``, ``segment_no``,
    ``list_end``: an index of segments) is where groups go on.
    """
    spark = timeline.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = F.col("at") if "at" in timeline.columns else F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))
    rows = timeline.select("group_id", "ts", "ord", "kind", "box", at.cast("timestamp").alias("at")).withWatermark("at", forget)
    known = None if stored is None else stored.select("group_id", "segment_no", "list_end").filter("list_end is not null").groupBy("group_id")
    mode = "none" if idle is None else "eventTime"
    return rows.groupBy("group_id").transformWithStateInPandas(Segmenter(wait, idle), OUT, "append", mode, known)


def write_increments(found: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch's segments and late frames as Parquet; resumes from its checkpoint."""
    return found.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).partitionBy("what").format("parquet").start(path)


def segments_of(spark: SparkSession, path: str) -> DataFrame:
    """The segments that ``write_increments`` has left so far."""
    return spark.read.schema(OUT).parquet(path).filter("what = 'segment'").select("group_id", *_SEGMENT)


def late_of(spark: SparkSession, path: str) -> DataFrame:
    """The late frames that ``write_increments`` has left so far."""
    return spark.read.schema(OUT).parquet(path).filter("what = 'late'").select("group_id", "ts", "ord", "kind", "box")
