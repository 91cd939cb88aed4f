"""``python -m chronofold.cli``: recordings in, a result file of lists by entity out.

Exit codes: 0, or 2 for arguments that can't be met.
"""

from __future__ import annotations

import argparse
import os
import sys

from .functions.recognize import TableRecognizer, default_reader
from .options import Options
from .plans import job
from .session import local
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronofold", description="Recordings to lists of items by entity.")
    p.add_argument("videos", nargs="+", help="video files, or stacks of frames (.npy), in order")
    p.add_argument("-o", "--output", default="learnset.json")
    p.add_argument("--master-dir", default="data/master", help="folder of the dimensions")
    p.add_argument("--items", default="items.json", help="the items' file in that folder")
    p.add_argument("--entities", default="entities.json", help="the entities' file in that folder")
    p.add_argument("--frames-dir", help="write the frames that are looked at here, as pictures")
    p.add_argument("--fps", type=float, default=5.0, help="frames a second whose rows are read")
    p.add_argument("--index-fps", type=float, default=5.0, help="frames a second that segments are found in")
    p.add_argument("--src-fps", default="", help="rate of the files, or one for each, comma-separated; theirs if left out")
    p.add_argument("--start", type=float, help="first second, over all files")
    p.add_argument("--end", type=float, help="second to stop before")
    p.add_argument("--threshold", type=float, default=0.7, help="score that accepts an item")
    p.add_argument("--segments", help="a stored index: skip the first phase")
    p.add_argument("--only", help="numbers and names of segments, comma-separated")
    p.add_argument("--every", type=int, default=16, help="segments after which results are written")
    p.add_argument("--resume", action="store_true", help="go on where a run with the same output stopped")
    p.add_argument("--decisions", help="a reviewer's choices")
    p.add_argument("--texts", help="a table of texts known in advance (picture, x, y, w, h, text, confidence), instead of a reader")
    p.add_argument("--verbose", "-v", action="store_true")
    p.add_argument("--no-prompt", action="store_true", help="take the best entities and leave doubtful items out, without a review file")
    return p


def table_reader(path: str):
    """A reader of texts that a Parquet table has by picture and box; the table is read on the driver and travels with the tasks."""
    import pandas as pd

    known: dict = {}
    for r in pd.read_parquet(path).itertuples():
        known.setdefault((int(r.picture), (int(r.x), int(r.y), int(r.w), int(r.h))), []).append((r.text, float(r.confidence), []))
    return lambda: TableRecognizer(known)


def main(argv: list[str] | None = None, reader=None) -> int:
    a = parser().parse_args(argv)
    for v in a.videos:
        if not os.path.exists(v):
            print(f"no such file: {v}", file=sys.stderr)
            return 2
    reader = reader or (table_reader(a.texts) if a.texts else default_reader)
    try:
        options = Options(fps=a.fps, index_fps=a.index_fps, start=a.start, end=a.end, accept_item=a.threshold, only=a.only, no_prompt=a.no_prompt, verbose=a.verbose, reader=reader)
        spark = local()
        items = files.read_items(spark, os.path.join(a.master_dir, a.items))
        entities = files.read_entities(spark, os.path.join(a.master_dir, a.entities))
        if a.verbose:
            print(f"{items.count()} items, {entities.count()} entities")
        videos = [os.path.abspath(v) for v in a.videos]
        job.run(spark, videos, items, entities, options, os.path.abspath(a.output), a.segments and os.path.abspath(a.segments), a.src_fps, a.every, a.resume, a.decisions, a.frames_dir)
    except (ValueError, FileNotFoundError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
