"""Options of the whole run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .functions.recognize import Reader, default_reader
from .operators.timeline import check_rates


@dataclass(frozen=True)
class Options:
    """``fps``: of the frames whose rows are read. ``index_fps``: of the frames that segments are found in. ``auto_entity``: the score from which an
    entity needs no review; ``no_prompt``: take the best candidate and leave doubtful items out, without review.
    """

    fps: float = 5.0
    index_fps: float = 5.0
    start: float | None = None
    end: float | None = None
    accept_item: float = 0.7
    accept_entity: float = 0.7
    auto_entity: float = 0.85
    coverage: float = 0.9
    least_votes: int = 1
    no_prompt: bool = True
    only: str | None = None
    ascii_names: bool = False
    verbose: bool = False
    #: Makes the reader of texts, once for each task.
    reader: Callable[[], Reader] = default_reader
    #: Gets every row read (``segment_id``, ``ord``, ``row_no``, ``crop``, ``text``, ``observed_type``), as a DataFrame.
    row_sink: Callable[[DataFrame], None] | None = None

    def __post_init__(self) -> None:
        check_rates(self.fps, self.start, self.end)
        check_rates(self.index_fps)
