"""One file to many rows: a detector as a table function for lateral joins.

A detector is made by a function without arguments, once in each worker process, and is called with a file's frames one by one; what
it yields for a frame becomes rows. Files are streamed through: neither a file's frames nor its rows are gathered.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import udtf

FOUND = "frame int, number int, start int, stop int, label string, score double"
Detector = Callable[[object], Iterable[tuple[int, int, str, float]]]


@functools.cache
def _made(make: Callable[[], Detector]) -> Detector:
    return make()


def detections(df: DataFrame, frames: Column, make: Callable[[], Detector], most: int | None = None) -> DataFrame:
    """df with a row for everything that the detector finds in its frames (an array): frame and number in the frame (from 0), start, stop, label, score.

    A file without frames, with null frames or without a find has no row. `make` must be a function of a module. With `most`, an error if
    a frame gives more rows than that (a broken detector).
    """

    @udtf(returnType=FOUND)
    class Found:
        def __init__(self) -> None:
            self.detector = _made(make)

        def eval(self, given: list | None) -> Iterator[tuple]:
            for i, frame in enumerate(given or []):
                if frame is None:
                    continue
                for k, (start, stop, label, score) in enumerate(self.detector(frame)):
                    if most is not None and k >= most:
                        raise ValueError(f"more than {most} finds in a frame")
                    yield i, k, start, stop, label, score

    return df.lateralJoin(Found(frames.outer()))


def number_detector() -> Detector:
    """Finds runs of digits in a text; the score is their length."""
    digits = re.compile("[0-9]+")
    return lambda frame: ((m.start(), m.end(), "number", float(m.end() - m.start())) for m in digits.finditer(frame))
