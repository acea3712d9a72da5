"""A stopwatch in milliseconds."""

from __future__ import annotations

import time


class Timer:
    def __init__(self) -> None:
        self.start, self.elapsed = 0.0, 0.0

    def tic(self) -> None:
        self.start = time.perf_counter()

    def toc(self) -> float:
        self.elapsed = (time.perf_counter() - self.start) * 1000
        return self.elapsed
