"""Progress of running jobs, told at steps of about a tenth."""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable

from pyspark.sql import SparkSession


class Steps:
    """Says ``done of total`` whenever another tenth is reached, and at the end; never twice the same."""

    def __init__(self, total: int, say: Callable[[str], None], label: str = "", share: float = 0.1):
        self.total, self.say, self.label, self.share, self.told = max(0, total), say, label, share, 0

    def reach(self, done: int) -> None:
        done = min(done, self.total)
        step = max(1, round(self.total * self.share))
        if done > self.told and (done == self.total or done // step > self.told // step):
            self.told = done
            self.say(f"{self.label}{done} of {self.total} ({done / self.total:.0%})")


class Progress:
    """``with Progress(spark):`` follows the stages of the jobs that start inside, from a thread beside them."""

    def __init__(self, spark: SparkSession, say: Callable[[str], None] | None = None, every: float = 0.5):
        self.tracker, self.every = spark.sparkContext.statusTracker(), every
        self.say = say or (lambda text: print(text, file=sys.stderr))
        self.stages: dict[int, Steps] = {}
        self.stop = threading.Event()
        self.thread = threading.Thread(target=self._follow, daemon=True)

    def _look(self) -> None:
        for i in self.tracker.getActiveStageIds():
            info = self.tracker.getStageInfo(i)
            if info and info.numTasks > 1:
                self.stages.setdefault(i, Steps(info.numTasks, self.say, f"{info.name.split(' ')[0]}, stage {i}: ")).reach(info.numCompletedTasks)

    def _follow(self) -> None:
        while not self.stop.wait(self.every):
            self._look()

    def __enter__(self) -> Progress:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop.set()
        self.thread.join()
