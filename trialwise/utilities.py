"""Flags of the environment, versions, batched functions, and progress of Spark jobs."""

from __future__ import annotations

import functools
import operator
import os
import re
import sys
import threading

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: What counts as yes.
YES = ("1", "true", "yes", "on")
_COMPARE = {"<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne, ">=": operator.ge, ">": operator.gt}


def get_var(name: str, default: str | None = None, flag: str | None = None) -> str | None:
    """flag if given, else the environment's value, else default."""
    return flag if flag is not None else os.environ.get(name, default)


def is_enabled(name: str, default: bool = False, flag: bool | None = None) -> bool:
    """Whether the environment says yes; flag, if given, decides, and default where nothing is said."""
    if flag is not None:
        return bool(flag)
    value = get_var(name)
    return default if value is None else value.strip().lower() in YES


def _parts(version: str) -> tuple:
    """Numbers of the release without closing zeros, then what marks it as early (-1), final (0) or late (1)."""
    m = re.match(r"v?(\d+(?:\.\d+)*)[-_.]?([a-z]*)[-_.]?(\d*)", version.strip().lower())
    if not m:
        raise ValueError(f"{version} is no version")
    numbers = [int(x) for x in m[1].split(".")]
    while len(numbers) > 1 and not numbers[-1]:
        numbers.pop()
    late = 0 if not m[2] else 1 if m[2] in ("post", "rev", "r") else -1
    early = ("dev", "a", "alpha", "b", "beta", "c", "rc")
    return tuple(numbers), late, early.index(m[2]) if m[2] in early else 0, int(m[3] or 0)


def compare(a: str, op: str, b: str) -> bool:
    """Whether the versions compare so: op is <, <=, ==, !=, >= or >."""
    if op not in _COMPARE:
        raise ValueError(f"no comparison {op}")
    return _COMPARE[op](_parts(a), _parts(b))


def batched(returns: str = "double", flag: str = "TRIALWISE_BATCHED"):
    """Decorates a function of numbers or arrays for use on columns: it gets whole Arrow batches as numpy arrays. Where the flag says no, or batches can't be made,
    it gets a row at a time, with the same result."""

    def wrap(f):
        @functools.wraps(f)
        def row(*values):
            out = f(*values)
            return out.item() if hasattr(out, "item") else out

        if not is_enabled(flag, True):
            return F.udf(row, returns)
        import pandas as pd

        def batch(*columns):
            return pd.Series([row(*v) for v in zip(*columns)])

        batch.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        return F.pandas_udf(batch, returns)

    return wrap


class Progress:
    """Shows, while its block runs, how many tasks of the active stages are done; with enabled False nothing."""

    def __init__(self, spark: SparkSession, description: str = "", enabled: bool = True, every: float = 0.5, out=None):
        self.spark, self.description, self.enabled, self.every, self.out = spark, description, enabled, every, out or sys.stderr

    def counts(self) -> tuple[int, int]:
        """(done, all) tasks of the active stages."""
        tracker = self.spark.sparkContext.statusTracker()
        infos = [i for i in map(tracker.getStageInfo, tracker.getActiveStageIds()) if i]
        return sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos)

    def _run(self) -> None:
        while not self._ended.wait(self.every):
            done, n = self.counts()
            print(f"\r{self.description} {done}/{n}", end="", file=self.out, flush=True)

    def __enter__(self):
        self._ended = threading.Event()
        if self.enabled:
            self._thread = threading.Thread(target=self._run, daemon=True)
            self._thread.start()
        return self

    def __exit__(self, *_):
        self._ended.set()
        if self.enabled:
            self._thread.join()
            print(file=self.out)
