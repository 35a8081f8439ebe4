"""Several pieces of Spark work at a time, each within its own budget.

Every piece runs in a driver thread of its own, its jobs under a tag of its own
and in a scheduler pool of its own (with spark.scheduler.mode=FAIR the pools
share the cores evenly; otherwise jobs queue). A piece that is over its budget
has its jobs cancelled by that tag, those too that it starts later, and costs
the others nothing.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: Seconds between looks at the clock, and between cancellations of a piece that won't end.
TICK = 0.05


@dataclass
class Outcome:
    """What a piece returned or raised, how long it took, and whether its budget ended it."""

    name: str
    value: Any = None
    error: BaseException | None = None
    seconds: float = 0.0
    stopped: bool = False


def at_once(spark: SparkSession, work: Sequence[tuple[str, Callable[[], Any], float | None]]) -> list[Outcome]:
    """Run all (name, function, budget in seconds or None) at a time; outcomes in the order of ``work``.

    Returns as soon as each piece has ended or been stopped. A function that is
    stopped while it isn't in a job goes on in its thread, without Spark: any
    job it still starts is cancelled.
    """
    sc = spark.sparkContext
    done = threading.Condition()
    ended: dict[int, tuple[Any, BaseException | None, float]] = {}
    tags = [f"quillion-{uuid.uuid4().hex}" for _ in work]

    def run(k: int, name: str, fn: Callable[[], Any]) -> None:
        began, value, error = time.monotonic(), None, None
        sc.addJobTag(tags[k])
        sc.setInterruptOnCancel(True)
        sc.setLocalProperty("spark.scheduler.pool", name)
        try:
            value = fn()
        except BaseException as e:  # noqa: BLE001  the caller decides what an error means
            error = e
        with done:
            ended[k] = (value, error, time.monotonic() - began)
            done.notify_all()

    threads, began = [], time.monotonic()
    for k, (name, fn, _) in enumerate(work):
        t = InheritableThread(target=run, args=(k, name, fn), session=spark)
        t.daemon = True
        threads.append(t)
        t.start()
    out = [Outcome(name) for name, _, _ in work]
    open_ = set(range(len(work)))
    while open_:
        with done:
            done.wait(TICK)
            for k in sorted(open_ & ended.keys()):
                out[k].value, out[k].error, out[k].seconds = ended[k]
                open_.discard(k)
        now = time.monotonic() - began
        for k in sorted(open_):
            if work[k][2] is not None and now > work[k][2]:
                out[k].seconds, out[k].stopped = now, True
                open_.discard(k)
                sc.cancelJobsWithTag(tags[k])
                threading.Thread(target=_hold, args=(sc, tags[k], threads[k]), daemon=True).start()
    return out


def _hold(sc, tag: str, thread: threading.Thread) -> None:
    """Cancel what a stopped piece still starts, until its thread ends."""
    while thread.is_alive():
        sc.cancelJobsWithTag(tag)
        time.sleep(TICK)
