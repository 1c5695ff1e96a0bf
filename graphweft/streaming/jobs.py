"""Jobs on the driver: each in a thread and a Spark job group of its own, started once what it needs has ended.

Results come as events, whole or in parts, and are drained without waiting. A job that is cancelled has its Spark jobs
cancelled too; the others go on.
"""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from graphweft.storage import settle


class Cancelled(Exception):
    """Raised inside a job, between its phases, once it has been cancelled."""


@dataclass(frozen=True)
class Event:
    """kind: started, part, done, failed, cancelled. value: a part's (name, result), a result, or an error."""

    job: str
    kind: str
    value: Any = None


Emit = Callable[[str, Any], None]


@dataclass
class _Job:
    work: Callable[[Emit, dict[str, Any]], Any]
    after: tuple[str, ...]
    once: tuple[str, ...]
    group: str
    state: str = "waiting"
    cancel: threading.Event = field(default_factory=threading.Event)


class Jobs:
    """A graph of jobs. work(emit, results) may emit parts; results holds what the jobs it comes after returned."""

    def __init__(self, spark: SparkSession, on_cancel: Callable[[], None] | None = None) -> None:
        self.spark, self.on_cancel = spark, on_cancel
        self.results: dict[str, Any] = {}
        self._jobs: dict[str, _Job] = {}
        self._events: queue.SimpleQueue = queue.SimpleQueue()
        self._changed = threading.Condition()

    def add(self, name: str, work: Callable[[Emit, dict[str, Any]], Any], after: tuple[str, ...] = (), once: tuple[str, ...] = ()) -> None:
        """work starts when all jobs in after are done and those in once have ended in any way; if one in after doesn't get done, it never does."""
        with self._changed:
            if name in self._jobs or not set(after + once) <= set(self._jobs):
                raise ValueError(f"{name} is known already or comes after an unknown job")
            self._jobs[name] = _Job(work, after, once, f"{name}-{uuid.uuid4().hex}")
        self._start_ready()

    def drain(self) -> list[Event]:
        """What happened since the last call; never waits."""
        out = []
        while True:
            try:
                out.append(self._events.get_nowait())
            except queue.Empty:
                return out

    def cancel(self, *names: str) -> None:
        """Cancel these jobs, or all: waiting ones never start, running ones have their Spark jobs cancelled."""
        with self._changed:
            chosen = [(n, j) for n, j in self._jobs.items() if (not names or n in names) and j.state in ("waiting", "running")]
            for name, job in chosen:
                job.cancel.set()
                if job.state == "waiting":
                    self._end(name, job, "cancelled")
        for _, job in chosen:
            self.spark.sparkContext.cancelJobGroup(job.group)
        if self.on_cancel and not names:
            self.on_cancel()  # for instance Runner.cancel, which ends child processes
        self._start_ready()

    def wait(self, seconds: float | None = None) -> dict[str, str]:
        """Every job's state once all have ended, or after so many seconds."""
        until = None if seconds is None else time.monotonic() + seconds
        with self._changed:
            while any(j.state in ("waiting", "running") for j in self._jobs.values()):
                if until is not None and time.monotonic() >= until:
                    break
                self._changed.wait(0.2)
            return {n: j.state for n, j in self._jobs.items()}

    def _end(self, name: str, job: _Job, state: str, value: Any = None) -> None:
        job.state = state
        self._events.put(Event(name, state, value))
        self._changed.notify_all()

    def _start_ready(self) -> None:
        with self._changed:
            moved = True
            while moved:
                moved = False
                for name, job in self._jobs.items():
                    if job.state != "waiting":
                        continue
                    states = [self._jobs[n].state for n in job.after]
                    if any(s in ("failed", "cancelled") for s in states):
                        self._end(name, job, "cancelled")
                        moved = True
                    elif all(s == "done" for s in states) and all(self._jobs[n].state not in ("waiting", "running") for n in job.once):
                        job.state = "running"
                        self._events.put(Event(name, "started"))
                        InheritableThread(target=self._run, args=(name, job), daemon=True).start()

    def _run(self, name: str, job: _Job) -> None:
        def emit(part: str, value: Any) -> None:
            if job.cancel.is_set():
                raise Cancelled(name)
            self._events.put(Event(name, "part", (part, value)))

        self.spark.sparkContext.setJobGroup(job.group, name)
        try:
            result = job.work(emit, {n: self.results.get(n) for n in job.after + job.once})
            state, value = ("cancelled", None) if job.cancel.is_set() else ("done", result)
        except Exception as error:  # noqa: BLE001  a job's failure is an event, not the hub's
            state, value = ("cancelled", None) if job.cancel.is_set() else ("failed", error)
        with self._changed:
            if state == "done":
                self.results[name] = value
            self._end(name, job, state, value)
        self._start_ready()


def progressive(*phases: tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]) -> Callable[[Emit, dict[str, Any]], dict[str, DataFrame]]:
    """Work that writes one table after another and emits each as it is there, say a skeleton, the whole graph and totals.

    A phase is made from the tables before it, which are read from files, not made again.
    """

    def work(emit: Emit, results: dict[str, Any]) -> dict[str, DataFrame]:
        made: dict[str, DataFrame] = {}
        for name, make in phases:
            made[name] = settle(make(made))
            emit(name, made[name])
        return made

    return work
