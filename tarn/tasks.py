"""Tasks on the driver: a registry with snapshots and events, and the chained run of the jobs."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from . import jobs

log = logging.getLogger("tarn")
PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"
ENDED = (COMPLETED, FAILED)


@dataclass
class Task:
    """A task's snapshot."""

    id: str
    kind: str
    status: str = PENDING
    progress: float = 0.0
    message: str = ""
    log: list = field(default_factory=list)


class Registry:
    """Tasks by id; safe to use from several threads."""

    def __init__(self):
        self._tasks: dict[str, Task] = {}
        self._reports: dict[str, object] = {}
        self._lock = threading.Lock()

    def create(self, kind: str) -> str:
        task = Task(str(uuid.uuid4()), kind)
        with self._lock:
            self._tasks[task.id] = task
        return task.id

    def update(self, task_id: str, line: str | None = None, **changes) -> None:
        with self._lock:
            task = self._tasks[task_id]
            for k, v in changes.items():
                setattr(task, k, v)
            if line:
                task.log.append(line)

    def snapshot(self, task_id: str) -> dict | None:
        with self._lock:
            task = self._tasks.get(task_id)
            return None if task is None else asdict(task)

    def report(self, task_id: str):
        """The result of a completed task; KeyError before there is one."""
        with self._lock:
            return self._reports[task_id]

    def submit(self, kind: str, work: Callable[[Callable[..., None]], object]) -> dict:
        """Start ``work(tell)`` in a thread and return the first snapshot; ``tell(progress=..., message=...)`` updates the task."""
        task_id = self.create(kind)
        first = self.snapshot(task_id)

        def run():
            self.update(task_id, status=RUNNING)
            try:
                result = work(lambda line=None, **changes: self.update(task_id, line, **changes))
            except Exception as error:  # a task ends as failed, with the reason, and the registry goes on
                log.exception("task %s failed", task_id)
                self.update(task_id, status=FAILED, message=str(error))
                return
            with self._lock:
                self._reports[task_id] = result
            self.update(task_id, status=COMPLETED, progress=1.0)

        threading.Thread(target=run, daemon=True, name=f"tarn-{kind}").start()
        return first

    def events(self, task_id: str, every: float = 0.5) -> Iterator[tuple[str, dict]]:
        """("status", snapshot) now and at each interval until the task has ended; one ("error", ...) for an unknown id."""
        while True:
            now = self.snapshot(task_id)
            if now is None:
                yield "error", {"message": f"unknown task {task_id}"}
                return
            yield "status", now
            if now["status"] in ENDED:
                return
            time.sleep(every)


def run_chain(steps: list[str], water: DataFrame, epsg: int, references: dict, dem: jobs.Raster | None = None, overrides: dict | None = None, tell: Callable[..., None] = lambda *_, **__: None) -> dict[str, DataFrame]:
    """Results of ``steps`` (fclass, edge-depth, hydro) in order; classification comes first even where it isn't named, and is done once."""
    unknown = set(steps) - {"fclass", "edge-depth", "hydro"}
    if unknown or not steps:
        raise ValueError(f"unknown steps: {sorted(unknown)}" if unknown else "no steps")
    from pyspark.sql import functions as F

    from .operators import layers

    tell("fclass", progress=0.0)
    classified = jobs.fclass(water, epsg, references)
    out = {"fclass": classified}
    if "edge-depth" in steps:
        tell("edge-depth", progress=0.5)
        out["edge-depth"] = jobs.edge_depth(classified, "fclass", overrides)
    if "hydro" in steps:
        if dem is None:
            raise ValueError("hydro needs a terrain raster")
        tell("hydro", progress=0.7)
        flat = layers.flatten(classified, F.col("fclass"))
        flat = flat.select((F.col("feature_idx") * 1_000_000 + F.col("part")).alias("poly"), "rings", "fclass")
        out["hydro"] = jobs.hydro(flat, epsg, dem)
    return out
