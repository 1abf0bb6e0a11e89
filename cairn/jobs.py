"""Background jobs over an engine: admission of a few at a time, progress and end as events, cancelling by tag."""

from __future__ import annotations

import itertools
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Jobs that may run or wait at once.
MAX_ACTIVE = 2


@dataclass
class Job:
    job_id: int
    operation: str
    tag: str
    future: Future | None = None
    events: list[dict] = field(default_factory=list)


class JobManager:
    """Runs operations in threads; a job beyond MAX_ACTIVE is refused."""

    def __init__(self, spark: SparkSession, max_active: int = MAX_ACTIVE, listener: Callable[[dict], None] | None = None) -> None:
        self.spark, self.max_active, self.listener = spark, max_active, listener or (lambda _: None)
        self.jobs: dict[int, Job] = {}
        self._ids, self._lock, self._pool = itertools.count(1), threading.Lock(), ThreadPoolExecutor(max_active)

    def active(self) -> int:
        return sum(j.future is not None and not j.future.done() for j in self.jobs.values())

    def _tell(self, job: Job, kind: str, **more: Any) -> None:
        event = {"job_id": job.job_id, "event": kind, "operation": job.operation, "ts": time.time()} | more
        job.events.append(event)
        self.listener(event)

    def start(self, operation: str, work: Callable[[Callable[..., None]], Any]) -> int:
        """Run work(progress) and return the job's id; progress(phase, completed, total, path) makes an event."""
        with self._lock:
            if self.active() >= self.max_active:
                raise RuntimeError("too many jobs are active")
            k = next(self._ids)
            job = self.jobs[k] = Job(k, operation, f"job-{k}-{id(self):x}")

            def progress(phase: str, completed: int = 0, total: int | None = None, path: str | None = None) -> None:
                self._tell(job, "progress", phase=phase, completed_bytes=completed, total_bytes=total, current_path=path)

            def run() -> Any:
                self.spark.sparkContext.addJobTag(job.tag)
                try:
                    out = work(progress)
                except BaseException as error:
                    self._tell(job, "finished", error=str(error))
                    raise
                finally:
                    self.spark.sparkContext.removeJobTag(job.tag)
                self._tell(job, "finished", error=None)
                return out

            job.future = self._pool.submit(run)
            return k

    def cancel(self, job_id: int) -> None:
        """Stop what the job runs on the cluster."""
        self.spark.sparkContext.cancelJobsWithTag(self.jobs[job_id].tag)

    def result(self, job_id: int, timeout: float | None = None) -> Any:
        return self.jobs[job_id].future.result(timeout)

    def table(self) -> DataFrame:
        """All events as rows, the newest job first."""
        rows = [(e["job_id"], e["event"], e["operation"], e.get("phase"), e.get("completed_bytes"), e.get("total_bytes"), e.get("current_path"), e.get("error"), e["ts"]) for j in self.jobs.values() for e in j.events]
        schema = "job_id long, event string, operation string, phase string, completed_bytes long, total_bytes long, current_path string, error string, ts double"
        return self.spark.createDataFrame(rows, schema).orderBy("job_id", ascending=False)
