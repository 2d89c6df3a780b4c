"""Flows: named tasks that run in order and stop at the first error."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession


@dataclass
class Task:
    """A step of a flow. ``run`` gets the session and what earlier tasks gave; ``fetch`` brings its rows to the caller."""

    name: str
    run: Callable[[SparkSession, dict], object]
    fetch: bool = False
    cleanup: Callable[[SparkSession], None] | None = None
    seconds: float = 3600


@dataclass
class Outcome:
    task: str
    run_id: str
    status: str
    seconds: float
    rows: list[Row] = field(default_factory=list)
    error: str = ""


class TaskFailed(Exception):
    def __init__(self, outcomes: list[Outcome]):
        super().__init__(f"{outcomes[-1].task}: {outcomes[-1].error}")
        self.outcomes = outcomes


def run_flow(spark: SparkSession, tasks: Sequence[Task]) -> list[Outcome]:
    """Runs tasks in order. Each one's cleanup runs whatever happens; after an error no further task runs and TaskFailed
    carries the outcomes so far. When a task's time is over, its Spark jobs are cancelled, and it may start no others."""
    done: list[Outcome] = []
    given: dict = {}
    for task in tasks:
        run_id, began = f"{task.name}-{uuid.uuid4().hex[:8]}", time.monotonic()
        spark.sparkContext.setJobGroup(run_id, task.name, interruptOnCancel=True)
        limit = threading.Timer(task.seconds, spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs, [run_id])
        limit.daemon = True
        limit.start()
        try:
            out = given[task.name] = task.run(spark, given)
            rows = out.collect() if task.fetch and isinstance(out, DataFrame) else []
            seconds = time.monotonic() - began
            if seconds > task.seconds:
                raise TimeoutError(f"took {seconds:.1f} s of {task.seconds}")
            done.append(Outcome(task.name, run_id, "success", seconds, rows))
        except Exception as e:
            spark.sparkContext.cancelJobGroup(run_id)
            seconds = time.monotonic() - began
            late = f"TimeoutError: stopped after {task.seconds} s" if seconds > task.seconds else f"{type(e).__name__}: {e}"
            done.append(Outcome(task.name, run_id, "failed", seconds, error=late))
            raise TaskFailed(done) from e
        finally:
            limit.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            if task.cleanup:
                task.cleanup(spark)
    return done
