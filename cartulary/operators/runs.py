"""Runs of operations over shared files: a registry that lets one run at a time, ordered steps, and the rebuild of an index."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..sources import files

SCHEMA = "id long, operation string, owner string, started double, ended double, state string, code int, by string"
RUNNING, ENDED = "running", ("ok", "error", "cancelled", "interrupted", "ended")


@dataclass(frozen=True)
class Run:
    id: int
    operation: str
    owner: str
    started: float
    ended: float | None
    state: str
    code: int | None
    by: str


class Registry:
    """The runs of a folder, a versioned table with a row a run. The driver keeps it: it has as many rows as there were runs."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.root, self.clock = spark, root, clock
        try:
            self.runs = {r.id: Run(**r.asDict()) for r in files.current(spark, root).collect()}
        except Exception as e:  # a folder without a version yet
            if "FileNotFound" not in str(e) and not isinstance(e, ValueError):
                raise
            self.runs = {}

    def table(self) -> DataFrame:
        rows = [tuple(asdict(r).values()) for r in self.runs.values()]
        return self.spark.createDataFrame(rows, SCHEMA)

    def _put(self, run: Run) -> Run:
        self.runs[run.id] = run
        files.publish(self.table().coalesce(1), self.root)
        return run

    def running(self) -> Run | None:
        return next((r for r in self.runs.values() if r.state == RUNNING), None)

    def start(self, operation: str, by: str, owner: str = "") -> Run:
        """A new run; ValueError while another one is running, as operations share files."""
        busy = self.running()
        if busy:
            raise ValueError(f"run {busy.id} ({busy.operation}) is still running")
        return self._put(Run(max(self.runs, default=0) + 1, operation, owner, self.clock(), None, RUNNING, None, by))

    def finish(self, run: Run, code: int | None, state: str | None = None) -> Run:
        """The end of a run; one that was cancelled meanwhile stays cancelled."""
        now = self.runs[run.id]
        if now.state != RUNNING:
            return now
        return self._put(replace(now, ended=self.clock(), code=code, state=state or ("ok" if code == 0 else "error")))

    def cancel(self, run: Run) -> bool:
        if self.runs[run.id].state != RUNNING:
            return False
        self.finish(run, None, "cancelled")
        return True

    def adopt(self, alive: Callable[[str], bool]) -> list[Run]:
        """After a restart: runs whose owner lives go on, and hold the lock; the others were interrupted."""
        left = []
        for run in [r for r in self.runs.values() if r.state == RUNNING]:
            if run.owner and alive(run.owner):
                left.append(run)
            else:
                self.finish(run, None, "interrupted")
        return left


def orchestrate(registry: Registry, operation: str, steps: list[tuple[str, bool, Callable[[], object]]], by: str) -> tuple[Run, list[str]]:
    """Runs (name, destructive, step) in order, destructive ones last, and stops at the first that fails; the run and the names of the steps done."""
    order = [s for s in steps if not s[1]] + [s for s in steps if s[1]]
    run, done = registry.start(operation, by), []
    for name, _, step in order:
        if registry.runs[run.id].state != RUNNING:  # cancelled
            return registry.runs[run.id], done
        try:
            step()
        except Exception as e:
            registry.finish(run, 1)
            raise RuntimeError(f"step {name} of run {run.id} failed") from e
        done.append(name)
    return registry.finish(run, 0), done


def rebuild(fragments: DataFrame, metadata: DataFrame, root: str, dedup: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Publishes a whole new index of all fragments, always deduplicated; the version before it stays. Refused where the authoritative metadata is empty."""
    if metadata.isEmpty():
        raise ValueError("the authoritative metadata is empty: the index would have no identities")
    return files.publish(dedup(fragments, metadata), root)
