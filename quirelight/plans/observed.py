"""What Spark measured while a component ran."""

from __future__ import annotations

import resource
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

# of a stage's sums: ours, Spark's, and what one of ours is in Spark's unit
SUMS = (
    ("task_seconds", "executorRunTime", 1e3), ("cpu_seconds", "executorCpuTime", 1e9), ("gc_seconds", "jvmGcTime", 1e3), ("read_mb", "inputBytes", 1e6), ("written_mb", "outputBytes", 1e6),
    ("shuffle_read_mb", "shuffleReadBytes", 1e6), ("shuffle_written_mb", "shuffleWriteBytes", 1e6), ("spilled_mb", "diskBytesSpilled", 1e6), ("peak_memory_mb", "peakExecutionMemory", 1e6),
)
SCHEMA = "component string, stage int, name string, status string, tasks int, failed_tasks int, " + ", ".join(f"{name} double" for name, _, _ in SUMS)


def observed(spark: SparkSession, name: str, component: Callable[[], dict]) -> Callable[[], dict]:
    """The component, whose metrics also have ``spark``: when it began and ended, its stages and their sums.

    Jobs are told apart by a job group, so what other threads run meanwhile is
    not counted.  A component that raises does so, with its stages in ``stages``.
    """

    def run() -> dict:
        context, group = spark.sparkContext, f"{name}-{uuid.uuid4().hex}"
        context.setJobGroup(group, name)
        begun = datetime.now(UTC)
        try:
            out = component() or {}
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)
            run.stages = stages_of(spark, group)
        ended = datetime.now(UTC)
        total = {key: round(max((s[key] for s in run.stages), default=0.0) if key.startswith("peak") else sum(s[key] for s in run.stages), 6) for key, _, _ in SUMS}
        # the driver's own peak, in MB
        driver = round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1)
        times = {"begun": begun.isoformat(), "ended": ended.isoformat(), "seconds": round((ended - begun).total_seconds(), 6)}
        return out | {"spark": times | total | {"stages": len(run.stages), "tasks": sum(s["tasks"] for s in run.stages), "driver_rss_mb": driver}}

    run.stages = []
    return run


def stages_of(spark: SparkSession, group: str) -> list[dict]:
    """The stages that a group's jobs ran (those whose results were there are left out)."""
    context, out = spark.sparkContext, []
    tracker, jvm = context._jsc.sc().statusTracker(), context._jsc.sc()
    jvm.listenerBus().waitUntilEmpty(10_000)
    store, seen = jvm.statusStore(), set()
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        seen |= set(info.get().stageIds()) if info.isDefined() else set()
    for stage in sorted(seen):
        data = _stage(store, stage)
        if data is not None and data.numCompleteTasks() + data.numFailedTasks():
            out.append({"stage": stage, "name": data.name(), "status": data.status().toString(), "tasks": data.numCompleteTasks(), "failed_tasks": data.numFailedTasks(), **{key: getattr(data, of)() / unit for key, of, unit in SUMS}})
    return out


def _stage(store: object, stage: int) -> object | None:
    from py4j.protocol import Py4JJavaError

    try:
        return store.lastStageAttempt(stage)
    except Py4JJavaError:  # a stage that was never begun is not in the store
        return None


def stage_table(spark: SparkSession, components: dict[str, Callable[[], dict]]) -> DataFrame:
    """A row for each stage that observed components ran."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [tuple(({"component": name} | s)[c] for c in names) for name, run in components.items() for s in getattr(run, "stages", [])]
    return spark.createDataFrame(rows, SCHEMA)
