"""Several Spark jobs of one driver at a time.

Small distributed jobs (fits of a model on one table, say) leave most of a cluster idle when they run
one after the other. ``run_together`` gives each of a fixed number of driver threads its own Spark
job: local properties of the caller (descriptions, pools) go with it, all jobs carry one tag, and
when one call fails the jobs of the others are cancelled and the calls not yet begun are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")

#: Driver threads by default. Each waits for its Spark jobs and holds no rows.
THREADS = 8
#: The scheduler pool of the jobs. With ``spark.scheduler.mode`` FAIR the pools share the cores; with FIFO it has no effect.
POOL = "together"


def run_together(spark: SparkSession, calls: Sequence[Callable[[], T]], threads: int = THREADS, pool: str = POOL) -> list[T]:
    """The results of ``calls`` in their order; at most ``threads`` of them run at a time."""
    if threads < 1:
        raise ValueError("threads must be at least 1")
    context, tag = spark.sparkContext, f"{pool}-{uuid.uuid4().hex}"

    def guarded(call: Callable[[], T]) -> Callable[[], T]:
        @inheritable_thread_target(spark)
        def run() -> T:
            context.addJobTag(tag)
            context.setLocalProperty("spark.scheduler.pool", pool)
            try:
                return call()
            finally:
                context.removeJobTag(tag)
                context.setLocalProperty("spark.scheduler.pool", None)

        return run

    with ThreadPoolExecutor(max_workers=threads, thread_name_prefix=pool) as workers:
        running = [workers.submit(guarded(call)) for call in calls]
        done, waiting = wait(running, return_when=FIRST_EXCEPTION)
        failed = next((f for f in running if f in done and f.exception()), None)
        if failed is not None:
            for future in waiting:
                future.cancel()
            # Again and again: a call that is under way may begin another job.
            while any(not future.done() for future in running):
                context.cancelJobsWithTag(tag)
                wait(running, timeout=0.2)
            raise failed.exception()
    return [future.result() for future in running]
