"""Python workers must be able to import this package, wherever they start, and to give memory back."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Freed memory goes back to the system: large blocks at once, Arrow's too. What a caller has set stays.
ALLOCATOR = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}
#: Most bytes of a batch that goes to a worker: two copies of it are held, by the JVM and by the worker.
BATCH_BYTES = 1 << 20


def reachable(spark: SparkSession) -> SparkSession:
    """Put the folder of the package on the path of workers that start from now on, and bound their batches by bytes."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    for name, value in ALLOCATOR.items():
        env.setdefault(name, value)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(limit):
        spark.conf.set(limit, str(BATCH_BYTES))
    return spark
