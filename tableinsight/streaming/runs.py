"""Several analyses at a time, each in a scheduler pool of its own, each with an outcome."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Row, SparkSession

OUTCOME_SCHEMA = "run_id string, path string, folder string, status string, error string"
DONE, FAILED = "done", "failed"
_POOL = "spark.scheduler.pool"


def run_together(
    spark: SparkSession, runs: list[Row], folder_of: Callable[[Row], str], work: Callable[[Row, str], None], width: int
) -> list[tuple]:
    """Outcomes of ``work`` on each run, at most ``width`` at once, as rows of ``OUTCOME_SCHEMA``.

    A run that fails leaves the others alone and is told with the first line of its error. Pools
    share the executors evenly where ``spark.scheduler.mode`` is FAIR; otherwise runs queue up.
    """
    context = spark.sparkContext

    def one(run: Row) -> tuple:
        folder = folder_of(run)
        context.setLocalProperty(_POOL, run.run_id)
        try:
            work(run, folder)
            return run.run_id, run.path, folder, DONE, None
        except (PySparkException, Py4JJavaError, OSError, ValueError, LookupError) as error:
            return run.run_id, run.path, folder, FAILED, (str(error).strip() or type(error).__name__).split("\n", 1)[0]
        finally:
            context.setLocalProperty(_POOL, None)

    with ThreadPoolExecutor(max(1, width)) as threads:
        return list(threads.map(one, runs))
