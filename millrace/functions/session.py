"""Settings of a session that hold for a while."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

#: The files of a write's shuffles go when it ends, not when the driver next collects garbage.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """For what is run inside."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
