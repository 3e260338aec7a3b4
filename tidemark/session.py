"""What workers need of the driver's session, and tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def workers_can_import(spark: SparkSession) -> None:
    """Put this package's parent on the Python path of the workers."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_HOME, *paths])


_LOCAL: dict[str, str] = {}  # folders made where the setting is missing, as in tests


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset a local one for a session on one machine, else an error."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


class Tables:
    """Tables of one run of an operator, below one folder.

    ``keep`` writes a DataFrame as Parquet and reads it back: lineage is cut, the work before
    it runs once, and an executor lost later costs no recomputation. The folder belongs to
    the run and may go once its result has been consumed.
    """

    def __init__(self, spark: SparkSession):
        workers_can_import(spark)
        self.spark = spark
        self.root = shared_folder(spark)
        self._n = 0

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``by``: a column whose values get folders of their own, so that a filter on it reads nothing else."""
        self._n += 1
        path = f"{self.root}/{self._n:02d}-{name}"
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(df.columns)
