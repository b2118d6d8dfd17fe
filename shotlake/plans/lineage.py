"""Written tables between the steps of a plan.

A scan that carries values between chunks reads its input twice, so scans on
top of scans would double the plan each time. Between them the rows are written
once, as columns, to the shared folder the cluster names.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A session of one process (local[n]) that names none gets a temporary
    folder, one for each application; any other must name a folder that all executors reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise RuntimeError("start the session with spark.checkpoint.dir set to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-shotlake-")
    return _OWN[app]


def settle(df: DataFrame) -> DataFrame:
    """The rows of `df` as a written table."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
