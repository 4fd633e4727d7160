"""Session helpers: the shared folder, and tables written to it.

All tables of an application lie in one folder of their own, so that they can be
removed together: by ``drop_stages`` once a result is written, and at the latest
when the driver ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local session, whose executors are the driver, may go without the
    setting; it gets a folder of its own, and the setting with it.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder")
    folder = tempfile.mkdtemp(prefix="codehist-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_homes: dict[str, str] = {}


def home(spark: SparkSession) -> str:
    """The folder of this application below the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _homes:
        _homes[app] = f"{shared_dir(spark).rstrip('/')}/codehist-{uuid.uuid4().hex}"
        atexit.register(_drop_at_exit, app)
    return _homes[app]


CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written or collected inside has its shuffle files removed at its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage before a result that is used several times. Parquet, so
    later reads still prune columns and Spark knows the size of the table.
    """
    spark = df.sparkSession
    path = f"{home(spark)}/stage-{uuid.uuid4().hex}"
    for paths in _watched:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_watched: list[list[str]] = []


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of all tables that are staged inside."""
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield paths
    finally:
        _watched.remove(paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stages(spark: SparkSession) -> None:
    """Remove all tables written so far; results that are read from them are gone as well."""
    folder = _homes.pop(spark.sparkContext.applicationId, None)
    if folder is not None:
        remove(spark, [folder])


def _drop_at_exit(app: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
        drop_stages(spark)
