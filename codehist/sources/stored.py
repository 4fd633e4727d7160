"""Result tables that are kept up to date in place: merge by key, and deletes.

A table is a folder of Parquet files by project, and manifests: tables that list
the files of a version. A change finds the files that hold what it touches, writes
these anew beside the old ones, and then writes a manifest; readers take the last
manifest that is finished. So a run that is killed has changed nothing, files that
are not touched are not read or written again, and deleting a project reads no
data at all. One writer at a time; its list of files is the only thing the driver
holds, as Spark does itself for any table it reads.

Defined results: keys are compared null-safe; a row of ``updates`` replaces all stored
rows with its key; two updates with one key are an error; a null project is a project, and an empty name is
read back as null, as in any table that Spark partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codehist.session import remove, staged

PART = "project"
FILES = "file string, project string"


class StoredTable:
    """Rows in ``folder`` with the given schema (``project`` among its columns), known by ``keys``."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)
        self.schema = schema
        self.stored = T.StructType([T.StructField("w", T.StringType()), *schema.fields])

    # -- versions ---------------------------------------------------------------

    def _entries(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []

    def version(self) -> int:
        """The last finished version; 0 before the first write."""
        names = self._entries(f"{self.folder}/manifests")
        done = [n for n in names if "_SUCCESS" in self._entries(f"{self.folder}/manifests/{n}")]
        return max((int(n.removeprefix("v")) for n in done), default=0)

    def manifest(self) -> DataFrame:
        """file and project of every file of the last version."""
        at = self.version()
        if not at:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/manifests/v{at:08d}")

    def _publish(self, manifest: DataFrame) -> None:
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/v{self.version() + 1:08d}")

    # -- data -------------------------------------------------------------------

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.stored).option("basePath", f"{self.folder}/data").parquet(*files)
        return rows.select(*[f"`{c}`" for c in self.schema.names])

    def read(self) -> DataFrame:
        return self._read([r.file for r in self.manifest().select("file").collect()])

    def _files_of(self, rows: DataFrame) -> list[str]:
        return [r.f for r in rows.select(F.col("_metadata.file_path").alias("f")).distinct().collect()]

    def _write(self, rows: DataFrame) -> DataFrame:
        """New files, as a manifest."""
        path = f"{self.folder}/data/w={uuid.uuid4().hex}"
        rows.hint("rebalance", F.col(PART)).sortWithinPartitions(PART, *[k for k in self.keys if k != PART]).write.partitionBy(PART).parquet(path)
        # the partition is part of the path; an empty result has no files
        written = self.spark.read.schema(self.stored).option("basePath", f"{self.folder}/data").parquet(path)
        return written.select(F.col("_metadata.file_path").alias("file"), PART).distinct()

    def _same(self, left: str, right: str, on: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, (F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in on))

    def overwrite(self, rows: DataFrame) -> None:
        self._publish(self._write(rows.select(*[f"`{c}`" for c in self.schema.names])))

    def _touched(self, keys: DataFrame, on: Sequence[str]) -> list[str]:
        """Files that hold a row with one of the keys. If project is a key, files of other projects are not opened."""
        manifest = self.manifest()
        if PART in on:
            manifest = manifest.join(keys.select(F.col(PART).alias("_p")).distinct(), F.col(PART).eqNullSafe(F.col("_p")), "left_semi")
        files = [r.file for r in manifest.select("file").collect()]
        if not files:
            return []
        stored = self.spark.read.schema(self.stored).option("basePath", f"{self.folder}/data").parquet(*files)
        stored = stored.select(*[f"`{k}`" for k in on], F.col("_metadata.file_path").alias("_file")).alias("s")
        found = stored.join(keys.alias("k"), self._same("s", "k", on), "left_semi")
        return [r["_file"] for r in found.select("_file").distinct().collect()]

    def _replace(self, files: list[str], rows: DataFrame) -> None:
        """A version with ``rows`` in place of ``files``."""
        gone = self.spark.createDataFrame([(f,) for f in files], "gone string")
        kept = self.manifest().join(gone, F.col("file") == F.col("gone"), "left_anti")
        self._publish(staged(kept.unionByName(self._write(rows))))

    def merge(self, updates: DataFrame) -> None:
        """Rows of ``updates`` take the place of stored ones with the same keys; the others are added."""
        updates = staged(updates.select(*[f"`{c}`" for c in self.schema.names]))
        keys = updates.select(*[f"`{k}`" for k in self.keys])
        twice = keys.groupBy(*[F.col(f"`{k}`") for k in self.keys]).count().where("count > 1").first()
        if twice is not None:
            raise ValueError(f"two updates for {twice.asDict()}")
        files = self._touched(keys, self.keys)
        left = self._read(files).alias("s").join(keys.alias("k"), self._same("s", "k", self.keys), "left_anti")
        self._replace(files, left.unionByName(updates))

    def delete(self, keys: DataFrame, on: Sequence[str] | None = None) -> None:
        """Removes the rows whose ``on`` columns (the table's keys, if not given) are among those of ``keys``."""
        on = list(on or self.keys)
        keys = staged(keys.select(*[f"`{k}`" for k in on]).distinct())
        files = self._touched(keys, on)
        if files:
            self._replace(files, self._read(files).alias("s").join(keys.alias("k"), self._same("s", "k", on), "left_anti"))

    def drop_projects(self, gone: DataFrame) -> None:
        """Removes whole projects; only the manifest is read."""
        names = gone.select(F.col(PART).alias("gone")).distinct()
        self._publish(staged(self.manifest().join(names, F.col(PART).eqNullSafe(F.col("gone")), "left_anti")))

    def vacuum(self) -> None:
        """Removes files and manifests that the last version does not use; readers of earlier versions must be done."""
        at = self.version()
        live = {r.file.split("/data/")[1].split("/")[0] for r in self.manifest().select("file").collect()}
        dead = [f"{self.folder}/data/{n}" for n in self._entries(f"{self.folder}/data") if n not in live]
        dead += [f"{self.folder}/manifests/{n}" for n in self._entries(f"{self.folder}/manifests") if n != f"v{at:08d}"]
        remove(self.spark, dead)


def only_pointed_to_by(facts: Sequence[DataFrame], column: str, gone: DataFrame) -> DataFrame:
    """Ids in ``column`` to which only facts of the ``gone`` projects point."""
    used = reduce(DataFrame.unionByName, [f.select(PART, F.col(column).alias("id")) for f in facts]).where("id is not null")
    marked = used.join(gone.select(F.col(PART).alias("_gone")).distinct(), F.col(PART).eqNullSafe(F.col("_gone")), "left")
    # one row per id and side before the sides are compared, however many facts share an id
    per = marked.groupBy("id").agg(F.bool_and(F.col("_gone").isNotNull()).alias("all_gone"))
    return per.where("all_gone").select("id")


def delete_projects(facts: Sequence[StoredTable], metrics: dict[str, StoredTable], projects: StoredTable | None, gone: DataFrame) -> None:
    """Removes projects from all tables: the metric rows that only their facts point to (``metrics``: fact column to table, keyed by ``id``), the facts, the projects.

    Metrics go first and facts after that, so a run that is killed can be run again: while the facts are there, what they point to can be found.
    """
    gone = staged(gone.select(PART).distinct())
    for column, table in metrics.items():
        table.delete(staged(only_pointed_to_by([f.read() for f in facts if column in f.schema.names], column, gone)), ["id"])
    for table in [*facts, *([projects] if projects is not None else [])]:
        table.drop_projects(gone)


def delete_unfinished(facts: Sequence[StoredTable], metrics: dict[str, StoredTable], projects: StoredTable) -> None:
    """The same for all projects without ``finishedDate``."""
    delete_projects(facts, metrics, projects, projects.read().where(F.col("finishedDate").isNull()).select(PART))
