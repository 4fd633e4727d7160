"""A folder of files written from rows: path and text of each.

Spark's own writers name their files themselves; archives of source texts need
the names to mean something. The writer is a data source of two phases. A task
writes into a folder of its attempt, which readers don't see; when all tasks are
done the driver moves these folders, one for each task, into place. An attempt
that fails leaves nothing behind, and a task that runs twice counts once.

Files are many and small, so the driver never lists them: it knows the folders
of the writing tasks, and each is listed and read by one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehist.plans.ordered import spread

SOURCE = "codehist_files"


def _data_source():
    """Classes inside a function travel with the job, so tasks need not find this package."""
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    @dataclass
    class Written(WriterCommitMessage):
        attempt: str | None
        files: int

    class Writer(DataSourceWriter):
        def __init__(self, folder: str, job: str, replace: bool):
            self.folder, self.job, self.replace = folder.rstrip("/"), job, replace

        def _store(self):
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.folder)
            return store, path, f"{path}/_attempts-{self.job}"

        def write(self, rows):
            store, _, attempts = self._store()
            name, seen = f"{attempts}/{uuid.uuid4().hex}", set()
            for row in rows:
                parts = row.path.split("/")
                if any(p in ("", ".", "..") for p in parts) or row.path in seen:
                    raise ValueError(f"no file of its own below the folder: {row.path!r}")
                seen.add(row.path)
                at = f"{name}/{row.path}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(row.text.encode())
            return Written(name if seen else None, len(seen))

        def commit(self, messages):
            store, path, attempts = self._store()
            store.create_dir(path, recursive=True)
            from pyarrow import fs

            old = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-")] if self.replace else []
            for k, m in enumerate(m for m in messages if m is not None and m.attempt):
                store.move(m.attempt, f"{path}/part-{self.job}-{k:06d}")
            for name in old:
                store.delete_dir(name)
            self._clear(store, attempts)

        def abort(self, messages):
            store, _, attempts = self._store()
            self._clear(store, attempts)

        def _clear(self, store, attempts):
            from pyarrow import fs

            if store.get_file_info(attempts).type != fs.FileType.NotFound:
                store.delete_dir(attempts)

    class Files(DataSource):
        @classmethod
        def name(cls):
            return SOURCE

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], self.options["job"], overwrite)

    return Files


def write_files(rows: DataFrame, folder: str, replace: bool = True) -> None:
    """One file for each row (path below the folder, text); rows without a text are left out, and a path may occur once.

    With ``replace`` the files of earlier runs go when the new ones are in place.
    """
    spark = rows.sparkSession
    spark.dataSource.register(_data_source())
    # by number: rows are small in a shuffle, but each becomes a file
    named = spread(rows.filter("path is not null and text is not null").select("path", "text"), "path")
    named.write.format(SOURCE).mode("overwrite" if replace else "append").option("job", uuid.uuid4().hex).save(folder)


def _reader(folder: str, tops: list[str], batch: int = 4 << 20):
    """Reads the files below the folders whose places in ``tops`` it gets; like the writer it takes all it needs with it."""

    def below(store, top):
        from pyarrow import fs

        rest = [store.get_file_info(top)]
        while rest:
            info = rest.pop()
            name = info.base_name
            if name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"):
                continue  # hidden from Spark's readers as well
            if info.type == fs.FileType.Directory:
                rest += store.get_file_info(fs.FileSelector(info.path))
            elif info.size:
                yield info.path

    def rows(names, texts):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["path", "content"])

    def read(places):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        names, texts, size = [], [], 0
        for place in (k for b in places for k in b.column(0).to_pylist()):
            for name in below(store, tops[place]):
                with store.open_input_stream(name, compression=None) as file:
                    texts.append(file.read())
                names.append(name)
                size += len(name) + len(texts[-1])
                if size >= batch:
                    yield rows(names, texts)
                    names, texts, size = [], [], 0
        if names:
            yield rows(names, texts)

    return read


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of all files that were written so; as with Spark's readers without those that have no bytes or are hidden (``_x``, ``.x``)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder.rstrip("/"))
    tops = [f.path for f in store.get_file_info(fs.FileSelector(path))]
    places = spark.range(0, len(tops), 1, max(1, len(tops)))
    files = places.mapInArrow(_reader(folder.rstrip("/"), tops), "path string, content binary")
    return files.select(F.regexp_extract("path", r"/part-[0-9a-f]{32}-[0-9]+/(.*)$", 1).alias("path"), F.col("content").cast("string").alias("text"))
