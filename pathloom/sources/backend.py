"""Pluggable backends as a Python data source: spark.read.format("pathloom_backend"), or spark.readStream.

Options: root, a folder in any file system that pyarrow opens by its address (file, hdfs, s3, gs, or a plain path) from driver and executors;
extensions, comma-separated; run, the backend as `module:function`, which takes a file's relative path and text and yields (function_name,
line_start, line_end, node_type, code); files, how many a task reads. A backend is any importable function, so a new one needs
no change here. A file that can't be read, or that the backend fails on, gives one row of type ERROR with the reason as its code.

Filters on file_path (=, IN, LIKE 'x%', LIKE '%x') choose files before any is read. A stream gives each file once it is there, and
again when it changes: its offset is the last (time of change, path) given out, so a file that appears with an older time than that is not seen.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

FOUND = "file_path string, function_name string, line_start int, line_end int, node_type string, code string"


def c_like(path: str, text: str) -> Iterator[tuple]:
    """The regex extractor as a backend."""
    from pathloom.sources.extract import elements

    for _, _, name, first, last, kind, code in elements(text):
        yield name, first, last, kind, code


def _test(f: Filter) -> Callable[[str], bool] | None:
    """What a filter asks of a file's path; None if it is about anything else."""
    if getattr(f, "attribute", None) != ("file_path",):
        return None
    if isinstance(f, EqualTo):
        return lambda p: p == f.value
    if isinstance(f, In):
        return lambda p: p in f.value
    if isinstance(f, StringStartsWith):
        return lambda p: p.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return lambda p: p.endswith(f.value)
    return None


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class BackendSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pathloom_backend"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Folder:
    """The files of a root, and how they are read."""

    def __init__(self, options):
        self.root, self.run = options["root"], options.get("run", "pathloom.sources.backend:c_like")
        self.endings = tuple("." + e.strip() for e in options.get("extensions", "c,cc,cpp,h,hpp").split(","))
        self.each = int(options.get("files", "64"))
        self.tests: list[Callable[[str], bool]] = []
        self.prefixes: list[str] = []

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def listed(self) -> list[tuple[int, str]]:
        """(time of change, relative path) of every file that is asked for, by path."""
        from pyarrow import fs

        system, base = self._open()
        base = base.rstrip("/") + "/"
        # Folders that no file asked for can lie in are not opened.
        top = system.get_file_info(fs.FileSelector(base))
        inside = (x for d in top if d.type == fs.FileType.Directory and self._may_hold(d.path.removeprefix(base) + "/") for x in system.get_file_info(fs.FileSelector(d.path, recursive=True)))
        found = ((i.mtime_ns or 0, i.path.removeprefix(base)) for i in chain(top, inside) if i.is_file)
        return sorted(((t, p) for t, p in found if p.endswith(self.endings) and all(test(p) for test in self.tests)), key=lambda x: x[1])

    def _may_hold(self, folder: str) -> bool:
        return all(folder.startswith(p) or p.startswith(folder) for p in self.prefixes)

    def dealt(self, paths: list[str]) -> list[InputPartition]:
        return [_Files(paths[i : i + self.each]) for i in range(0, len(paths), self.each)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        module, _, function = self.run.partition(":")
        backend = getattr(importlib.import_module(module), function)
        system, base = self._open()
        for path in partition.paths:
            try:
                with system.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                    rows = list(backend(path, f.read().decode("utf-8", "replace")))
            except Exception as e:  # a backend's failure on one file is that file's row
                rows = [("", 0, 0, "ERROR", type(e).__name__)]
            for row in rows:
                yield (path, *row)


class _Reader(_Folder, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = _test(f)
            if test:
                self.tests.append(test)
                if isinstance(f, EqualTo | StringStartsWith):
                    self.prefixes.append(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return self.dealt([p for _, p in self.listed()])


class _StreamReader(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        time, path = max(self.listed(), default=(-1, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return self.dealt([p for t, p in self.listed() if low < (t, p) <= high])

    def commit(self, end: dict) -> None:
        """Nothing is held for an offset."""


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters down."""
    from pathloom.functions.tables import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BackendSource)
