"""SARIF documents as a Python data sink: results.write.format("pathloom_sarif").mode("append").save(path).

Rows are results as JSON (column `result`, as export.sarif_results gives them). Each task writes its results to a part of its own beside the
document and tells the driver which; the commit reads one part after the other into a new document, a piece at a time, and puts that in the
old one's place. Until then, and if the job fails, the old document stays, and an abort leaves no parts.

Options: path, a file in any file system that pyarrow opens from driver and executors; tool, version; batch, a number: the document of a batch not
above the last one written there is left as it is, so that a repeated batch changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA_URI = "https://json.schemastore.org/sarif-2.1.0.json"
PIECE = 1 << 20


@dataclass
class _Part(WriterCommitMessage):
    path: str | None
    results: int


class SarifSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pathloom_sarif"

    def schema(self) -> str:
        return "result string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path, self.tool, self.version = options["path"], options.get("tool", "pathloom"), options.get("version", "0.1.0")
        self.batch = int(options["batch"]) if "batch" in options else None
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def _open(self, at: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(at)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """One part, results parted by commas; a task that is repeated writes another, and only the one that is told counts."""
        system, folder = self._open(self.parts)
        first = next(rows, None)
        if first is None:
            return _Part(None, 0)
        system.create_dir(folder)
        at, n = f"{folder}/{uuid.uuid4().hex}", 1
        spaced = lambda row: json.dumps(json.loads(row["result"])).encode()
        with system.open_output_stream(at) as out:
            out.write(spaced(first))
            for row in rows:
                out.write(b",\n" + spaced(row))
                n += 1
        return _Part(at, n)

    def commit(self, messages: list[_Part | None]) -> None:
        system, at = self._open(self.path)
        if self.batch is not None and self._last(system, at) >= self.batch:
            return self.abort(messages)
        whole = json.dumps({"$schema": SCHEMA_URI, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": self.tool, "version": self.version}}, "results": []}]})
        head, tail = whole[:-4], whole[-4:]
        with system.open_output_stream(f"{at}.new") as out:
            out.write(head.encode())
            for k, part in enumerate(m for m in messages if m and m.path):
                out.write(b",\n" if k else b"\n")
                with system.open_input_stream(part.path) as f:
                    while piece := f.read(PIECE):
                        out.write(piece)
            out.write(tail.encode())
        system.move(f"{at}.new", at)
        if self.batch is not None:
            with system.open_output_stream(f"{at}.batch") as out:
                out.write(str(self.batch).encode())
        return self.abort(messages)

    def abort(self, messages: list[_Part | None]) -> None:
        """No part stays."""
        from pyarrow import fs

        system, folder = self._open(self.parts)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)

    def _last(self, system, at: str) -> int:
        try:
            with system.open_input_stream(f"{at}.batch") as f:
                return int(f.read())
        except FileNotFoundError:
            return -1


def register(spark: SparkSession) -> None:
    from pathloom.functions.tables import ship

    ship(spark)
    spark.dataSource.register(SarifSink)


def write_sarif(results: DataFrame, path: str, **options: str | int) -> None:
    """results (result) as one document at path, in their order by partitions."""
    register(results.sparkSession)
    results.select("result").write.format("pathloom_sarif").options(**options).mode("append").save(path)
