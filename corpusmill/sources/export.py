"""One document from a table of any size: tasks write parts, a commit puts them together.

A Python data source whose tasks write rows as CSV lines or JSON items into a hidden folder beside the target. The commit streams the committed parts,
in order of their partitions, behind the one head into a new file, which then takes the target's name; what other attempts wrote is in no message and
goes with the folder. A write that fails leaves what was there before.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes of a part that the commit holds at once.
CHUNK = 1 << 20
#: Fixed value: the mark that some spreadsheet programs want at the beginning of UTF-8.
BOM = b"\xef\xbb\xbf"


def _store(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file:///" + path.removeprefix("file:").lstrip("/"))


@dataclass
class Part(WriterCommitMessage):
    name: str
    partition: int
    rows: int


class OneDocument(DataSource):
    """Options: path; kind (csv or json); bom (true or false; csv); head, a JSON object whose fields stand before the items, and items, the name of
    their list (json)."""

    @classmethod
    def name(cls) -> str:
        return "one_document"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options, schema.names, overwrite)


class DocumentWriter(DataSourceWriter):
    def __init__(self, options, columns: list[str], overwrite: bool):
        self.path, self.kind, self.columns = options["path"].rstrip("/"), options.get("kind", "csv"), columns
        self.bom, self.head, self.items = options.get("bom", "false") == "true", json.loads(options.get("head", "{}")), options.get("items", "items")
        if self.kind not in ("csv", "json"):
            raise ValueError(f"kind is csv or json, not {self.kind}")
        folder, _, name = self.path.rpartition("/")
        self.parts = f"{folder}/.{name}-{uuid.uuid4().hex[:12]}"
        store, inner = _store(self.path)
        if not overwrite and store.get_file_info(inner).type.name != "NotFound":
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        name, rows = f"part-{partition:06d}-{uuid.uuid4().hex[:8]}", 0
        store, inner = _store(self.parts)
        store.create_dir(inner, recursive=True)
        with store.open_output_stream(f"{inner}/{name}") as f:
            for row in iterator:
                f.write(self._line(row, rows == 0))
                rows += 1
        return Part(name, partition, rows)

    def _line(self, row, first: bool) -> bytes:
        if self.kind == "csv":
            return _csv_line([row[c] for c in self.columns])
        return (b"" if first else b",\n") + json.dumps({c: row[c] for c in self.columns}, ensure_ascii=False, default=str).encode()

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        store, inner = _store(self.parts)
        store.create_dir(inner, recursive=True)
        with store.open_output_stream(f"{inner}/whole") as out:
            out.write(self._opening())
            for i, part in enumerate(parts):
                if i and self.kind == "json":
                    out.write(b",\n")
                with store.open_input_stream(f"{inner}/{part.name}") as f:
                    while data := f.read(CHUNK):
                        out.write(data)
            out.write(b"]}\n" if self.kind == "json" else b"")
        store.move(f"{inner}/whole", _store(self.path)[1])
        store.delete_dir(inner)

    def _opening(self) -> bytes:
        if self.kind == "csv":
            return (BOM if self.bom else b"") + _csv_line(self.columns)
        head = "".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}, " for k, v in self.head.items())
        return ("{" + head + json.dumps(self.items) + ": [").encode()

    def abort(self, messages: list[Part | None]) -> None:
        store, inner = _store(self.parts)
        if store.get_file_info(inner).type.name != "NotFound":
            store.delete_dir(inner)


def _csv_line(values: list) -> bytes:
    line = io.StringIO()
    csv.writer(line, lineterminator="\r\n").writerow(["" if v is None else v for v in values])
    return line.getvalue().encode()


def _write(df: DataFrame, path: str, overwrite: bool, **options: str) -> None:
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(OneDocument)
    df.write.format("one_document").options(path=path, **options).mode("overwrite" if overwrite else "append").save()


def write_csv(df: DataFrame, path: str, bom: bool = True, overwrite: bool = True) -> None:
    """df as one CSV file with one header, rows in the order of its partitions; null is empty. Memory doesn't grow with the table."""
    _write(df, path, overwrite, kind="csv", bom=str(bom).lower())


def write_json(df: DataFrame, path: str, head: dict, items: str = "passages", overwrite: bool = True) -> None:
    """df as one JSON object: the fields of head, and all rows as a list."""
    _write(df, path, overwrite, kind="json", head=json.dumps(head), items=items)
