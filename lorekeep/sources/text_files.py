"""A sink of text files with names of their own: one file a row, written where the rows are."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class NamedTextFiles(DataSource):
    """Rows (file string, text string) as files below the path: `file` may name folders; an existing file of that name is
    replaced, others stay. Equal names: the row that is written last counts. Null text is an empty file; null file is an error.

    A row's file depends on the row alone, so a task that runs twice, or on another executor, writes the same files."""

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if set(schema.fieldNames()) != {"file", "text"}:
            raise ValueError("rows have a file and a text")
        if overwrite:
            raise ValueError("files of other names are left alone: append")
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        made: set[str] = set()
        for row in rows:
            at = f"{base}/{row.file}"
            above = at.rpartition("/")[0]
            if row.file.startswith("/") or ".." in row.file.split("/"):
                raise ValueError(f"{row.file} is not below the folder")
            if above not in made:
                store.create_dir(above, recursive=True)
                made.add(above)
            with store.open_output_stream(at) as out:
                out.write((row.text or "").encode("utf-8"))
        return WriterCommitMessage()


def write_files(rows: DataFrame, folder: str) -> None:
    """file, text: each row as the file of that name below the folder."""
    rows.sparkSession.dataSource.register(NamedTextFiles)
    rows.select("file", "text").write.format("named_text").mode("append").save(folder)
