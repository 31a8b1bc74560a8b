"""Calls and their results from transcripts that still grow, as a source of a batch and of a stream.

A transcript is a file of JSON lines, one step each (step_index, type, content, tool_calls). The results of a model step's calls
are the GENERIC steps that directly follow it. A step counts once all its calls are answered; the first step that is not
answered holds back all that follows it in its file, and is looked at again when the file has grown.

An offset is, for each file, how many bytes it had. What a file has to tell between two offsets is a function of its bytes up
to each: the pairs of all steps before the first unanswered one then, less those before the first unanswered one of the earlier
offset. So no pair is given twice or lost, whatever the triggers are and whenever a query starts again, and nothing but
offsets is remembered. The driver lists files and their sizes; a changed file is read by a task, line by line, from its start.

Cases: a line that is still being written is no object yet and does not count; damaged lines, blank ones and what is no object are
left out; a step without step_index has its line's number; a step without calls has nothing to tell; files that vanish are read
no more; a file that shrinks is taken for a new one once it is larger again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAIRS = "session string, step_index long, n int, name string, args map<string,string>, result string"


def _steps(lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, dict]]:
    """(where the step's line ends, its number, the step)."""
    for number, (end, line) in enumerate(lines):
        try:
            step = json.loads(line)
        except ValueError:
            continue
        if isinstance(step, dict):
            index = step.get("step_index")
            yield end, index if isinstance(index, int) and not isinstance(index, bool) else number, step


def pairs_between(lines: Iterator[tuple[int, bytes]], start: int) -> Iterator[tuple]:
    """(step_index, n, name, args, result) of the steps answered by the end of the lines that were not answered, or held back, when
    the file had `start` bytes. lines: (where it ends, line)."""
    waiting: tuple[int, list] | None = None  # a step and its calls, some of them not answered yet
    results: list[str] = []
    early = True  # whether all steps so far were answered within the first `start` bytes
    for end, index, step in _steps(lines):
        if waiting is not None:
            if step.get("type") != "GENERIC":
                return  # it can't be answered any more, and holds back the rest
            results.append(str(step.get("content") if step.get("content") is not None else ""))
            if len(results) == len(waiting[1]):
                early = early and end <= start
                if not early:
                    yield from _paired(*waiting, results)
                waiting = None
            continue
        calls = step.get("tool_calls")
        if step.get("type") == "PLANNER_RESPONSE" and isinstance(calls, list) and calls:
            waiting, results = (index, calls), []


def _paired(index: int, calls: list, results: list[str]) -> Iterator[tuple]:
    for n, (call, result) in enumerate(zip(calls, results, strict=True)):
        call = call if isinstance(call, dict) else {}
        args = call.get("args")
        text = lambda v: v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)
        yield index, n, text(call.get("name")), {k: text(v) for k, v in args.items()} if isinstance(args, dict) else None, result


class _File(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class _Folder:
    """Files of a folder, below it too, by their name's end."""

    def __init__(self, options: dict) -> None:
        self.folder, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".jsonl")

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")

    def sizes(self) -> dict[str, int]:
        from pyarrow import fs

        store, base = self._store()
        return {f.path: f.size for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(self.suffix)}

    def lines(self, path: str, end: int) -> Iterator[tuple[int, bytes]]:
        """Lines of the first `end` bytes, the last one as far as it goes."""
        at, rest = 0, b""
        with self._store()[0].open_input_stream(path) as file:
            while at < end:
                block = file.read(min(1 << 20, end - at))
                if not block:
                    break
                parts = (rest + block).split(b"\n")
                begun = at - len(rest)
                at += len(block)
                rest = parts.pop()
                for line in parts:
                    yield begun + len(line), line
                    begun += len(line) + 1
        if rest:
            yield at, rest

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:  # of an empty folder
            return
        for row in pairs_between(self.lines(partition.path, partition.end), partition.start):
            yield partition.path, *row


class _Batch(_Folder, DataSourceReader):
    def partitions(self) -> list[_File]:
        return [_File(path, 0, size) for path, size in sorted(self.sizes().items())]


class _Stream(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.sizes()

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(path, start.get(path, 0), size) for path, size in sorted(end.items()) if size > start.get(path, 0)]

    def commit(self, end: dict) -> None:
        pass


class Transcripts(DataSource):
    """spark.read / readStream.format("transcripts"), options path and suffix (.jsonl); spark.dataSource.register(Transcripts) first."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return PAIRS

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
