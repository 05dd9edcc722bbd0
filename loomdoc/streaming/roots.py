"""A streaming source of files below a set of roots that may change while the query runs."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "root string, file string, modified long, content string"

#: Files that a task reads.
TASK_FILES = 64


class Files(InputPartition):
    def __init__(self, found: list[tuple[str, str, int]]):
        self.found = found


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(root: str) -> list[tuple[int, str]]:
    """``(modified in ns, path)`` of the files below a root, or of the root if it is a file; none where there is nothing."""
    from pyarrow import fs

    system, path = _system(root)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(info.mtime_ns, info.path)]
    if info.type != fs.FileType.Directory:
        return []
    return sorted((f.mtime_ns, f.path) for f in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File)


class RootsReader(DataSourceStreamReader):
    """Offsets are a mark for each root: the time and path of the last file that was taken. A root that goes keeps its mark, so nothing comes twice if it returns; a new one begins with all its files.

    A file that is written again comes again. ``settle_ms`` leaves out files younger than that, so that one with an equal time that shows up later is not passed over, and bursts come together.
    """

    def __init__(self, control: str, settle_ms: int):
        self.control, self.settle_ms = control, settle_ms

    def roots(self) -> list[str]:
        system, path = _system(self.control)
        with system.open_input_stream(path) as file:
            return sorted(set(json.loads(file.read() or b"[]")))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        marks = dict(getattr(self, "marks", {}))
        latest = time.time_ns() - self.settle_ms * 1_000_000
        for root in self.roots():
            found = [f for f in _files(root) if f[0] <= latest]
            if found:
                marks[root] = max(list(found[-1]), marks.get(root, [0, ""]))
        self.marks = marks
        return marks

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.marks = {**end, **getattr(self, "marks", {})}
        taken = []
        for root, mark in sorted(end.items()):
            low = start.get(root, [-1, ""])
            if mark != low:
                taken += [(root, path, at) for at, path in _files(root) if low < [at, path] <= mark]
        return [Files(taken[i : i + TASK_FILES]) for i in range(0, len(taken), TASK_FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for root, path, modified in partition.found:
            try:
                with _system(root)[0].open_input_stream(path) as file:
                    content = file.read().decode("utf-8", "replace")
            except FileNotFoundError:  # gone since it was listed
                content = None
            yield root, path, modified, content

    def commit(self, end: dict) -> None:
        pass


class WatchedRoots(DataSource):
    """``spark.dataSource.register(WatchedRoots)``, then ``spark.readStream.format("watched_roots").option("control", file).load()``.

    ``control`` is a JSON list of roots (folders or files, by path or URI) that is read anew for every micro-batch; ``settleMs`` (0) as in the reader.
    """

    @classmethod
    def name(cls) -> str:
        return "watched_roots"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> RootsReader:
        return RootsReader(self.options["control"], int(self.options.get("settleMs", "0")))


def watch_roots(folders: list[str | None], files: list[str | None]) -> list[str]:
    """The roots of a configuration: its folders and files, each once, without blanks."""
    return sorted({r for r in (*folders, *files) if r})
