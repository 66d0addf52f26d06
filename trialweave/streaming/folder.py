"""A stream of a folder's trial files: a file is given once, when its size has stood still for a while, and one that vanishes is forgotten.

The source has offsets of its own: the number of files given so far, in a log beside the checkpoint, from which a stream that starts again goes on.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, trial long, length long"


class _Given(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class FolderReader(DataSourceStreamReader):
    """Lists the folder at each trigger. A file that is new or has changed in size starts to be watched; after `quiet` seconds at one size it is given.

    Options: path, log (a folder of this stream alone), pattern (a regular expression with the trial's number), quiet, and settle: with
    it, a trigger waits until no file that it has seen is still being watched or `settle` seconds have passed, for streams that take what is there and end.
    """

    def __init__(self, options: dict):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.log = options["log"] if "://" not in options["log"] else fs.FileSystem.from_uri(options["log"])[1]
        self.pattern = re.compile(options.get("pattern", r"_(\d+)_mc\.tif$"))
        self.quiet, self.settle = float(options.get("quiet", 3)), float(options.get("settle", 0))
        self.watched: dict[str, tuple[int, float]] = {}
        self.fs.create_dir(self.log, recursive=True)
        self.given = self._logged()
        self.known = {row[0] for row in self.given}

    def _logged(self) -> list[tuple]:
        from pyarrow import fs

        names = sorted(f.path for f in self.fs.get_file_info(fs.FileSelector(self.log)) if f.path.endswith(".json"))
        return [tuple(row) for name in names for row in json.loads(self.fs.open_input_stream(name).read())]

    def _note(self, rows: list[tuple]) -> None:
        """Logs files in the order in which they are given, before they are."""
        name = f"{self.log}/{len(self.given):012d}.json"
        with self.fs.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps(rows).encode())
        self.fs.move(f"{name}.tmp", name)
        self.given += rows
        self.known |= {row[0] for row in rows}

    def scan(self, now: float) -> list[tuple]:
        """Files that are complete now, by trial, then path."""
        from pyarrow import fs

        files = {f.path: f.size for f in self.fs.get_file_info(fs.FileSelector(self.folder)) if f.type == fs.FileType.File and self.pattern.search(f.base_name) and f.path not in self.known}
        self.watched = {p: w for p, w in self.watched.items() if p in files}
        ready = []
        for path, size in files.items():
            if path not in self.watched or self.watched[path][0] != size:
                self.watched[path] = (size, now)
            elif size > 0 and now - self.watched[path][1] >= self.quiet:
                ready.append((path, int(self.pattern.search(path).group(1)), size))
        for path, *_ in ready:
            del self.watched[path]
        return sorted(ready, key=lambda row: (row[1], row[0]))

    def initialOffset(self) -> dict:
        return {"given": 0}

    def latestOffset(self) -> dict:
        end = time.time() + self.settle
        while True:
            if ready := self.scan(time.time()):
                self._note(ready)
            if not self.watched or time.time() >= end:
                return {"given": len(self.given)}
            time.sleep(min(0.2, self.quiet + 0.01))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if len(self.given) < end["given"]:
            self.given = self._logged()
        rows = self.given[start["given"] : end["given"]]
        return [_Given(rows[k : k + 1000]) for k in range(0, len(rows), 1000)]

    def read(self, partition: _Given) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        pass


class TrialFolder(DataSource):
    """spark.dataSource.register(TrialFolder); spark.readStream.format("trial_folder").options(path=..., log=...).load()"""

    @classmethod
    def name(cls) -> str:
        return "trial_folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)
