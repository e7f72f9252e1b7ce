"""A library as a stream: each poll asks every known directory for its time, and lists only those that changed.

What is known lies beside the stream, in a folder that all workers share: directories are dealt into slices by a hash of
their path, and for each poll a slice has one state file, made once and never replaced. The stream's offset is the number
of a poll, so a batch that runs again finds the state that its first run made and gives the same rows. A slice that
lists a directory hands the directories in it over to their slices, which take them up in the next poll: new trees are
walked a level at a time by all workers, and a task holds one slice.

Rows are figures of a slice that had something to do; the files are read by `known_files`. Dot entries at the top and
partial downloads (*.part) are left out, links aren't followed. A directory that can't be read keeps the files that were
known of it, and so does the whole library while its root is away; only one that is gone below a readable root goes.
"""

from __future__ import annotations

import json
import os
import stat
import time
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from galleon.sources.library_files import split_name

FIGURES = ("asked", "listed", "found", "added", "removed", "failed")
SCHEMA = "poll long, slice int, asked long, listed long, found long, added long, removed long, failed long"
FILES = "file_path string, file_name string, extension string, failed boolean"
#: A directory may change again within the tick of its clock: one that changed this lately is listed once more.
TICK = 2.0
SLICES = 64


def owner(directory: str, slices: int) -> int:
    return zlib.crc32(os.fsencode(directory)) % slices


def make_once(path: str, text: str) -> None:
    """The whole file or none; of several writers the first one counts."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(own, "w", encoding="utf-8", errors="surrogateescape") as f:
        f.write(text)
    try:
        os.link(own, path)
    except FileExistsError:
        pass
    finally:
        os.unlink(own)


def entries(path: str, top: bool) -> tuple[list[str], list[str]]:
    """Names of the files and of the directories."""
    files, folders = [], []
    with os.scandir(path) as found:
        for e in found:
            if top and e.name.startswith("."):
                continue
            if e.is_dir(follow_symlinks=False):
                folders.append(e.name)
            elif e.is_file(follow_symlinks=False) and not e.name.endswith(".part"):
                files.append(e.name)
    return sorted(files), sorted(folders)


class Slice(InputPartition):
    def __init__(self, number: int, poll: int) -> None:
        self.number, self.poll = number, poll


class Known:
    """State of one library: directory -> (time or -1 if it is to be listed again, file names, failed)."""

    def __init__(self, root: str, folder: str, slices: int) -> None:
        self.root, self.folder, self.slices = root, folder, slices

    def _state(self, number: int) -> str:
        return f"{self.folder}/state/{number:05d}"

    def polls(self, number: int) -> list[int]:
        try:
            return sorted(int(n) for n in os.listdir(self._state(number)) if n.isdigit())
        except FileNotFoundError:
            return []

    def header(self, number: int, poll: int) -> dict:
        with open(f"{self._state(number)}/{poll:012d}", encoding="utf-8", errors="surrogateescape") as f:
            return json.loads(f.readline())

    def load(self, number: int, until: int) -> tuple[int | None, dict[str, list], bool]:
        """(poll whose file has them, the directories, whether the root is away) of the newest poll up to this one."""
        poll = next((p for p in reversed(self.polls(number)) if p <= until), None)
        if poll is None:
            return None, {}, False
        head = self.header(number, poll)
        with open(f"{self._state(number)}/{head['as']:012d}", encoding="utf-8", errors="surrogateescape") as f:
            f.readline()
            return head["as"], {d: rest for d, *rest in map(json.loads, f)}, head["away"]

    def handed(self, number: int, until: int) -> set[str]:
        """Directories that were handed over to the slice."""
        found = {"."} if number == owner(".", self.slices) else set()
        place = f"{self.folder}/found/{number:05d}"
        for name in os.listdir(place) if os.path.isdir(place) else []:
            if not name.endswith(".tmp") and int(name.split("-")[0]) <= until:
                with open(f"{place}/{name}", encoding="utf-8", errors="surrogateescape") as f:
                    found.update(json.load(f))
        return found

    def poll(self, number: int, end: int) -> dict:
        """Figures of the slice's poll `end`, which is made unless it is there; nothing, if later ones have been made."""
        have = self.polls(number)
        if end not in have:
            if have and have[-1] > end:
                return dict.fromkeys(FIGURES, 0)
            self._make(number, end)
        return self.header(number, end)

    def _make(self, number: int, end: int) -> None:
        base, known, _ = self.load(number, end - 1)
        now: dict[str, list] = {}
        over: dict[int, list[str]] = {}
        n = dict.fromkeys(FIGURES, 0)
        away = not os.path.isdir(self.root)
        for d in [] if away else sorted(known.keys() | self.handed(number, end - 1)):
            n["asked"] += 1
            was = known.get(d)
            path = os.path.join(self.root, d)
            try:
                info = os.stat(path, follow_symlinks=d == ".")
                if not stat.S_ISDIR(info.st_mode):
                    raise NotADirectoryError(path)
                if was and was[0] == info.st_mtime_ns:
                    now[d] = was
                    continue
                n["listed"] += 1
                late = abs(time.time_ns() - info.st_mtime_ns) < TICK * 1e9
                files, folders = entries(path, d == ".")
                now[d] = [-1 if late else info.st_mtime_ns, files, False]
                for f in folders:
                    below = f if d == "." else f"{d}/{f}"
                    over.setdefault(owner(below, self.slices), []).append(below)
            except (FileNotFoundError, NotADirectoryError):
                continue  # its files are counted below
            except OSError:
                n["failed"] += 1
                now[d] = [-1, was[1] if was else [], True]
        if away:
            now, n["failed"] = known, len(known)
        n["found"] = len(now.keys() - known.keys())
        for d in known.keys() | now.keys():
            a, b = set(known[d][1] if d in known else ()), set(now[d][1] if d in now else ())
            n["added"] += len(b - a)
            n["removed"] += len(a - b)
        for other, found in over.items():
            make_once(f"{self.folder}/found/{other:05d}/{end:012d}-{number:05d}-{uuid.uuid4().hex}", json.dumps(found))
        same = base is not None and now == known
        lines = [json.dumps(n | {"as": base if same else end, "away": away}), *([] if same else [json.dumps([d, *v]) for d, v in now.items()])]
        make_once(f"{self._state(number)}/{end:012d}", "\n".join(lines) + "\n")

    def forget(self, end: int) -> None:
        """What no batch after `end`, and no reader that began before it, asks for."""
        for number in range(self.slices):
            polls = [p for p in self.polls(number) if p < end]
            kept = {self.header(number, p)["as"] for p in (*polls[-1:], *(p for p in self.polls(number) if p >= end))} | set(polls[-1:])
            for p in set(polls) - kept:
                os.unlink(f"{self._state(number)}/{p:012d}")
            place = f"{self.folder}/found/{number:05d}"
            for name in os.listdir(place) if os.path.isdir(place) else []:
                if int(name.split("-")[0]) < end:
                    os.unlink(f"{place}/{name}")


class WatchStream(DataSourceStreamReader):
    def __init__(self, known: Known) -> None:
        self.known = known

    def initialOffset(self) -> dict:
        """A new stream goes on from what is known."""
        return {"poll": max(self.known.polls(0), default=0)}

    def latestOffset(self) -> dict:
        return {"poll": max(self.known.polls(0), default=0) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Slice(k, end["poll"]) for k in range(self.known.slices)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        n = self.known.poll(partition.number, partition.poll)
        if n["listed"] or n["removed"] or n["failed"]:
            yield (partition.poll, partition.number, *[n[f] for f in FIGURES])

    def commit(self, end: dict) -> None:
        self.known.forget(end["poll"])


class FilesReader(DataSourceReader):
    def __init__(self, known: Known) -> None:
        self.known = known

    def partitions(self) -> list[InputPartition]:
        polls = [self.known.polls(k) for k in range(self.known.slices)]
        return [Slice(k, p[-1]) for k, p in enumerate(polls) if p]

    def read(self, partition: Slice) -> Iterator[tuple]:
        _, known, away = self.known.load(partition.number, partition.poll)
        for d, (_, files, failed) in known.items():
            for name in files:
                yield (d, *split_name(name), False)
            if failed or (away and d == "."):
                yield (d, None, None, True)


class WatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library_watch"

    def schema(self) -> str:
        return FILES if self.options.get("files") else SCHEMA

    def _known(self) -> Known:
        return Known(self.options["path"], self.options["state"], int(self.options["slices"]))

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(self._known())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return WatchStream(self._known())


def watched(spark: SparkSession, root: str, state: str, slices: int = SLICES) -> DataFrame:
    """The stream of figures (SCHEMA). Paths are those that workers mount; a state folder belongs to one stream and one number of slices."""
    spark.dataSource.register(WatchSource)
    return spark.readStream.format("library_watch").option("state", state).option("slices", slices).load(root)


def known_files(spark: SparkSession, root: str, state: str, slices: int = SLICES) -> DataFrame:
    """file_path, file_name, extension, failed: what the newest poll knows. Failed rows have no name and stand for directories that can't be read."""
    spark.dataSource.register(WatchSource)
    return spark.read.format("library_watch").option("state", state).option("slices", slices).option("files", "true").load(root)
