"""One run at a time, with a rerun for whoever came meanwhile: claims, beats and marks as files in a shared folder.

Turns are numbered, and a turn belongs to the one who makes its file. It is open until its end is written, and its holder
says it is alive by making its beat anew; a turn whose beat is too old is lost, and the next turn may be taken. Who finds
a turn open leaves a mark, which the holder takes away before it runs once more. Ages are told by the file system's
clock, so the clocks of the machines don't matter.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from galleon.sources.keyed import Conflict
from galleon.sources.snapshots import _fs, create_once


class SingleFlight:
    def __init__(self, spark: SparkSession, folder: str, seconds: float = 60.0) -> None:
        """seconds: after so long without a beat a holder is taken for lost."""
        self.spark, self.folder, self.seconds = spark, folder.rstrip("/"), seconds

    # --- files ---

    def _names(self, kind: str) -> list[str]:
        fs, path = _fs(self.spark, self.folder)
        if not fs.exists(path(f"{self.folder}/{kind}")):
            return []
        return sorted(n for s in fs.listStatus(path(f"{self.folder}/{kind}")) if not (n := s.getPath().getName()).startswith("."))

    def _touch(self, name: str) -> int:
        """Makes an empty file anew; its time."""
        fs, path = _fs(self.spark, self.folder)
        fs.create(path(f"{self.folder}/{name}"), True).close()
        return fs.getFileStatus(path(f"{self.folder}/{name}")).getModificationTime()

    def _drop(self, name: str) -> bool:
        fs, path = _fs(self.spark, self.folder)
        return fs.delete(path(f"{self.folder}/{name}"), False)

    def _now(self) -> int:
        name = f"clock/{uuid.uuid4().hex}"
        now = self._touch(name)
        self._drop(name)
        return now

    # --- turns ---

    def turn(self) -> int:
        return max(map(int, self._names("turns")), default=0)

    def open(self) -> bool:
        """Whether the newest turn has a holder that is alive."""
        n = self.turn()
        if not n or f"{n:012d}" in self._names("ends"):
            return False
        fs, path = _fs(self.spark, self.folder)
        now = self._now()
        beats = [s.getModificationTime() for s in fs.listStatus(path(f"{self.folder}/beats")) if s.getPath().getName() == f"{n:012d}"] if self._names("beats") else []
        last = max([*beats, fs.getFileStatus(path(f"{self.folder}/turns/{n:012d}")).getModificationTime()])
        return now - last < self.seconds * 1000

    def _claim(self) -> int | None:
        n = self.turn() + 1
        if self.open() or not create_once(self.spark, f"{self.folder}/turns/{n:012d}", ""):
            return None
        self._touch(f"beats/{n:012d}")
        for kind in ("turns", "beats", "ends"):  # of turns long over
            for name in self._names(kind):
                if int(name) < n - 1:
                    self._drop(f"{kind}/{name}")
        return n

    @contextmanager
    def _alive(self, n: int) -> Iterator[None]:
        """Beats while the block runs; the turn ends with it, also where it fails."""
        over = threading.Event()

        def beat() -> None:
            while not over.wait(self.seconds / 4):
                self._touch(f"beats/{n:012d}")

        thread = threading.Thread(target=beat, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()
            if self.turn() == n:
                self._touch(f"ends/{n:012d}")

    def _take_marks(self) -> bool:
        marks = self._names("marks")
        for m in marks:
            self._drop(f"marks/{m}")
        return bool(marks)

    def run(self, work: Callable[[int, bool], None]) -> int:
        """How often work(turn, rerun) ran here; 0 if another one has the turn, who runs once more when it is done.

        What a caller allows for its own run isn't passed on: reruns are told apart by `rerun`. A holder that was taken
        for lost, but wasn't, ends in a Conflict; writers can keep the turn with what they write, and refuse older ones.
        """
        ran, mark = 0, None
        while True:
            n = self._claim()
            if n is None:
                if mark is None:
                    mark = uuid.uuid4().hex
                    self._touch(f"marks/{mark}")
                elif mark not in self._names("marks"):
                    return ran  # someone took it, and runs after it was made
                if self.open():
                    return ran  # its holder looks for marks when it has ended, too
                continue
            with self._alive(n):
                self._take_marks()  # they asked for a run that begins now
                mark = None
                work(n, ran > 0)
                ran += 1
                while self._take_marks():
                    work(n, True)
                    ran += 1
                if self.turn() != n:
                    raise Conflict(f"turn {n} in {self.folder} was taken over")
            if not self._names("marks"):
                return ran
