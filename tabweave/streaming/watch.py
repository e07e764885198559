"""Watch mode: a run starts once its inputs have stopped changing.

`Watch` judges signatures of local files. For files in a store that only Spark reads,
`on_change` uses a file stream as the signal: each batch of new files starts a run over
all inputs.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import write_json

EDGE = 64 << 10


def signature(path: str) -> tuple | None:
    """Name, place, size, times and a digest of both ends of a file; None if it is gone."""
    try:
        s = os.stat(path)
        with open(path, "rb") as f:
            head = f.read(EDGE)
            f.seek(max(s.st_size - EDGE, 0))
            tail = f.read(EDGE)
    except OSError:
        return None
    return (os.path.realpath(path), s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns, s.st_ctime_ns, hashlib.sha256(head + tail).hexdigest())


def fingerprint(signatures: Sequence[tuple | None], config: str = "") -> str:
    return hashlib.sha256(json.dumps([signatures, config]).encode()).hexdigest()


@dataclass
class Watch:
    """waiting, changed, settling, ready, unchanged or deleted, from one look to the next."""

    settle: float = 1.0
    config: str = ""
    done: str | None = None
    last: str | None = None
    since: float = 0.0
    seen: list = field(default_factory=list)

    def observe(self, signatures: Sequence[tuple | None], now: float) -> str:
        if not signatures:
            return "waiting"
        if any(s is None for s in signatures):
            self.last = None
            return "deleted"
        mark = fingerprint(signatures, self.config)
        if mark != self.last:
            self.last, self.since = mark, now
            return "unchanged" if mark == self.done else "changed"
        if mark == self.done:
            return "unchanged"
        return "ready" if now - self.since >= self.settle else "settling"

    def finished(self) -> None:
        """The run over what was seen last has ended, well or not: it isn't tried again until an input changes."""
        self.done = self.last

    def save(self, path: str) -> str:
        return write_json(path, {"format": "tabweave-watch", "version": 1, "done": self.done, "config": self.config})

    @classmethod
    def load(cls, path: str, settle: float = 1.0, config: str = "") -> Watch:
        """State of an earlier watch; one for another configuration starts anew."""
        try:
            with open(path, encoding="utf-8") as f:
                d = json.load(f)
        except (OSError, ValueError):
            d = {}
        return cls(settle, config, d.get("done") if d.get("config") == config else None)


def loop(files: Callable[[], Sequence[str]], run: Callable[[], None], state: str, interval: float = 2.0, settle: float = 1.0, config: str = "", rounds: int | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> int:
    """Looks every `interval` seconds, for ever or `rounds` times; gives the number of runs that ended well."""
    watch, good, n = Watch.load(state, settle, config), 0, 0
    while rounds is None or n < rounds:
        n += 1
        if watch.observe([signature(f) for f in files()], clock()) == "ready":
            try:
                run()
                good += 1
            finally:
                watch.finished()
                watch.save(state)
        sleep(interval)
    return good


def on_change(spark: SparkSession, folder: str, checkpoint: str, run: Callable[[], None]) -> StreamingQuery:
    """Starts `run` once for all files of the folder that are new since the checkpoint, then ends."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            run()

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "modificationTime")
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
