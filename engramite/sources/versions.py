"""Tables with versions: parts that are never changed, and a log that says which of them each version has.

A version is one file of the log, written beside it and renamed to its number, which fails if another writer took that
number; so a reader sees a version whole or not at all, and of two writers at once one has to begin again. Rows of a
table with keys replace earlier rows of their keys when read; a delete is a part of keys. Reading names the parts of one
version once and goes on with them whatever is committed meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    #: (part, kind) in the order of writing; kind is rows or gone.
    parts: tuple = ()
    #: Marks of work that has been committed, such as batches of a stream.
    done: tuple = field(default=())


class Table:
    """A table of versions in a folder. ``keys`` make later rows replace earlier ones; without them rows are only added."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys or []
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, conf = hadoop.Path, spark._jsc.hadoopConfiguration()
        self._log = self._path(f"{self.path}/log")
        self._files = self._log.getFileSystem(conf)
        self._moves = hadoop.FileContext.getFileContext(self._log.getFileSystem(conf).getUri(), conf)
        self._plain = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)  # no option: never over a file

    # the log

    def versions(self) -> list[int]:
        """The numbers of the versions that can be read."""
        if not self._files.exists(self._log):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, the latest if none is named; number 0 is the empty table."""
        number = (self.versions() or [0])[-1] if number is None else number
        if not number:
            return Version()
        stream = self._files.open(self._path(f"{self.path}/log/{number}.json"))
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, tuple(map(tuple, told["parts"])), tuple(told["done"]))

    def commit(self, after: Version, parts: list, done: list | None = None) -> Version:
        """The version that follows ``after``, or a ``Conflict``."""
        made = Version(after.number + 1, tuple(map(tuple, parts)), tuple(done if done is not None else after.done))
        aside, place = self._path(f"{self.path}/log/.{uuid.uuid4().hex}"), self._path(f"{self.path}/log/{made.number}.json")
        stream = self._files.create(aside, False)
        stream.write(json.dumps({"parts": made.parts, "done": made.done}).encode())
        stream.close()
        try:
            self._moves.rename(aside, place, self._plain)
        except Exception as taken:
            self._files.delete(aside, False)
            if "FileAlreadyExists" not in str(taken):
                raise
            raise Conflict(f"version {made.number} of {self.path} is there already") from taken
        return made

    def change(self, make: Callable[[Version], tuple[list, list] | None], tries: int = 10) -> Version:
        """Commit what ``make`` gives for the latest version, again if another writer was first; nothing if it gives None."""
        for _ in range(tries):
            now = self.version()
            wanted = make(now)
            if wanted is None:
                return now
            try:
                return self.commit(now, *wanted)
            except Conflict:
                continue
        raise Conflict(f"{tries} times another writer of {self.path} was first")

    # writing

    def _part(self, frame: DataFrame) -> str:
        part = uuid.uuid4().hex
        frame.write.parquet(f"{self.path}/parts/{part}")
        return part

    def add(self, frame: DataFrame, mark: str | None = None) -> Version:
        """Add rows, or replace those of their keys. Work with a mark that has been committed is not done again."""
        if mark is not None and mark in self.version().done:
            return self.version()
        part = self._part(frame.dropDuplicates(self.keys) if self.keys else frame)
        return self.change(lambda now: None if mark is not None and mark in now.done else ([*now.parts, (part, "rows")], [*now.done, *([mark] if mark else [])]))

    def delete(self, keys: DataFrame) -> Version:
        """Delete the rows of these keys."""
        part = self._part(keys.select(*self.keys).distinct())
        return self.change(lambda now: ([*now.parts, (part, "gone")], list(now.done)))

    def replace(self, frame: DataFrame) -> Version:
        """A version of these rows only."""
        part = self._part(frame)
        return self.change(lambda now: ([(part, "rows")], list(now.done)))

    def merge(self) -> Version:
        """The same rows in one part. If another writer commits meanwhile the work is done again."""

        def make(now: Version):
            return ([(self._part(self.read(now.number)), "rows")], list(now.done)) if len(now.parts) > 1 else None

        return self.change(make)

    def expire(self, keep: int) -> int:
        """Forget all but the latest versions, and delete parts that none of those has; how many went. Readers of older versions fail."""
        numbers = self.versions()
        old, kept = numbers[:-keep], numbers[-keep:]
        needed = {part for n in kept for part, _ in self.version(n).parts}
        gone = {part for n in old for part, _ in self.version(n).parts} - needed
        for number in old:
            self._files.delete(self._path(f"{self.path}/log/{number}.json"), False)
        for part in gone:
            self._files.delete(self._path(f"{self.path}/parts/{part}"), True)
        return len(gone)

    # reading

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version, the latest if none is named; None for a table without rows parts."""
        parts = self.version(number).parts
        frames = [(self.spark.read.parquet(f"{self.path}/parts/{part}"), kind, place) for place, (part, kind) in enumerate(parts)]
        rows = [f for f, kind, _ in frames if kind == "rows"]
        if not rows:
            return None
        columns = rows[-1].columns
        if not self.keys or len(parts) == 1:
            out = rows[0]
            for more in rows[1:]:
                out = out.unionByName(more, allowMissingColumns=True)
            return out.select(*columns)
        out, row, shape = None, "__row", {f.name: f.dataType for f in rows[-1].schema.fields}
        for frame, kind, place in frames:
            body = F.struct(*[(F.col(c) if c in frame.columns else F.lit(None)).cast(t).alias(c) for c, t in shape.items()])
            one = frame.select(*self.keys, F.lit(place).alias("__place"), (body if kind == "rows" else F.lit(None).cast(rows[-1].schema)).alias(row))
            out = one if out is None else out.unionByName(one)
        last = out.groupBy(*self.keys).agg(F.max_by(F.struct(row), "__place").alias("last")).where(f"last.{row} is not null")
        return last.select(*[F.col(f"last.{row}.{c}").alias(c) for c in columns])
