"""Several targets published as one: all are new, or all are as they were.

Executors write each target's rows beside it. Only when all are written and hold
what was announced are they put in place: each old target is moved aside, each new
one moved in, by renames of the file system that the paths name. A journal in the folder
of the first target lists the moves before the first one, so a run that dies between
two renames is completed or undone by ``recover``. What goes takes its files with it: a
target is replaced as a whole, and ``stale`` names paths that go without a successor.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymill.sources.staging import hadoop_path


class CommitError(RuntimeError):
    """A step of a commit that did not do what it should."""


class Files:
    """The few calls of a file system that a commit needs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def exists(self, path: str) -> bool:
        at, files = hadoop_path(self.spark, path)
        return files.exists(at)

    def remove(self, path: str) -> None:
        at, files = hadoop_path(self.spark, path)
        files.delete(at, True)

    def rename(self, old: str, new: str) -> None:
        (at, files), (to, _) = hadoop_path(self.spark, old), hadoop_path(self.spark, new)
        files.mkdirs(to.getParent())
        if not files.rename(at, to):
            raise CommitError(f"{old} could not be moved to {new}")

    def write(self, path: str, text: str) -> None:
        """The whole text, under another name first, so that a reader sees all or nothing."""
        part = f"{path}.part"
        at, files = hadoop_path(self.spark, part)
        out = files.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.rename(part, path)

    def read(self, path: str) -> str:
        at, files = hadoop_path(self.spark, path)
        stream = files.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def _undo(files: Files, moves: list[dict]) -> None:
    """Puts back whatever stage a move has come to. Doing it twice does no harm."""
    for m in reversed(moves):
        if m["staged"] and files.exists(m["backup"]) and files.exists(m["target"]):
            files.remove(m["target"])
        elif m["staged"] and not m["had"] and not files.exists(m["staged"]):
            files.remove(m["target"])
        if files.exists(m["backup"]):
            files.rename(m["backup"], m["target"])
        if m["staged"]:
            files.remove(m["staged"])


def _finish(files: Files, moves: list[dict], journal: str) -> None:
    files.remove(journal)  # from here on the new targets stand
    for m in moves:
        files.remove(m["backup"])


def recover(spark: SparkSession, journal: str, files: Files | None = None) -> str:
    """Ends what a run that died has left: ``none`` without a journal, ``completed`` where every
    new target is in place, else ``undone``."""
    files = files or Files(spark)
    if not files.exists(journal):
        return "none"
    moves = json.loads(files.read(journal))
    if all(files.exists(m["target"]) and not files.exists(m["staged"]) if m["staged"] else not files.exists(m["target"]) for m in moves):
        _finish(files, moves, journal)
        return "completed"
    _undo(files, moves)
    files.remove(journal)
    return "undone"


def publish(spark: SparkSession, targets: dict[str, DataFrame], journal: str, expect: dict[str, int] | None = None, check: Callable[[str, DataFrame], None] | None = None, by: dict[str, str] | None = None, stale: tuple[str, ...] = (), files: Files | None = None) -> dict[str, int]:
    """Writes each data frame to its path and returns their rows, all or none.

    Parquet, or with ``by`` a folder for each value of a column holding its JSON lines.
    ``expect`` is what a target must hold, ``check`` may raise on the staged rows.
    """
    files = files or Files(spark)
    recover(spark, journal, files)
    run, moves, counts = uuid.uuid4().hex, [], {}
    try:
        for path, df in targets.items():
            staged = f"{path}.staged-{run}"
            moves.append({"staged": staged, "target": path, "backup": f"{path}.old-{run}", "had": files.exists(path)})
            column = (by or {}).get(path)
            if column:
                df.write.partitionBy(column).json(staged)
                rows = spark.read.schema(df.schema).json(staged)
            else:
                df.write.parquet(staged)
                rows = spark.read.parquet(staged)
            counts[path] = rows.count()
            if expect and path in expect and counts[path] != expect[path]:
                raise CommitError(f"{path}: {counts[path]} rows instead of {expect[path]}")
            if check:
                check(path, rows)
        moves += [{"staged": None, "target": p, "backup": f"{p}.old-{run}", "had": True} for p in stale if files.exists(p)]
        files.write(journal, json.dumps(moves))
    except Exception:
        for path in [m["staged"] for m in moves if m["staged"]] + [f"{journal}.part"]:
            files.remove(path)
        raise
    try:
        for m in moves:
            if m["had"]:
                files.rename(m["target"], m["backup"])
            if m["staged"]:
                files.rename(m["staged"], m["target"])
    except Exception:
        _undo(files, moves)
        files.remove(journal)
        raise
    _finish(files, moves, journal)
    return counts
