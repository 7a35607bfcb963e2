"""A directory tree as a Spark source: directories that rules shut out are never listed.

Driver and executors must see the folders under the same names (a mounted share). Planning lists the first `levels` levels and makes each directory that lies
there a partition; its task walks what is below. A directory is walked under one name only: a link to a directory inside the roots is left
out, one that leads outside is followed unless it leads back to a directory that it lies in. An unreadable root is an error; another
unreadable directory is a row with the error.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, root string, size long, modified double, error string"


@dataclass
class Rules:
    """excluded: names of directories that are shut wherever they lie. blocked, allowed: patterns of whole paths (`*` meets `/` too); a blocked directory is
    entered only if an allowed one may lie inside. suffixes: of wanted files, in lower case; none for all."""

    excluded: tuple[str, ...] = ()
    blocked: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()

    def shut(self, path: str) -> bool:
        """Whether the rules block a path that no rule allows again."""
        inside = lambda patterns: any(fnmatch.fnmatchcase(path, p) or fnmatch.fnmatchcase(path, p.rstrip("/") + "/*") for p in patterns)
        return inside(self.blocked) and not inside(self.allowed)

    def enters(self, path: str) -> bool:
        if os.path.basename(path) in self.excluded:
            return False
        return not self.shut(path) or any(p.startswith(path.rstrip("/") + "/") for p in self.allowed)

    def takes(self, path: str) -> bool:
        return (not self.suffixes or os.path.splitext(path)[1].lower() in self.suffixes) and not self.shut(path)


Row = tuple[str, str, int | None, float | None, str | None]


def listed(folder: str, root: str, roots: list[str], above: frozenset, rules: Rules, listing: Callable = os.scandir) -> tuple[list[Row], list[tuple[str, frozenset]]]:
    """Rows of a directory's files, and the directories to walk with what lies above each (device and inode)."""
    rows: list[Row] = []
    below: list[tuple[str, frozenset]] = []
    with listing(folder) as entries:
        for e in sorted(entries, key=lambda e: e.name):
            try:
                if e.is_dir():
                    real = os.path.realpath(e.path) if e.is_symlink() else None
                    known = real is not None and any(os.path.commonpath([real, r]) == r for r in roots)
                    stat = e.stat()
                    if not known and (stat.st_dev, stat.st_ino) not in above and rules.enters(e.path):
                        below.append((e.path, above | {(stat.st_dev, stat.st_ino)}))
                elif rules.takes(e.path) and e.is_file():
                    stat = e.stat()
                    rows.append((e.path, root, stat.st_size, stat.st_mtime, None))
            except OSError as error:  # gone, or not to be read
                rows.append((e.path, root, None, None, str(error)))
    return rows, below


def walk(folder: str, root: str, roots: list[str], above: frozenset, rules: Rules, levels: int | None = None, listing: Callable = os.scandir) -> Iterator[Row | tuple[str, frozenset]]:
    """Rows of the files in folder and below it; with `levels`, pairs (directory, above) stand for what lies deeper."""
    open_ = [(folder, above, 0)]
    while open_:
        at, over, depth = open_.pop()
        if depth == levels:
            yield at, over
            continue
        try:
            rows, below = listed(at, root, roots, over, rules, listing)
        except OSError as error:
            yield at, root, None, None, str(error)
            continue
        yield from rows
        open_ += [(d, o, depth + 1) for d, o in reversed(below)]


class _Part(InputPartition):
    def __init__(self, root: str, folder: str | None, above: frozenset, rows: list[Row]) -> None:
        self.root, self.folder, self.above, self.rows = root, folder, above, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        cut = lambda name: tuple(x for x in options.get(name, "").split("\n") if x)
        self.roots = [os.path.realpath(r) for r in cut("roots")]
        self.rules = Rules(*(cut(k) for k in ("excluded", "blocked", "allowed", "suffixes")))
        self.levels = int(options.get("levels", "1"))

    def partitions(self) -> list[_Part]:
        parts = []
        for root in self.roots:
            stat = os.stat(root)
            os.scandir(root).close()  # an unreadable root is an error
            rows = []
            for x in walk(root, root, self.roots, frozenset({(stat.st_dev, stat.st_ino)}), self.rules, self.levels):
                if len(x) == 2:
                    parts.append(_Part(root, *x, []))
                else:
                    rows.append(x)
            parts.append(_Part(root, None, frozenset(), rows))
        return parts

    def read(self, part: _Part) -> Iterator[Row]:
        yield from part.rows
        if part.folder is not None:
            yield from walk(part.folder, part.root, self.roots, part.above, self.rules)


class TreeSource(DataSource):
    """format("tree") with the options roots, excluded, blocked, allowed, suffixes (a line each) and levels."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def tree(spark: SparkSession, roots: list[str], rules: Rules | None = None, levels: int = 1) -> DataFrame:
    """(path, root, size, modified, error) of all wanted files under the roots."""
    rules = rules or Rules()
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("levels", str(levels)).option("roots", "\n".join(roots))
    for name in ("excluded", "blocked", "allowed", "suffixes"):
        reader = reader.option(name, "\n".join(getattr(rules, name)))
    return reader.load()
