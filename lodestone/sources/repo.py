"""A file tree as a table: ``path``, ``content``, ``is_symlink``.

A Python data source, as the built-in file sources skip hidden and empty files
and follow links.  Folders are listed one level at a time when the read is
planned, until there are enough of them; each task walks a few folders and reads
their files.  Ignored folders are not entered and links not followed: a link is a
row with null content, and so is a file that cannot be read.

A scan may begin at a folder or file below the root (``base``), and leave
contents out (``contents=False``), so that a question about one path or about
names alone reads no more than that.  :func:`write_tree` is the way back.  Conditions on ``path`` (equality, ``IN``, what it
begins or ends with or contains) are pushed into the source: a plain ``where``
enters no folder and opens no file that they leave out.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestone.functions.paths import IGNORED_DIRS
from lodestone.functions.text import decoded

SCHEMA = "path string, content binary, is_symlink boolean"
CHUNK_SCHEMA = "path string, part int, content string, is_symlink boolean"
#: Folders that are listed when a read is planned; deeper ones are listed in tasks.
ENOUGH_FOLDERS = 64


class _Folder(InputPartition):
    """A folder to read, with all below it or alone."""

    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


def _entries(folder: str) -> tuple[list[os.DirEntry], list[os.DirEntry]]:
    """Folders to enter and other entries, by name."""
    try:
        with os.scandir(folder) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError:
        return [], []
    below = [e for e in entries if e.is_dir(follow_symlinks=False) and e.name not in IGNORED_DIRS]
    return below, [e for e in entries if not e.is_dir(follow_symlinks=False) and e.name not in IGNORED_DIRS]


@dataclass
class _Paths:
    """What pushed conditions say about paths: those wanted (None: any), and texts that they begin with, end with or contain."""

    wanted: frozenset[str] | None = None
    starts: list[str] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)

    def takes(self, condition: Filter) -> bool:
        """Adds a condition, if it is one of these."""
        if getattr(condition, "attribute", None) != ("path",):
            return False
        if isinstance(condition, (EqualTo, In)):
            values = {condition.value} if isinstance(condition, EqualTo) else set(condition.value)
            # A comparison with null is never true.
            values = frozenset(v for v in values if v is not None)
            self.wanted = values if self.wanted is None else self.wanted & values
            return True
        for kind, texts in ((StringStartsWith, self.starts), (StringEndsWith, self.ends), (StringContains, self.parts)):
            if isinstance(condition, kind):
                texts.append(condition.value)
                return True
        return False

    def keep(self, path: str) -> bool:
        return (self.wanted is None or path in self.wanted) and all(map(path.startswith, self.starts)) and all(map(path.endswith, self.ends)) and all(t in path for t in self.parts)

    def enter(self, folder: str) -> bool:
        """Whether a path below a folder can be kept; the root is ``.``."""
        below = "" if folder == "." else folder + "/"
        return (self.wanted is None or any(p.startswith(below) for p in self.wanted)) and all(s.startswith(below) or below.startswith(s) for s in self.starts)


class _Reader(DataSourceReader):
    def __init__(self, root: str, base: str, contents: bool) -> None:
        self.root, self.start, self.contents = root, os.path.normpath(os.path.join(root, base)), contents
        self.paths = _Paths()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on paths; the others are left to Spark."""
        for condition in filters:
            if not self.paths.takes(condition):
                yield condition

    def _name(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")

    def _below(self, folder: str) -> list[str]:
        """The folders in a folder that can hold a path that is kept."""
        return [e.path for e in _entries(folder)[0] if self.paths.enter(self._name(e.path))]

    def partitions(self) -> list[_Folder]:
        if not os.path.isdir(self.start) or os.path.islink(self.start):
            return [_Folder(self.start, False)]
        shallow, level = [], [self.start]
        while level and len(shallow) + len(level) < ENOUGH_FOLDERS:
            shallow += level
            level = [below for folder in level for below in self._below(folder)]
        return [_Folder(p, False) for p in shallow] + [_Folder(p, True) for p in level]

    def _row(self, path: str) -> Iterator[tuple]:
        name = self._name(path)
        if not self.paths.keep(name):
            return
        if os.path.islink(path):
            yield name, None, True
        elif os.path.isfile(path):
            content = None
            if self.contents:
                with contextlib.suppress(OSError), open(path, "rb") as file:
                    content = file.read()
            yield name, content, False

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if not os.path.isdir(partition.path) or os.path.islink(partition.path):
            yield from self._row(partition.path)
            return
        todo = [partition.path]
        while todo:
            folder = todo.pop()
            if partition.deep:
                todo += self._below(folder)
            for entry in _entries(folder)[1]:
                yield from self._row(entry.path)


class _ChunkReader(_Reader):
    """Texts in parts of so many characters; a task holds one part."""

    def __init__(self, root: str, base: str, chars: int) -> None:
        super().__init__(root, base, True)
        self.chars = chars

    def _row(self, path: str) -> Iterator[tuple]:
        name = self._name(path)
        if not self.paths.keep(name):
            return
        if os.path.islink(path):
            yield name, 0, None, True
        elif os.path.isfile(path):
            part = 0
            try:
                # Decodes and translates line ends across the cuts.
                with open(path, encoding="utf-8", errors="replace") as file:
                    while text := file.read(self.chars):
                        yield name, part, text, False
                        part += 1
                if not part:
                    yield name, 0, "", False
            except OSError:
                if not part:
                    yield name, 0, None, False


@dataclass
class _Staged(WriterCommitMessage):
    """The folder that an attempt of a task has filled."""

    folder: str


def _checked_target(path: str | None) -> list[str]:
    """The components of a path that a tree can hold."""
    steps = (path or "").split("/")
    if any(s in ("", ".", "..") or "\0" in s for s in steps):
        raise ValueError(f"Not a path within a tree: {path!r}")
    return steps


class _Writer(DataSourceWriter):
    """Writes a new tree: tasks fill folders of their own beside it, and the tree appears as a whole or not at all."""

    def __init__(self, root: str, columns: list[str]) -> None:
        self.root, self.columns = os.path.abspath(root), columns
        if not {"path", "content"} <= set(columns):
            raise ValueError("A file tree is written from path and content.")
        if os.path.lexists(self.root):
            raise ValueError(f"A file tree is written to a new place; this one is taken: {self.root}")
        self.staging = f"{self.root}.staging-{uuid.uuid4().hex}"
        # Tasks fill folders in this one and do not make it: one that runs on after the end has no place any more.
        os.makedirs(self.staging)

    def write(self, iterator: Iterator[Row]) -> _Staged:
        folder = os.path.join(self.staging, f"attempt-{TaskContext.get().taskAttemptId()}")
        os.mkdir(folder)
        path_at, content_at = self.columns.index("path"), self.columns.index("content")
        for row in iterator:
            steps, content = _checked_target(row[path_at]), row[content_at]
            if content is None:
                raise ValueError(f"A file without content cannot be written: {row[path_at]}")
            for i in range(1, len(steps)):
                with contextlib.suppress(FileExistsError):
                    os.mkdir(os.path.join(folder, *steps[:i]))
            # A path that comes twice fails here, or when the tree is put together.
            with open(os.path.join(folder, *steps), "xb") as file:
                file.write(content.encode() if isinstance(content, str) else content)
        return _Staged(folder)

    def commit(self, messages: list[_Staged | None]) -> None:
        tree = os.path.join(self.staging, "tree")
        os.makedirs(tree)
        try:
            for staged in filter(None, messages):
                self._move(staged.folder, tree)
            os.makedirs(os.path.dirname(self.root), exist_ok=True)
            os.rename(tree, self.root)
        finally:
            self.abort(messages)

    def _move(self, folder: str, into: str) -> None:
        """Whole folders where the tree has none of that name yet, else what is in them."""
        for entry in os.scandir(folder):
            target = os.path.join(into, entry.name)
            if not os.path.lexists(target):
                os.rename(entry.path, target)
            elif entry.is_dir(follow_symlinks=False) and os.path.isdir(target):
                self._move(entry.path, target)
            else:
                raise ValueError(f"Two files have this path: {os.path.relpath(target, os.path.join(self.staging, 'tree'))}")

    def abort(self, messages: list[_Staged | None]) -> None:
        """Removes what tasks have written; renamed first, so that those that still run find no place."""
        gone = f"{self.staging}.gone"
        with contextlib.suppress(OSError):
            os.rename(self.staging, gone)
        for _ in range(50):
            shutil.rmtree(gone, ignore_errors=True)
            if not os.path.lexists(gone):
                return
            time.sleep(0.1)


class RepoFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return CHUNK_SCHEMA if int(self.options.get("chunk_chars", "0")) else SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.names)

    def reader(self, schema) -> DataSourceReader:
        chunk_chars = int(self.options.get("chunk_chars", "0"))
        if chunk_chars:
            return _ChunkReader(self.options["path"], self.options.get("base", "."), chunk_chars)
        return _Reader(self.options["path"], self.options.get("base", "."), self.options.get("contents", "true") == "true")


def checked_root(root: str) -> str:
    resolved = os.path.realpath(root)
    if not os.path.isdir(resolved):
        raise ValueError(f"Repository path does not exist or is not a directory: {resolved}")
    return resolved


def scan_entries(spark: SparkSession, root: str, base: str = ".", contents: bool = True) -> DataFrame:
    """All rows of the source at or below ``base``, links included, with contents as text."""
    spark.dataSource.register(RepoFiles)
    # Off by default, and needed by a source that takes conditions.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("repo_files").option("base", base).option("contents", str(contents).lower())
    return reader.load(checked_root(root)).withColumn("content", decoded(F.col("content")))


def scan_chunks(spark: SparkSession, root: str, chars: int, base: str = ".") -> DataFrame:
    """(path, part, content) of the regular files, each in parts of ``chars`` characters."""
    if chars < 1:
        raise ValueError("A part has one character or more.")
    spark.dataSource.register(RepoFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("repo_files").option("base", base).option("chunk_chars", str(chars)).load(checked_root(root))
    return rows.where(~F.col("is_symlink")).select("path", "part", "content")


def write_tree(files: DataFrame, root: str) -> None:
    """Writes files (path, content) as a new tree at ``root``, a folder that driver and executors share.

    The tree appears when all files are written; a failing task, a path that comes
    twice or leads out of the tree, and a file without content leave nothing.
    """
    files.sparkSession.dataSource.register(RepoFiles)
    files.select("path", "content").write.format("repo_files").mode("append").save(root)


def scan_repo(spark: SparkSession, root: str, skip: Column | None = None) -> DataFrame:
    """(path, content) of the regular files; ``skip`` is a condition on ``path`` that leaves files out."""
    rows = scan_entries(spark, root).where(~F.col("is_symlink"))
    return (rows if skip is None else rows.where(~skip)).select("path", "content")


def links_on(root: str, path: str) -> list[str]:
    """The links, relative to the root, that a walk along the components of one path stands on."""
    if os.path.isabs(path):
        if path != root and not path.startswith(root.rstrip("/") + "/"):
            return []
        path = path[len(root) :]
    at: list[str] = []
    found = []
    for part in path.split("/"):
        if part == "..":
            at = at[:-1]
        elif part not in ("", "."):
            at.append(part)
            if os.path.islink(os.path.join(root, *at)):
                found.append("/".join(at))
    return found
