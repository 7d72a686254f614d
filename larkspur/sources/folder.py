"""Wiki folders as a data source: ``spark.read.format("wiki_folder").load(root)``.

Rows are the files below the root: path, folder, name, extension, size, modified, and raw, the text (null where option
``contents`` is false). Links are refused, files and folders alike, and so is whatever does not resolve to a place below
the root. The driver lists folders only until there are ``parts`` of them; each is a partition that lists and reads its
own subtree. Options ``below`` (folders) and ``extensions``, both comma-separated, narrow the listing: other folders are
never listed, other files never opened. With option ``pushdown`` so do conditions on path (equal, in, begins with), folder
and extension; the session must push filters to Python sources for it (``spark.sql.python.filterPushdown.enabled``). It is
off unless asked for: Spark 4.1 shares what one scan pushed with other scans of the same DataFrame, so use a DataFrame
once where it is on. The root must be a folder that all machines see; texts are UTF-8, with broken bytes replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

SCHEMA = "path string, folder string, name string, extension string, size long, modified timestamp, raw string"
PARTS = 64


@dataclass
class Part(InputPartition):
    """A subtree, or single files of folders that were listed while planning; both relative to the root."""

    folder: str | None
    files: tuple[str, ...] = ()


@dataclass
class Wanted:
    """What the pushed conditions allow; None allows everything."""

    paths: frozenset[str] | None = None
    prefixes: tuple[str, ...] = ()
    roots: tuple[str, ...] = ("",)
    folders: frozenset[str] | None = None
    extensions: frozenset[str] | None = None

    def below(self, folder: str) -> bool:
        """Whether a folder's subtree can hold a wanted file."""
        inside = f"{folder}/" if folder else ""
        may = any(not r or f"{r}/".startswith(inside) or inside.startswith(f"{r}/") for r in self.roots)
        may &= all(p.startswith(inside) or inside.startswith(p) for p in self.prefixes)
        may &= self.paths is None or any(p.startswith(inside) for p in self.paths)
        return may and (self.folders is None or any(f"{f}/".startswith(inside) for f in self.folders))

    def file(self, path: str) -> bool:
        folder, _, name = path.rpartition("/")
        return (
            any(not r or path.startswith(f"{r}/") for r in self.roots) and all(path.startswith(p) for p in self.prefixes) and (self.paths is None or path in self.paths)
            and (self.folders is None or folder in self.folders) and (self.extensions is None or os.path.splitext(name)[1].lower() in self.extensions)
        )


class FolderReader(DataSourceReader):
    def __init__(self, root: str, parts: int, contents: bool, below: tuple[str, ...] = ("",), extensions: frozenset[str] | None = None) -> None:
        self.root, self.parts, self.contents = os.path.realpath(root), parts, contents
        self.wanted = Wanted(roots=below, extensions=extensions)

    def _entries(self, folder: str) -> tuple[list[str], list[str]]:
        """A folder's own folders and files, without links."""
        with os.scandir(os.path.join(self.root, folder)) as found:
            kept = sorted((e for e in found if not e.is_symlink()), key=lambda e: e.name)
        at = f"{folder}/" if folder else ""
        return [at + e.name for e in kept if e.is_dir(follow_symlinks=False)], [at + e.name for e in kept if e.is_file(follow_symlinks=False)]

    def partitions(self) -> list[Part]:
        open_, files = [""], []
        while open_ and len(open_) < self.parts:
            listed = [self._entries(f) for f in open_ if self.wanted.below(f)]
            files += [x for _, own in listed for x in own if self.wanted.file(x)]
            deeper = [f for own, _ in listed for f in own if self.wanted.below(f)]
            if not deeper:
                open_ = []
                break
            open_ = deeper
        step = max(1, -(-len(files) // self.parts))
        own = [Part(None, tuple(files[k : k + step])) for k in range(0, len(files), step)]
        return own + [Part(f) for f in open_ if self.wanted.below(f)]

    def _below(self, folder: str) -> Iterator[str]:
        open_ = [folder]
        while open_:
            folders, files = self._entries(open_.pop())
            yield from (f for f in files if self.wanted.file(f))
            open_ += [f for f in folders if self.wanted.below(f)]

    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is None:  # what a plan without parts asks for
            return
        for path in partition.files if partition.folder is None else self._below(partition.folder):
            whole = os.path.join(self.root, path)
            if os.path.islink(whole) or not os.path.realpath(whole).startswith(self.root.rstrip("/") + "/"):
                continue  # became a link since it was listed
            at = os.stat(whole)
            raw = None
            if self.contents:
                with open(whole, "rb") as f:
                    raw = f.read().decode("utf-8", "replace")
            folder, _, name = path.rpartition("/")
            yield path, folder, name, os.path.splitext(name)[1].lower(), at.st_size, datetime.fromtimestamp(at.st_mtime, UTC).replace(tzinfo=None), raw


class PushingReader(FolderReader):
    """A reader that takes conditions."""

    def pushFilters(self, filters):  # noqa: N802
        """All are left for Spark to apply again; a reader only skips what cannot pass."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            values = frozenset((f.value,)) if isinstance(f, EqualTo) else frozenset(f.value) if isinstance(f, In) else None
            if column == "path" and isinstance(f, StringStartsWith):
                self.wanted.prefixes += (f.value,)
            elif values is not None and column in ("path", "folder", "extension"):
                name = {"path": "paths", "folder": "folders", "extension": "extensions"}[column]
                before = getattr(self.wanted, name)
                setattr(self.wanted, name, values if before is None else before & values)
            yield f


class WikiFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiki_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        root = self.options.get("path")
        if not root or not os.path.isdir(root):
            raise FileNotFoundError(f"no such wiki folder: {root}")
        below = tuple(b.strip("/") for b in self.options.get("below", "").split(","))
        kinds = frozenset(x.lower() for x in self.options.get("extensions", "").split(",") if x)
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else FolderReader
        return kind(root, int(self.options.get("parts", PARTS)), self.options.get("contents", "true").lower() == "true", below, kinds or None)


def files(spark: SparkSession, root: str, contents: bool = True, parts: int = PARTS, below: Sequence[str] = ("",), extensions: Sequence[str] = (), pushdown: bool = False) -> DataFrame:
    """The files below a folder, or below some of its folders, of all extensions or some."""
    spark.dataSource.register(WikiFolder)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("wiki_folder").option("pushdown", str(pushdown).lower()).option("contents", str(contents).lower()).option("parts", parts)
    return read.option("below", ",".join(below)).option("extensions", ",".join(extensions)).load(root)
