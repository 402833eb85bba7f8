"""A streaming source of file changes: created, modified and deleted files of a tree.

    spark.dataSource.register(TreeChanges)
    spark.readStream.format("tree_changes").option("path", tree).option("log", folder).load()

An offset is the number of a listing.  A batch lists the tree, compares it with the
listing before, and gives the difference.  The driver looks at the upper folders only;
every folder below is listed, compared and written to the log by a task, as one small
Parquet file that is put only once.  A batch that is run again reads the listing that it
wrote the first time, so it gives the same rows, and nothing is lost between two batches.
A listing is deleted from the log when the batch after it is committed.

Options: ``path`` (a local or mounted folder, or any address that pyarrow's file systems
open), ``log`` (a shared folder that belongs to one query, like its checkpoint), ``glob``
(names, comma-separated; ``*.xml,*.bsl,*.mdo``), ``depth`` (levels of folders that the
driver looks at; 2), ``partitions`` (tasks of a batch at most; 64).
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, change_type string, modified timestamp, size long"
_FILES = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("size", pa.int64())])


def _open(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(address))


class TreeChanges(DataSource):
    """Format ``tree_changes``."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


class Shard(InputPartition):
    """Folders that one task lists: (folder, whether with all that lies below)."""

    def __init__(self, folders: list[tuple[str, bool]], before: int, after: int):
        self.folders, self.before, self.after = folders, before, after


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.log = options["path"], options["log"]
        self.globs = options.get("glob", "*.xml,*.bsl,*.mdo").split(",")
        self.depth, self.most = int(options.get("depth", "2")), int(options.get("partitions", "64"))
        self.last = 0

    # --- offsets -------------------------------------------------------------

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """Another listing than the last one that a batch was planned for: every trigger looks again."""
        fs, log = _open(self.log)
        fs.create_dir(log)
        known = [int(f.base_name) for f in fs.get_file_info(pafs.FileSelector(log)) if f.base_name.isdigit()]
        return {"listing": max([self.last, *known]) + 1}

    def commit(self, end: dict) -> None:
        """The listings before ``end`` are not needed any more."""
        self.last = max(self.last, end["listing"])
        fs, log = _open(self.log)
        for f in fs.get_file_info(pafs.FileSelector(log, allow_not_found=True)):
            if f.base_name.isdigit() and int(f.base_name) < end["listing"]:
                with suppress(FileNotFoundError):
                    fs.delete_dir(f.path)

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        self.last = max(self.last, end["listing"])
        fs, log = _open(self.log)
        there = f"{log}/{end['listing']}"
        if fs.get_file_info(f"{there}/folders").type != pafs.FileType.File:  # a batch that is run again keeps its folders
            fs.create_dir(there)
            found = sorted(self._folders())
            _put(fs, f"{there}/folders", pa.table({"folder": [f for f, _ in found], "deep": [d for _, d in found]}))
        now = self._told(end["listing"])
        gone = [x for x in self._told(start["listing"]) if x not in set(now)]
        folders = [*now, *gone]
        width = -(-len(folders) // self.most) or 1
        return [Shard(folders[k : k + width], start["listing"], end["listing"]) for k in range(0, len(folders), width)]

    def _folders(self) -> Iterator[tuple[str, bool]]:
        """The folders above ``depth`` by themselves, those at ``depth`` with all below."""
        fs, root = _open(self.path)
        level = [root]
        for _ in range(self.depth):
            yield from ((f, False) for f in level)
            level = [f.path for folder in level for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.type == pafs.FileType.Directory]
        yield from ((f, True) for f in level)

    def _told(self, listing: int) -> list[tuple[str, bool]]:
        fs, log = _open(self.log)
        got = _get(fs, f"{log}/{listing}/folders")
        return [] if got is None else list(zip(got["folder"].to_pylist(), got["deep"].to_pylist(), strict=True))

    # --- in tasks ------------------------------------------------------------

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        tree, _ = _open(self.path)
        fs, log = _open(self.log)
        for folder, deep in partition.folders:
            name = hashlib.sha256(f"{folder}\0{deep}".encode()).hexdigest() + ".parquet"
            after = f"{log}/{partition.after}/{name}"
            now = _get(fs, after)
            if now is None:
                now = _put(fs, after, self._listed(tree, folder, deep))
            old = _get(fs, f"{log}/{partition.before}/{name}")
            yield _difference(now, old if old is not None else _FILES.empty_table())

    def _listed(self, tree: pafs.FileSystem, folder: str, deep: bool) -> pa.Table:
        found = tree.get_file_info(pafs.FileSelector(folder, recursive=deep, allow_not_found=True))
        kept = [f for f in found if f.type == pafs.FileType.File and any(fnmatch.fnmatchcase(f.base_name, g) for g in self.globs)]
        return pa.table([[f.path for f in kept], [f.mtime_ns // 1000 for f in kept], [f.size for f in kept]], schema=_FILES)


def _difference(now: pa.Table, old: pa.Table) -> pa.RecordBatch:
    a = {p: x for p, *x in zip(*(c.to_pylist() for c in now.columns), strict=True)}
    b = {p: x for p, *x in zip(*(c.to_pylist() for c in old.columns), strict=True)}
    rows = [(p, "created" if p not in b else "modified", *x) for p, x in a.items() if b.get(p) != x] + [(p, "deleted", *x) for p, x in b.items() if p not in a]
    columns = list(zip(*sorted(rows), strict=True)) or [(), (), (), ()]
    kinds = [pa.string(), pa.string(), pa.timestamp("us", tz="UTC"), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "change_type", "modified", "size"])


def _get(fs: pafs.FileSystem, path: str) -> pa.Table | None:
    try:
        with fs.open_input_file(path) as f:
            return pq.read_table(f)
    except FileNotFoundError:
        return None


def _put(fs: pafs.FileSystem, path: str, table: pa.Table) -> pa.Table:
    """``table`` as the file at ``path``, or what another task has put there before."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(fresh) as out:
        pq.write_table(table, out)
    if isinstance(fs, pafs.LocalFileSystem):
        with suppress(FileExistsError):
            os.link(fresh, path)
        fs.delete_file(fresh)
    elif fs.get_file_info(path).type == pafs.FileType.NotFound:
        fs.move(fresh, path)
    else:
        fs.delete_file(fresh)
    got = _get(fs, path)
    return table if got is None else got
