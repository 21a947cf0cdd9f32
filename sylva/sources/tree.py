"""A directory tree as a table: its names are listed by executors in rounds, its files read by a Python data source.

Spark's own file sources hide names that begin with _ or . and do not show empty folders; this one lists everything. The
driver lists nothing. A round's folders are shared out anew, and each task goes on below its own until it has told enough
names; the folders it did not come to are the next round's. The names found are one table, cut into ranges of paths, so
that a folder of many files is many tasks; the source 'fs_tree' (options listing, path, max_file_mb) has one partition for
each range. It takes filters on kind, path, name and size, and opens no file unless content is among its columns.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.lineage import cut, discard, measured

COLUMNS = ("kind", "rel_path", "parent_path", "name", "size_bytes", "content", "error")
SCHEMA = "kind string, rel_path string, parent_path string, name string, size_bytes long, content string, error string"
READ = (".py", ".js", ".ts", ".java", ".go", ".c", ".cpp", ".rb", ".php")
#: Names that a listing task tells before it gives back the folders left, folders that it is given, and names a reading task has.
BUDGET, GIVEN, NAMES = 10_000, 256, 5_000
#: Reading tasks of a tree that has names enough for them, so that a few large files are not one task's.
SPREAD, LEAST = 64, 4
LISTED = "kind string, rel_path string, error string, todo boolean"


def _entries(root: str, rel: str, ignored: Callable[[str], bool]) -> Iterator[tuple]:
    """(kind, path, error, whether to walk) of what a folder holds; a link to a folder is told of but not walked."""
    try:
        with os.scandir(os.path.join(root, rel)) as found:
            for e in found:
                if ignored(e.name):
                    continue
                path = e.name if rel == "." else f"{rel}/{e.name}"
                folder = e.is_dir()
                yield ("folder" if folder else "file", path, None, folder and not e.is_symlink())
    except OSError as x:
        yield ("error", rel, str(x), False)


def _walk(batches: Iterable[pa.RecordBatch], root: str, ignore: list[str], budget: int) -> Iterator[pa.RecordBatch]:
    """What lies in the given folders and, until budget names are told, below them; todo marks folders left for others."""
    names = ("kind", "rel_path", "error", "todo")
    fits = re.compile("|".join(map(fnmatch.translate, ignore)))
    ignored = lambda n: bool(ignore) and fits.match(n) is not None
    told = 0
    for batch in batches:
        given = [(rel, True) for rel in batch.column(0).to_pylist()]
        out = []
        while given:
            rel, must = given.pop()
            if not must and told >= budget:
                out.append(("todo", rel, None, True))
            else:
                for kind, path, error, folder in _entries(root, rel, ignored):
                    told += 1
                    out.append((kind, path, error, False))
                    if folder:
                        given.append((path, False))
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.bool_()))], names)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.bool_()))], names)


def list_tree(spark: SparkSession, root: str, ignore: Iterable[str] = (), budget: int = BUDGET, given: int = GIVEN) -> DataFrame:
    """(kind: folder, file or error, rel_path, error) of all below root and of root itself ('.'), as a written table.

    A folder that cannot be listed is a row of its own, of kind error, beside the one that tells of it.
    """
    own = partial(_walk, root=os.path.abspath(root), ignore=list(ignore), budget=budget)
    front = spark.createDataFrame([(".",)], "rel_path string")
    rounds, left, names = [], 1, 1
    while left:
        spread = front.repartition(max(1, min(left, max(spark.sparkContext.defaultParallelism, left // given))))
        seen, counts = measured(spread.mapInArrow(own, LISTED), todo=F.count_if("todo"), told=F.count_if(~F.col("todo")))
        rounds.append(seen)
        front, left, names = seen.where("todo").select("rel_path"), counts["todo"], names + counts["told"]
    whole = spark.createDataFrame([("folder", ".", None)], "kind string, rel_path string, error string")
    for seen in rounds:
        whole = whole.union(seen.where("not todo").select("kind", "rel_path", "error"))
    out = cut(whole.repartitionByRange(max(-(-names // NAMES), min(SPREAD, -(-names // LEAST))), "rel_path"))
    discard(*rounds)
    return out


class _Part(InputPartition):
    """The file of a range of the listing."""


#: Filters that the source applies itself, as tests of a value that is not null.
TESTS: dict[type, Callable] = {
    D.EqualTo: lambda v, x: v == x,
    D.In: lambda v, x: v in x,
    D.GreaterThan: lambda v, x: v > x,
    D.GreaterThanOrEqual: lambda v, x: v >= x,
    D.LessThan: lambda v, x: v < x,
    D.LessThanOrEqual: lambda v, x: v <= x,
    D.StringStartsWith: lambda v, x: v.startswith(x),
    D.StringEndsWith: lambda v, x: v.endswith(x),
    D.StringContains: lambda v, x: x in v,
}
#: The columns that are known of a name, and those that its size adds; order among texts is left to Spark.
NAMED, SIZED = ("kind", "rel_path", "parent_path", "name"), ("size_bytes",)
ORDERED = (D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: Iterable[str] = COLUMNS):
        self.root = os.path.abspath(options["path"])
        self.listing = options.get("listing", "")
        self.most = float(options.get("max_file_mb", "5")) * 1048576
        self.columns = list(columns)
        self.pushed: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if isinstance(f, D.IsNotNull) and column in NAMED + SIZED:
                self.pushed.append((column, D.IsNotNull, None))
            elif type(f) in TESTS and column in (SIZED if type(f) in ORDERED else NAMED + SIZED):
                self.pushed.append((column, type(f), f.value))
            else:
                yield f

    def _passes(self, row: dict, columns: tuple[str, ...]) -> bool:
        return all(row[c] is not None and (kind is D.IsNotNull or TESTS[kind](row[c], x)) for c, kind, x in self.pushed if c in columns)

    def partitions(self) -> list[InputPartition]:
        system, folder = pafs.FileSystem.from_uri(self.listing)
        found = system.get_file_info(pafs.FileSelector(folder))
        return [_Part(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".parquet")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = pafs.FileSystem.from_uri(self.listing)
        with system.open_input_file(partition.value) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["kind", "rel_path", "error"]):
                for listed in batch.to_pylist():
                    if row := self._row(**listed):
                        yield tuple(row[c] for c in self.columns)

    def _row(self, kind: str, rel_path: str, error: str | None) -> dict | None:
        root = rel_path == "."
        row = dict.fromkeys(COLUMNS) | {
            "kind": kind, "rel_path": rel_path, "error": error, "name": os.path.basename(self.root if root else rel_path),
            "parent_path": None if root and kind == "folder" else os.path.dirname(rel_path) or ".",
        }
        if not self._passes(row, NAMED):
            return None
        if kind == "file" and {"size_bytes", "content", "error"} & {*self.columns, *[c for c, *_ in self.pushed]}:
            self._measure(row, os.path.join(self.root, rel_path))
        if not self._passes(row, SIZED):
            return None
        if kind == "file" and row["error"] is None and "content" in self.columns:
            self._open(row, os.path.join(self.root, rel_path))
        return row

    def _measure(self, row: dict, full: str) -> None:
        try:
            row["size_bytes"] = os.stat(full).st_size
        except OSError as e:
            row["size_bytes"], row["error"] = 0, str(e)

    def _open(self, row: dict, full: str) -> None:
        if row["size_bytes"] > self.most or os.path.splitext(row["name"])[1].lower() not in READ:
            return
        try:
            with open(full, encoding="utf-8", errors="ignore") as f:
                row["content"] = f.read()
        except OSError as e:
            row["error"] = str(e)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fs_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options), schema.names)


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), max_file_mb: float = 5.0, columns: Iterable[str] = COLUMNS) -> DataFrame:
    """The named columns of all below root: without content no file is opened, without size and error none is looked at.

    An error in reading a file is told only where content is asked for. Content is the text of sources in READ up to
    max_file_mb. The tree, the listing and the tasks need a folder that driver and executors share.
    """
    from pyspark import cloudpickle

    import sylva.sources.tree as own

    cloudpickle.register_pickle_by_value(own)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    listing = os.path.dirname(list_tree(spark, root, ignore).inputFiles()[0])
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    options = {"path": os.path.abspath(root), "listing": listing, "max_file_mb": str(max_file_mb)}
    return spark.read.format("fs_tree").schema(schema).options(**options).load()
