"""Sets of tables with one committed pointer, and steps that a rerun skips.

Under a root, every write goes to a folder of its own below ``data/``.  A
commit adds one small JSON file, ``commits/<number>.json``, that names the
folders of all tables of the set.  Readers take the newest commit, so they see
all tables of a load or none of them, and a load that fails leaves the former
tables as they are.  A commit is a rename that fails where the number is taken,
so of two writers on the same base one gets ``Conflict`` and starts again.

Steps of a run keep their results the same way, under a key made from their
inputs: a rerun with the same inputs repeats only what was lost.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logweave.sources.bucketed import exists


class Conflict(RuntimeError):
    """Another writer has committed on the same base."""


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files under a file, folder or pattern, in order of their paths."""
    fs, folder = _fs(spark, path)
    found = []
    for top in fs.globStatus(folder) or []:
        files = fs.listFiles(top.getPath(), True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith((".", "_")):
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def _read_json(spark: SparkSession, path: str) -> dict:
    fs, file = _fs(spark, path)
    stream = fs.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    """The whole file or none; ``Conflict`` where it is there already."""
    jvm = spark._jvm
    fs, file = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    stream.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, file, options)
    except Exception as error:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(error):
            raise Conflict(f"{path} was committed by another writer") from error
        raise


class TableSet:
    """The tables below ``root``.  A table is the rows of one or more folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """Number of the newest commit, 0 without one."""
        path = f"{self.root}/commits"
        if not exists(self.spark, path):
            return 0
        names = [p.rsplit("/", 1)[1] for p, _, _ in _listed(self.spark, path)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def tables(self, version: int | None = None) -> dict[str, list[str]]:
        """Folders of each table, at the newest commit or an older one."""
        number = self.version() if version is None else version
        return _read_json(self.spark, f"{self.root}/commits/{number:012d}.json")["tables"] if number else {}

    def stage(self, df: DataFrame, name: str, partition_by: str | None = None) -> tuple[str, int]:
        """Writes ``df`` to a new folder that no reader sees yet; gives the folder and its rows (counted by the write)."""
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex[:12]}"
        seen = Observation(f"staged_{uuid.uuid4().hex[:8]}")
        writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return path, int(seen.get["n"])

    def commit(self, changes: dict[str, list[str] | None], base: int | None = None) -> int:
        """Sets the folders of the named tables (None takes a table out) on top of commit ``base`` (default:
        the newest); the other tables stay.  Gives the new number."""
        base = self.version() if base is None else base
        tables = self.tables(base) | changes
        value = {"tables": {k: v for k, v in tables.items() if v is not None}}
        _write_json(self.spark, f"{self.root}/commits/{base + 1:012d}.json", value)
        return base + 1

    def append(self, df: DataFrame, name: str) -> int:
        """Adds the rows of ``df`` to a table; gives their number."""
        base = self.version()
        path, n = self.stage(df, name)
        self.commit({name: [*self.tables(base).get(name, []), path]}, base)
        return n

    def read(self, name: str, version: int | None = None) -> DataFrame:
        folders = self.tables(version).get(name)
        if not folders:
            raise KeyError(f"no table {name} under {self.root}")
        first, *others = [self.spark.read.parquet(p) for p in folders]
        for other in others:
            first = first.unionByName(other)
        return first

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the newest ``keep`` commits names, and older commits.  Run it while
        nobody stages tables: those aren't named yet.  Gives the number of folders deleted."""
        newest = self.version()
        held = {p for v in range(max(newest - keep, 0) + 1, newest + 1) for ps in self.tables(v).values() for p in ps}
        fs, data = _fs(self.spark, f"{self.root}/data")
        held = {_fs(self.spark, p)[0].makeQualified(_fs(self.spark, p)[1]).toString() for p in held}
        gone = 0
        for entry in fs.listStatus(data) if fs.exists(data) else []:
            if entry.getPath().toString() not in held:
                gone += bool(fs.delete(entry.getPath(), True))
        for path, _, _ in _listed(self.spark, f"{self.root}/commits"):
            name = path.rsplit("/", 1)[1]
            if name.endswith(".json") and int(name[:-5]) <= newest - keep:
                fs.delete(_fs(self.spark, path)[1], False)
        return gone


def inputs_key(spark: SparkSession, paths: list[str], **settings) -> str:
    """A key of the files under ``paths`` (path, size, time of change) and of settings: another file or
    setting, another key.  A path without files is an error."""
    files = {}
    for path in paths:
        files[path] = _listed(spark, path)
        if not files[path]:
            raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}.")
    return hashlib.sha256(json.dumps([files, settings], sort_keys=True, default=str).encode()).hexdigest()[:16]


class Steps:
    """Results of a run's steps under ``root``/``key``, kept when a step is done."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/{key}"
        self.repeated: list[str] = []

    def step(self, name: str, work: Callable[[str], dict]) -> dict:
        """The result (a JSON object) of ``work(folder)``, which writes below the new folder it is given;
        of an earlier run, if that has finished the step."""
        done = f"{self.folder}/{name}.json"
        if exists(self.spark, done):
            return _read_json(self.spark, done)
        self.repeated.append(name)
        result = work(f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}")
        try:
            _write_json(self.spark, done, result)
        except Conflict:  # another run of the same inputs was first: its result stands
            return _read_json(self.spark, done)
        return result
