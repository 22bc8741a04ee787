"""Sorted runs in levels: a Parquet table bucketed and sorted by key, with a partition for each run, and the commits
that say which of them count.

A delta is written as a run of level 0.  When a level holds FAN runs, they are merged into one run of the next
level, so that there are at most FAN runs a level and a row is rewritten once a level.  All runs have the same
buckets: a delta is shuffled once by its key, and the runs are read in their buckets, without a shuffle, be it to
merge, to anti-join or to add up.  (One scan reads the bucket's files of all runs.  A union of scans wouldn't do:
over columnar scans its rows aren't placed as the planner takes it to place them.)

Each change is one commit, a JSON file beside the runs that holds the number of buckets, the runs and the names of
the deltas that are in.  It is written under another name and renamed, which fails if another writer was first.  So
whoever opens the folder, in whatever session, reads all of its rows: the buckets are the commit's, not the
session's.  A run without a commit (a task or driver was lost) is not read.  A delta whose name is in is not added
again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.sources.shared import discard

FAN = 4


class SortedRuns:
    """Rows (``keys`` and the columns of ``merge``) under ``path``; rows of one key are merged column by column.

    ``schema`` is DDL by column; ``buckets`` holds for a new folder only, one that is there keeps its own; ``name`` begins
    the runs' names in the session's catalogue.
    """

    def __init__(self, spark: SparkSession, path: str, schema: dict[str, str], keys: list[str], merge: dict[str, Callable[[str], Column]], buckets: int, name: str = "sorted_run"):
        self.spark, self.path, self.schema, self.keys, self.merge, self.name = spark, path.rstrip("/"), schema, keys, merge, name
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = self._latest() or {"version": 0, "columns": schema, "keys": keys, "buckets": buckets, "runs": [], "deltas": []}
        if self.state["columns"] != schema or self.state["keys"] != keys:
            raise ValueError(f"{path} holds {self.state['columns']} by {self.state['keys']}, not {schema} by {keys}")

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    def _latest(self) -> dict | None:
        """What the last commit says."""
        folder = self._at(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return None
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(folder))
        done = [n for n in names if n.endswith(".json")]
        if not done:
            return None
        stream = self._fs.open(self._at(f"{self.path}/_commits/{done[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, **changed) -> None:
        state = self.state | changed | {"version": self.state["version"] + 1}
        folder = f"{self.path}/_commits"
        draft, final = self._at(f"{folder}/.{uuid.uuid4().hex}"), self._at(f"{folder}/{state['version']:012d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(json.dumps(state).encode())
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer has committed version {state['version']} of {self.path}; open it again")
        self.state = state

    def _table(self) -> str:
        """The table's name in the session's catalogue, made known anew: with the buckets of the commit and the runs that are there."""
        name, by = f"{self.name}_{hashlib.md5(self.path.encode()).hexdigest()}", ", ".join(self.keys)
        columns = ", ".join(f"{c} {t}" for c, t in self.schema.items())
        self._fs.mkdirs(self._at(self.path))
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # of an external table; the files stay
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}, run STRING) USING parquet PARTITIONED BY (run) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return name

    def _write(self, rows: DataFrame) -> str:
        run = uuid.uuid4().hex
        name = self._table()
        placed = rows.select(*self.schema, F.lit(run).alias("run")).repartition(self.buckets, *self.keys)
        writer = placed.write.format("parquet").mode("append").partitionBy("run").option("path", self.path)
        writer.bucketBy(self.buckets, self.keys[0], *self.keys[1:]).sortBy(self.keys[0], *self.keys[1:]).saveAsTable(name)
        return run

    def rows(self, runs: list[str] | None = None) -> DataFrame:
        """The rows of some runs, or of all, in their buckets."""
        runs = [run for _, run in self.state["runs"]] if runs is None else runs
        return self.spark.table(self._table()).where(F.col("run").isin(runs)).select(*self.schema)

    def read(self, runs: list[str] | None = None) -> DataFrame:
        """One row for each key: the runs' rows merged in their buckets."""
        return self.rows(runs).groupBy(*self.keys).agg(*[f(c).alias(c) for c, f in self.merge.items()])

    def unseen(self, delta: DataFrame) -> DataFrame:
        """The rows of ``delta`` whose key no run holds: one merge with each run, of which there are few."""
        for _, run in self.state["runs"]:
            delta = delta.join(self.rows([run]).select(*self.keys).hint("merge"), self.keys, "left_anti")
        return delta

    def holds(self, delta: str) -> bool:
        return delta in self.state["deltas"]

    def add(self, rows: DataFrame, delta: str) -> None:
        """``rows`` as a run, unless a delta of that name is in; then levels that are full are merged."""
        if self.holds(delta):
            return
        self._commit(runs=[*self.state["runs"], [0, self._write(rows)]], deltas=[*self.state["deltas"], delta])
        level = 0
        while len(full := [run for at, run in self.state["runs"] if at == level]) >= FAN:
            merged = self._write(self.read(full))
            self._commit(runs=[*[x for x in self.state["runs"] if x[1] not in full], [level + 1, merged]])
            for run in full:
                discard(self.spark, f"{self.path}/run={run}")
            level += 1

    def drop(self) -> None:
        """Forget the table and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table()}")
        discard(self.spark, self.path)
        self.state = self.state | {"runs": [], "deltas": []}
