"""Change logs: rows with the version that wrote them, as plain Parquet in a folder per version.

A log has the columns id, version and deleted besides the data. What is seen at a version, what changed between
two, and whether a change set meets later changes are all DataFrame questions about it. A version counts
once Spark has marked its folder as complete.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """A commit that meets rows written after the version its transaction read; may be tried again."""


class Closed(RuntimeError):
    """A write through a reading transaction, or any use of one that has ended."""


def visible(log: DataFrame, version: int | None = None, id_col: str = "id") -> DataFrame:
    """Each id's newest row up to a version, without those whose newest row is a deletion.

    log has columns version and deleted besides the data; the newest row is taken by a maximum with
    partial aggregation, so no window sorts an id's history.
    """
    rows = log if version is None else log.where(F.col("version") <= version)
    data = [c for c in rows.columns if c not in (id_col, "version", "deleted")]
    newest = rows.groupBy(id_col).agg(F.max_by(F.struct("version", "deleted", *data), F.col("version")).alias("r"))
    return newest.where("not r.deleted").select(id_col, "r.version", *[f"r.{c}" for c in data])


def changes(log: DataFrame, low: int, high: int, id_col: str = "id") -> DataFrame:
    """(id, change): ids inserted, updated or deleted between two versions."""
    a, b = visible(log, low, id_col).select(id_col, F.col("version").alias("v0")), visible(log, high, id_col).select(id_col, F.col("version").alias("v1"))
    both = a.join(b, id_col, "full")
    change = F.when(F.col("v0").isNull(), "insert").when(F.col("v1").isNull(), "delete").when(F.col("v0") != F.col("v1"), "update")
    return both.select(id_col, change.alias("change")).where("change is not null")


def conflicts(log: DataFrame, read_version: int, ids: DataFrame | None = None, where: Column | None = None, id_col: str = "id") -> DataFrame:
    """Ids written after read_version, deletions too, that a transaction wrote or read: those in `ids`, or those whose
    row before or after meets the condition `where` (a key, a range of keys, or true for a whole class)."""
    later = log.where(F.col("version") > read_version)
    met = None
    if ids is not None:
        met = later.join(ids.select(id_col).distinct(), id_col, "left_semi").select(id_col)
    if where is not None:
        before = visible(log, read_version, id_col).where(where).join(later.select(id_col).distinct(), id_col, "left_semi").select(id_col)
        both = before.union(later.where(~F.col("deleted")).where(where).select(id_col))
        met = both if met is None else met.union(both)
    return met.distinct()


@dataclass(frozen=True)
class Log:
    """A class's log; reads below `base` are no longer possible."""

    rows: DataFrame
    base: int = 0

    def version(self) -> int:
        return self.rows.agg(F.max("version")).first()[0] or self.base

    def at(self, version: int | None = None) -> DataFrame:
        if version is not None and version < self.base:
            raise ValueError(f"version {version} is before {self.base}, from which on the log is kept")
        return visible(self.rows, version)

    def appended(self, changed: DataFrame, version: int) -> Log:
        """With change rows (id, deleted, columns...) as a version; columns that they lack are null."""
        return replace(self, rows=self.rows.unionByName(changed.withColumn("version", F.lit(version).cast("bigint")), allowMissingColumns=True))

    def compacted(self, version: int) -> Log:
        """Without what no reader from `version` on sees: one row an id up to it, and everything later, deletions too."""
        kept = self.at(version).withColumn("deleted", F.lit(False))
        return Log(kept.unionByName(self.rows.where(F.col("version") > version)), version)


@dataclass
class Transaction:
    """Reads one version of a log, collects change rows, and commits them if nothing it read or wrote has changed since."""

    log: Log
    writes: bool = True
    started: int = field(init=False)
    changed: DataFrame | None = None
    read_ids: DataFrame | None = None
    read_where: Column | None = None
    open: bool = True

    def __post_init__(self) -> None:
        self.started = self.log.version()

    def _check(self, writing: bool = False) -> None:
        if not self.open or writing and not self.writes:
            raise Closed("the transaction has ended" if not self.open else "a reading transaction can't write")

    def _now(self) -> DataFrame:
        """The version read, with the transaction's own changes."""
        return visible(self.log.appended(self.changed, self.started + 1).rows, self.started + 1) if self.changed is not None else self.log.at(self.started)

    def get(self, ids: DataFrame) -> DataFrame:
        self._check()
        ids = ids.select("id")
        self.read_ids = ids if self.read_ids is None else self.read_ids.union(ids)
        return self._now().join(ids.distinct(), "id", "left_semi")

    def where(self, condition: Column) -> DataFrame:
        self._check()
        self.read_where = condition if self.read_where is None else self.read_where | condition
        return self._now().where(condition)

    def scan(self) -> DataFrame:
        return self.where(F.lit(True))

    def write(self, changed: DataFrame) -> None:
        """Change rows (id, deleted, columns...), visible to own reads at once; the last write of an id counts."""
        self._check(writing=True)
        if self.changed is not None:
            changed = self.changed.join(changed, "id", "left_anti").unionByName(changed, allowMissingColumns=True)
        self.changed = changed

    def rollback(self) -> None:
        self.open, self.changed = False, None

    def commit(self, now: Log) -> Log:
        """The log with the changes as its next version; Conflict, and nothing written, if `now` has rows that get in the way."""
        self._check()
        self.open = False
        ids = [df.select("id") for df in (self.changed, self.read_ids) if df is not None]
        ids = ids[0].union(ids[1]) if len(ids) == 2 else ids[0] if ids else None
        if self.changed is None:  # what it read was one version
            return now
        if not conflicts(now.rows, self.started, ids, self.read_where).isEmpty():
            raise Conflict(f"changed since version {self.started}")
        return now.appended(self.changed, now.version() + 1)


def write_version(changed: DataFrame, path: str, version: int) -> None:
    """Change rows of one version as plain Parquet; a version that is there already is an error."""
    changed.drop("version").write.mode("error").parquet(f"{path.rstrip('/')}/version={version}")


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The complete versions under path, or None without any."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version=*/_SUCCESS")
    done = top.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(top)  # one entry a version
    folders = [str(s.getPath().getParent()) for s in done or []]
    if not folders:
        return None
    rows = spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*folders)
    return rows.withColumn("version", F.col("version").cast("bigint"))
