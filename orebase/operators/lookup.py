"""Scans, point reads, and lookups by hash and sorted indexes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import keys
from ..plans.model import Index, ModelError


class NotFound(LookupError):
    """A strict read of an object that is not there."""


def polymorphic_scan(parts: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """The rows of all concrete classes with `kind`, their class's name, over a base class's columns."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), *columns) for kind, df in parts.items()])


def of_kind(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


def get(rows: DataFrame, id_: int | None, id_col: str = "id") -> DataFrame:
    """The object with an id, or no row."""
    return rows.where(F.col(id_col) == F.lit(id_))


def get_strict(rows: DataFrame, id_: int, id_col: str = "id") -> DataFrame:
    found = get(rows, id_, id_col)
    if found.isEmpty():
        raise NotFound(f"{id_col} {id_}")
    return found


def exists(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Those of ids (one column, id_col) that are there."""
    return ids.join(rows.select(id_col), id_col, "left_semi")


def get_many(rows: DataFrame, ids: Sequence[int], id_col: str = "id") -> DataFrame:
    """Objects in the order of ids as column pos; repeated ids come repeatedly, absent ones not at all."""
    listed = F.split(F.lit(",".join(map(str, ids))), ",")  # one literal, split in the JVM
    wanted = rows.sparkSession.range(1 if ids else 0).select(F.posexplode(listed).alias("pos", "k")).select("pos", F.col("k").cast("bigint").alias(id_col))
    return rows.join(F.broadcast(wanted) if len(ids) <= 1_000_000 else wanted, id_col)


def find(rows: DataFrame, index: Index, values: Sequence[Any]) -> DataFrame:
    """All rows with a key (or, in a sorted index, a key prefix)."""
    keys.check_arity(index, values, exact=not index.sorted)
    return rows.where(keys.equal(index, values))


def find_first(rows: DataFrame, index: Index, values: Sequence[Any], id_col: str = "id") -> DataFrame:
    """The row with the key that has the smallest id."""
    return find(rows, index, values).orderBy(id_col).limit(1)


def find_batch(rows: DataFrame, index: Index, wanted: DataFrame) -> DataFrame:
    """Rows for each row of wanted, whose columns are the index's keys; nulls match nulls."""
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(wanted[k]) for k, _ in index.keys])
    return rows.join(wanted, on, "left_semi")


def duplicates(rows: DataFrame, index: Index) -> DataFrame:
    """Keys held more than once, with their count n (times, if a key is called n): violations of a unique index. Nulls collide."""
    names = [k for k, _ in index.keys]
    count = "times" if "n" in names else "n"
    return rows.groupBy(*names).agg(F.count("*").alias(count)).where(f"{count} > 1")


def index_range(rows: DataFrame, index: Index, low: Sequence[Any] = (), low_open: bool = False, high: Sequence[Any] = (), high_open: bool = False, backward: bool = False, id_col: str = "id") -> DataFrame:
    """Rows from low to high, prefixes of the key in index order, sorted; an empty side is unbounded."""
    if not index.sorted:
        raise ModelError("not_sorted", index.name)
    out = rows
    if len(low):
        keys.check_arity(index, low)
        out = out.where(keys.beyond(index, low, True, not low_open))
    if len(high):
        keys.check_arity(index, high)
        out = out.where(keys.beyond(index, high, False, not high_open))
    return out.orderBy(*keys.order(index, backward, id_col))


def equal_prefix(rows: DataFrame, index: Index, values: Sequence[Any], backward: bool = False, id_col: str = "id") -> DataFrame:
    """Rows with a prefix of a sorted index's keys, in index order or backward."""
    return index_range(rows, index, low=values, high=values, backward=backward, id_col=id_col)


def before(rows: DataFrame, index: Index, values: Sequence[Any], or_equal: bool = False, **how) -> DataFrame:
    return index_range(rows, index, high=values, high_open=not or_equal, **how)


def after(rows: DataFrame, index: Index, values: Sequence[Any], or_equal: bool = False, **how) -> DataFrame:
    return index_range(rows, index, low=values, low_open=not or_equal, **how)


def partial_before(rows: DataFrame, index: Index, values: Sequence[Any], or_equal: bool = False, **how) -> DataFrame:
    """Leading keys equal, the last one before (or at) its value."""
    return index_range(rows, index, low=values[:-1], high=values, high_open=not or_equal, **how)


def partial_after(rows: DataFrame, index: Index, values: Sequence[Any], or_equal: bool = False, **how) -> DataFrame:
    return index_range(rows, index, low=values, low_open=not or_equal, high=values[:-1], **how)
