"""Functions of array properties with places from 0 and null equal to null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def _inside(a: Column, i: int, out: Column) -> Column:
    """out where a has a place i, null for a null array; a place outside raises."""
    inside = (F.lit(i) >= 0) & (F.lit(i) < F.size(a))
    return F.when(a.isNull(), F.lit(None)).when(inside, out).otherwise(F.raise_error(F.lit("index out of range")))


def item(a: Column, i: int) -> Column:
    """Element i; a place outside raises."""
    return _inside(a, i, F.get(a, F.lit(i)))


def set_item(a: Column, i: int, v: Column) -> Column:
    return _inside(a, i, F.transform(a, lambda x, at: F.when(at == i, v).otherwise(x)))


def add(a: Column, v: Column) -> Column:
    return F.concat(a, F.array(v))


def add_range(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def clear(a: Column) -> Column:
    """Empty, and null for null."""
    return F.slice(a, 1, 0)


def contains(a: Column, v: Column) -> Column:
    return F.exists(a, lambda x: x.eqNullSafe(v))


def index_of(a: Column, v: Column) -> Column:
    """First place of v, or -1."""
    marks = F.transform(a, lambda x: x.eqNullSafe(v))
    return (F.array_position(marks, True) - 1).cast("int")


def insert(a: Column, i: int, v: Column) -> Column:
    """v before element i, which must be there: nothing can be inserted at the end."""
    return _inside(a, i, F.concat(F.slice(a, 1, max(i, 0)), F.array(v), F.slice(a, F.lit(max(i, 0) + 1), F.size(a))))


def insert_reference(a: Column, i: int, v: Column) -> Column:
    """v before element i or at the end of an array of references, which holds no null."""
    some = F.when(v.isNull(), F.raise_error(F.lit("null reference"))).otherwise(v)
    inside = (F.lit(i) >= 0) & (F.lit(i) <= F.size(a))
    out = F.concat(F.slice(a, 1, max(i, 0)), F.array(some), F.slice(a, F.lit(max(i, 0) + 1), F.greatest(F.size(a), F.lit(1))))
    return F.when(a.isNull(), F.lit(None)).when(inside, out).otherwise(F.raise_error(F.lit("index out of range")))


def _without(a: Column, i: Column) -> Column:
    return F.filter(a, lambda x, at: at != i)


def remove(a: Column, v: Column) -> Column:
    """a without the first v."""
    return _without(a, index_of(a, v))


def remove_at(a: Column, i: int) -> Column:
    return _inside(a, i, _without(a, F.lit(i)))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))
