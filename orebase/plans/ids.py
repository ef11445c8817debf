"""Object ids: a class number above 51 bits of a counter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the id layout.
COUNTER_BITS, LEAST_CLASS = 51, -512


def compose(class_number: Column, counter: Column) -> Column:
    return counter.bitwiseOR(F.shiftleft((class_number - LEAST_CLASS).cast("bigint"), COUNTER_BITS))


def class_number(id_: Column) -> Column:
    return (F.shiftrightunsigned(id_, COUNTER_BITS) + LEAST_CLASS).cast("int")


def reserve(top: int, count: int) -> range:
    """The next `count` counters after the highest one given out; its stop less 1 is the new highest."""
    if top + count >= 1 << COUNTER_BITS:
        raise OverflowError("no ids left in the class")
    return range(top + 1, top + 1 + count)


def counter(id_: Column) -> Column:
    return id_.bitwiseAND(F.lit((1 << COUNTER_BITS) - 1))
