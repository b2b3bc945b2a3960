"""Small whole numbers packed into arrays of longs, so that rows which carry them are short."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _of(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def bits(most: Column) -> Column:
    """How many binary digits numbers from 0 to ``most`` have."""
    return F.length(F.bin(most))


def _per(width: Column) -> Column:
    """How many numbers of ``width`` bits a long holds."""
    return _of("div", F.lit(63), width).cast("int")


def longs(n: Column, width: Column) -> Column:
    """How many longs hold ``n`` numbers of ``width`` bits."""
    return _of("div", n + _per(width) - 1, _per(width)).cast("int")


def packed(values: Column, width: Column) -> Column:
    """An array of numbers from 0, none of more than ``width`` bits (63 at most), in as few longs as hold them whole."""
    per = _per(width)
    some = lambda j: F.reverse(F.slice(values, j * per + 1, per))
    count = longs(F.size(values), width)
    each = F.transform(F.sequence(F.lit(1), count), lambda j: F.aggregate(some(j - 1), F.lit(0).cast("long"), lambda acc, v: _of("shiftleft", acc, width).bitwiseOR(v)))
    return F.when(count > 0, each).otherwise(F.array().cast("array<bigint>"))


def unpacked(array: Column, start: Column, i: Column, width: Column) -> Column:
    """The number at place ``i`` (from 0) of those packed from entry ``start`` of ``array`` on."""
    per = _per(width)
    entry = F.get(array, (start + _of("div", i, per)).cast("int"))
    return _of("shiftright", entry, ((i % per) * width).cast("int")).bitwiseAND(_of("shiftrightunsigned", F.lit(-1).cast("long"), 64 - width))
