"""Array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 64


def named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, wherever ``use`` repeats it."""
    return F.transform(F.array(value), use)[0]


def prefix_sums(values: Column) -> Column:
    """array<bigint>: of each element, the sum of those before it.

    Sums of chunks come first, so n elements take about 64 n + (n / 64)**2 / 2
    additions and not n**2 / 2; a null array gives null."""

    def total(array: Column, first: Column, count: Column) -> Column:
        return F.aggregate(F.slice(array, first, count), F.lit(0).cast("long"), lambda s, x: s + x)

    def of(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(v) - 1) / _CHUNK).cast("int"))
        sums = F.transform(chunks, lambda k: total(v, k * _CHUNK + 1, F.lit(_CHUNK)))
        return named(sums, lambda s: placed(v, F.transform(s, lambda _, k: total(s, F.lit(1), k))))

    def placed(v: Column, base: Column) -> Column:
        return named(base, lambda b: F.transform(v, lambda _, i: b[F.floor(i / _CHUNK).cast("int")] + total(v, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK)))

    return F.when(F.size(values) > 0, named(values, of)).when(values.isNotNull(), F.array().cast("array<bigint>"))
