"""Month arithmetic on ``yyyymm`` integers.

Three notions of "previous" are kept apart on purpose: trailing windows count an
asset's own rows, targets and book turnover use calendar months
(:func:`month_index`), and drift uses the previous month the series traded in
(``operators.accounting.month_ordinals``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(c: Column) -> Column:
    return (F.floor(c / 100) * 12 + c % 100).cast("int")


def next_month(c: Column) -> Column:
    return F.when(c % 100 == 12, c + 89).otherwise(c + 1).cast("int")


def from_month_index(mi: Column) -> Column:
    return (F.floor((mi - 1) / 12) * 100 + (mi - 1) % 12 + 1).cast("int")


def yyyymm(ts: Column) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def decimal_year(c: Column) -> Column:
    return F.floor(c / 100) + (c % 100 - 1) / 12.0


def month_index_of(v: int) -> int:
    return v // 100 * 12 + v % 100
