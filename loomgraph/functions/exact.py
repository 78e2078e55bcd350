"""Order-independent money arithmetic.

Floating sums depend on the order of addition, so two runs of one job may
differ in the last digit and a rounded result may flip.  Amounts with two
decimals are therefore summed as whole cents; ANSI mode raises on overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.try_cast("double") * 100).cast("long")


def sum_money(col: Column | str) -> Column:
    return F.sum(cents(col)) / F.lit(100.0)


def avg_2dp(col: Column | str) -> Column:
    c = cents(col)
    return F.round(F.sum(c) / F.count(c)) / F.lit(100.0)


def avg_whole(col: Column | str) -> Column:
    c = cents(col)
    return F.round(F.sum(c) / (F.count(c) * 100))


def sum_whole(col: Column | str) -> Column:
    return F.round(F.sum(cents(col)) / 100)
