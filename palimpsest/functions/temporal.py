"""Interval relations on (start, end) columns; an instant is an interval whose ends are equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Interval = tuple[Column, Column]


def instant(c: Column | str) -> Interval:
    c = F.col(c) if isinstance(c, str) else c
    return c, c


RELATIONS: dict[str, Callable[[Interval, Interval], Column]] = {
    "AFTER": lambda a, b: a[0] > b[1],
    "ANYINTERACTS": lambda a, b: (a[0] <= b[1]) & (a[1] >= b[0]),
    "BEFORE": lambda a, b: a[1] < b[0],
    "BEGINS": lambda a, b: (a[0] == b[0]) & (a[1] < b[1]),
    "BEGUNBY": lambda a, b: (a[0] == b[0]) & (a[1] > b[1]),
    "DURING": lambda a, b: (a[0] > b[0]) & (a[1] < b[1]),
    "ENDEDBY": lambda a, b: (a[1] == b[1]) & (a[0] < b[0]),
    "ENDS": lambda a, b: (a[1] == b[1]) & (a[0] > b[0]),
    "MEETS": lambda a, b: a[1] == b[0],
    "METBY": lambda a, b: a[0] == b[1],
    "OVERLAPPEDBY": lambda a, b: (a[0] > b[0]) & (a[0] < b[1]) & (a[1] > b[1]),
    "TCONTAINS": lambda a, b: (a[0] < b[0]) & (a[1] > b[1]),
    "TEQUALS": lambda a, b: (a[0] == b[0]) & (a[1] == b[1]),
    "TOVERLAPS": lambda a, b: (a[0] < b[0]) & (a[1] > b[0]) & (a[1] < b[1]),
}


def relation(name: str, a: Interval, b: Interval) -> Column:
    return RELATIONS[name.upper()](a, b)
