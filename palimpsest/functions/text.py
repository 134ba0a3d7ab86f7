"""Typed values and text: values, maps and arrays to text and back, and times in words."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_text(c: Column, kind: T.DataType) -> Column:
    """A value as text; binary as hex, arrays joined by spaces, maps and structs as JSON, null as null."""
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.ArrayType):
        return array_to_text(c)
    if isinstance(kind, (T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def from_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unhex(c)
    if isinstance(kind, T.ArrayType):
        return text_to_array(c, kind.elementType)
    if isinstance(kind, (T.MapType, T.StructType)):
        return F.from_json(c, kind)
    return c.try_cast(kind)


def array_to_text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def text_to_array(c: Column, element: T.DataType) -> Column:
    return F.transform(F.filter(F.split(c, r"\s+"), lambda x: x != ""), lambda x: x.try_cast(element))


def map_to_text(c: Column) -> Column:
    return F.to_json(c)


def text_to_map(c: Column) -> Column:
    return F.from_json(c, T.MapType(T.StringType(), T.StringType()))


#: Seconds of a unit (fixed values); a year counts 365 days.
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}


def parse_timestamp(text: str, now: datetime | None = None) -> datetime:
    """Milliseconds since 1970, ISO dates and times, ``now``, ``today``, ``yesterday`` or ``2.days.ago`` (UTC)."""
    now = now or datetime.now(timezone.utc)
    word = text.strip().lower()
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if word in ("now", "today", "yesterday"):
        return {"now": now, "today": midnight, "yesterday": midnight - timedelta(days=1)}[word]
    if re.fullmatch(r"-?\d{5,}", word):
        return datetime.fromtimestamp(int(word) / 1000, timezone.utc)
    if word.endswith("ago"):
        parts = [p for p in re.split(r"[.\s]+", word)[:-1] if p]
        if not parts or len(parts) % 2:
            raise ValueError(f"not a time: {text}")
        for number, unit in zip(parts[::2], parts[1::2], strict=True):
            if unit.rstrip("s") not in SECONDS or not number.isdigit():
                raise ValueError(f"not a time: {text}")
            now -= timedelta(seconds=int(number) * SECONDS[unit.rstrip("s")])
        return now
    found = datetime.fromisoformat(text.strip())
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)
