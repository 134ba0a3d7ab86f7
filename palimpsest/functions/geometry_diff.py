"""Coordinate-level differences of geometries as text."""

from __future__ import annotations

import difflib

from palimpsest.functions.spatial import from_wkb, from_wkt, to_wkb, to_wkt


def coordinates(wkb: bytes | None) -> list[str]:
    """The geometry's text in pieces that end after each coordinate pair."""
    if wkb is None:
        return []
    out, held = [], ""
    for mark in to_wkt(from_wkb(wkb)):
        held += mark
        if mark in ",(":
            out.append(held)
            held = ""
    return [*out, held]


def diff(old: bytes | None, new: bytes | None) -> list[tuple[str, int, list[str], list[str]]]:
    """(operation, place, old pieces, new pieces) for each stretch that differs."""
    a, b = coordinates(old), coordinates(new)
    return [(op, i, a[i:j], b[k:m]) for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op != "equal"]


def apply(old: bytes | None, changes: list[tuple[str, int, list[str], list[str]]]) -> bytes | None:
    """The new geometry; the old pieces must be where the changes say."""
    pieces = coordinates(old)
    for _, at, was, now in sorted(changes, key=lambda c: -c[1]):
        if pieces[at : at + len(was)] != was:
            raise ValueError("the change doesn't fit this geometry")
        pieces[at : at + len(was)] = now
    return to_wkb(from_wkt("".join(pieces))) if pieces else None


def conflicts(base: bytes | None, a: bytes | None, b: bytes | None) -> bool:
    """Two sides conflict when both changed the geometry and not to the same."""
    return a != base and b != base and a != b
