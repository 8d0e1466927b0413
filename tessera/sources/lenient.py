"""Lenient JSON of cell and patch files: which records a body holds, and what the parts of a cell say.

Fixed values: the names under which containers and outlines occur.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections.abc import Iterator

CELL_CONTAINERS = ("cells", "nuclei", "detections", "instances")
PATCH_CONTAINERS = ("patches",)
OUTLINE_NAMES = ("contour", "contours", "polygon", "boundary", "coords", "points", "outline")

UNREADABLE = object()


def parse(body: str | None):
    """The value of ``body``, or UNREADABLE unless it is exactly one complete JSON value."""
    if body is None:
        return UNREADABLE
    try:
        return json.loads(body)
    except (ValueError, RecursionError):
        return UNREADABLE


def said(value):
    """``value``, or what a string says if that is a list or an object."""
    while isinstance(value, str):
        inner = parse(value) if value.lstrip()[:1] in ("[", "{", '"') else UNREADABLE
        if inner is UNREADABLE:
            break
        value = inner
    return value


def _place(key: str) -> int | None:
    """The 32-bit integer that a map's key says, leading zeros aside; None for any other key."""
    found = re.fullmatch(r"\s*([+-]?)0*([0-9]{1,10})\s*", key)
    place = int(found[1] + found[2]) if found else None
    return place if found and -(1 << 31) <= place < 1 << 31 else None


def records(kind: str | None, value) -> Iterator[tuple[int, dict]]:
    """(place, record) of each object in a parsed body: a list, or a map from (32-bit) integer to object."""
    value = said(value)
    if isinstance(value, dict):
        for name in PATCH_CONTAINERS if kind == "index" else CELL_CONTAINERS:
            inner = said(value.get(name))
            if isinstance(inner, (list, dict)):
                value = inner
                break
    if isinstance(value, list):
        pairs = enumerate(value)
    elif isinstance(value, dict):  # keys that say the same integer are one place, the last of them holds
        pairs = {place: v for k, v in value.items() if (place := _place(k)) is not None}.items()
    else:
        return
    for place, record in pairs:
        record = said(record)
        if isinstance(record, dict):
            yield place, record


def number(value) -> float | None:
    """A finite number, perhaps quoted; None for anything else."""
    if isinstance(value, str):
        try:
            value = float(value)
        except ValueError:
            return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    try:
        value = float(value) + 0.0  # -0.0 is 0.0
    except OverflowError:
        return None
    return value if math.isfinite(value) else None


def _leaves(value) -> list:
    value = said(value)
    if isinstance(value, list):
        return [leaf for item in value for leaf in _leaves(item)] if any(isinstance(item, (list, str)) for item in value) else value
    return [value]


def _pair(value) -> list[float] | None:
    """The first two items of a plain list if both are plain numbers of common size: the usual form of a point."""
    if type(value) is list and len(value) > 1:
        a, b = value[0], value[1]
        if (type(a) is float or type(a) is int) and (type(b) is float or type(b) is int) and -1e300 < a < 1e300 and -1e300 < b < 1e300:
            return [a + 0.0, b + 0.0]
    return None


def numbers(value, count: int) -> list[float] | None:
    """The first ``count`` leaves of a flat or nested list if all are numbers."""
    if count == 2 and (point := _pair(value)):
        return point
    if count == 4 and type(value) is list and len(value) == 2 and type(value[0]) is list and len(value[0]) == 2 and (low := _pair(value[0])) and (high := _pair(value[1])):
        return low + high
    value = said(value)
    if isinstance(value, dict):
        value = [value.get("x"), value.get("y")]
    if not isinstance(value, list):
        return None
    found = [number(leaf) for leaf in _leaves(value)[:count]]
    return found if len(found) == count and None not in found else None


def _points(value, top: bool) -> Iterator[list[float]]:
    children = [said(item) for item in value]
    if any(isinstance(item, list) for item in children):
        for item in children:
            if isinstance(item, list):
                yield from _points(item, False)
    elif not top:
        point = [number(item) for item in children[:2]]
        if len(point) == 2 and None not in point:
            yield point


def outline(cell: dict) -> list[list[float]]:
    """The complete points of the first outline that has any; a flat list of numbers has none."""
    for name in OUTLINE_NAMES:
        if name in cell:
            value = cell[name]
            if type(value) is list and value and None not in (points := [_pair(p) for p in value]):
                return points
            value = said(value)
            if isinstance(value, dict):
                xs, ys = said(value.get("x")), said(value.get("y"))
                value = [list(p) for p in zip(xs, ys)] if isinstance(xs, list) and isinstance(ys, list) else None
            if isinstance(value, list) and (points := list(_points(value, True))):
                return points
    return []


def plain(value):
    """A scalar in one form: numbers as float, quoted numbers and booleans unquoted."""
    if type(value) is float and -1e300 < value < 1e300:
        return value + 0.0
    if isinstance(value, str) and value.strip().lower() in ("true", "false"):
        return value.strip().lower() == "true"
    if isinstance(value, bool) or value is None:
        return value
    found = number(value)
    return value if found is None else found


def cell_parts(cell: dict) -> dict:
    """The nested parts of a cell; None or empty where nothing complete is there."""
    return {"centroid": numbers(cell.get("centroid"), 2), "bbox": numbers(cell.get("bbox"), 4), "contour": outline(cell)}


_text = json.JSONEncoder(default=str).encode


def canonical(kind: str | None, record: dict) -> bytes:
    """Equal for records that say the same, whatever the spelling of their parts."""
    if kind == "index":
        return _text([plain(record.get(k)) for k in ("x0", "y0", "has_multiplex", "multiplex_overlap_fraction", "has_mask")]).encode()
    parts = cell_parts(record)
    centroid, bbox = parts["centroid"], parts["bbox"]
    numbers_ = array("d", centroid or ())
    numbers_.extend(bbox or ())
    for point in parts["contour"]:
        numbers_.extend(point)
    head = [centroid is None, bbox is None, plain(record.get("type_cellvit")), record.get("type_name") or None, plain(record.get("type_prob"))]
    return _text(head).encode() + numbers_.tobytes()
