"""Rows of two engines in a form in which they can be compared."""

from __future__ import annotations

import datetime
import decimal


def cell(v):
    if hasattr(v, "item") and not isinstance(v, (datetime.date, str, bytes)) and getattr(v, "ndim", 0) == 0:
        v = v.item()
    if v is None or v != v:
        return None
    if isinstance(v, (bool, int, float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [cell(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(cell(r[k]) for k in order) for r in values), key=repr)
