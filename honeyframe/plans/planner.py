"""Which way a query would walk the lattice: it sets the order of ties, and what a scan budget covers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from honeyframe.functions.geometry import disk_size, spiral

#: A disk of up to so many coordinates is walked before any index is used.
SPATIAL_FIRST = 4096


def access_path(q) -> tuple[str, Column]:
    """(path, ordinal): spatial (in spiral order), or tag, source and full (in key order)."""
    center = q.center or (0, 0)
    if q.radius > 0 and disk_size(q.radius) <= (q.max_scan_rows or SPATIAL_FIRST):
        return "spatial", spiral("q", "r", center)
    if q.require_tags:
        return "tag", F.col("key")
    if q.source_id.strip():
        return "source", F.col("key")
    if q.radius > 0:
        return "spatial", spiral("q", "r", center)
    return "full", F.col("key")
