"""What a store holds, for a person to look at: identities, cells, and single raw values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from honeyframe.operators.query import CellQuery, query_cells

#: Of each family what tells its records apart, as text after the family's name.
_NAMES = {
    "cells": ("cell", ("q", "r")),
    "facets": ("facet", ("q", "r", "facet_id")),
    "edges": ("edge", ("from_q", "from_r", "to_q", "to_r", "relation")),
    "seams": ("seam", ("id",)),
    "vectors": ("vector", ("q", "r")),
}


def shown(value: Column) -> Column:
    """Text with a dot for what can't be printed."""
    return F.regexp_replace(value, r"[^\x20-\x7E]", ".")


def identities(store, prefix: str = "", most: int = 0) -> DataFrame:
    """Current records of all families and raw pairs, one name each, in order; only families that the prefix can mean are read."""
    parts = []
    for family, (name, columns) in _NAMES.items():
        if f"{name}/".startswith(prefix) or prefix.startswith(f"{name}/"):
            parts.append(store.current(family).select(F.concat_ws("/", F.lit(name), *[F.col(c).cast("string") for c in columns]).alias("name")))
    parts.append(store.current("kv").select(shown(F.decode("k", "ISO-8859-1")).alias("name")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    out = out.filter(F.col("name").startswith(prefix)).orderBy("name")
    return out.limit(most) if most > 0 else out


def cells(store, text: str = "", tag: str = "", source: str = "", most: int = 50) -> DataFrame:
    """Visible cells that meet the filters, best first: q, r, source_id, confidence, tags, content; all of them for 0."""
    found = query_cells(store.view(), CellQuery(text, require_tags=(tag,) if tag else (), source_id=source, max_results=most))
    return found.select("q", "r", "source_id", F.round("confidence", 2).alias("confidence"), F.array_join("tags", ", ").alias("tags"), F.col("raw_content").alias("content"))
