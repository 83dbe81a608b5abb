"""Facets and the choice of single records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from honeyframe.errors import DerivationMismatch, InvalidArgument
from honeyframe.functions.geometry import Coord, pack_one
from honeyframe.functions.scalars import content_hash


def derived(cells: DataFrame, facet_id: int, content: Column, rotated_ns: int) -> DataFrame:
    """Facets of cells with content derived from theirs, and the hash of what it was derived from."""
    if not 0 <= facet_id <= 5:
        raise InvalidArgument("a facet has a number from 0 to 5")
    return cells.select("q", "r", "key", F.lit(facet_id).alias("facet_id"), content.alias("derived_content"), F.lit(rotated_ns).cast("long").alias("last_rotated"), content_hash().alias("derivation_hash"))


def get_facet(facets: DataFrame, at: Coord, facet_id: int) -> DataFrame:
    if not 0 <= facet_id <= 5:
        raise InvalidArgument("a facet has a number from 0 to 5")
    return facets.filter((F.col("key") == pack_one(*at)) & (F.col("facet_id") == facet_id))


def facets_of(facets: DataFrame, at: Coord) -> DataFrame:
    return facets.filter(F.col("key") == pack_one(*at)).orderBy("facet_id")


def stale_facets(facets: DataFrame, snap: DataFrame) -> DataFrame:
    """Facets whose cell is gone or has other content than they were derived from."""
    live = snap.select("key", content_hash().alias("hash"))
    return facets.join(live, "key", "left").filter(F.col("hash").isNull() | (F.col("hash") != F.col("derivation_hash"))).drop("hash")


def check_derivation(facets: DataFrame, snap: DataFrame) -> DataFrame:
    """``facets`` if each was derived from what its cell now has."""
    if not stale_facets(facets, snap).isEmpty():
        raise DerivationMismatch("a facet's hash isn't its cell's")
    return facets
