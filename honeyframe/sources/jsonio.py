"""Cells as JSON lines or arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from honeyframe.errors import InvalidArgument
from honeyframe.functions.geometry import Coord, check_radius, near, spiral

CELL_JSON = "q int, r int, raw_content string, source_id string, confidence double, created_at long, updated_at long, valid_from long, valid_to long, tags array<string>"


def export_cells(snap: DataFrame, center: Coord, radius: int) -> DataFrame:
    """The disk's cells in spiral order, each as one JSON text in the column ``json``; write it with df.write.text."""
    check_radius(center, radius)
    rows = snap.filter(near("q", "r", center, radius)).orderBy(spiral("q", "r", center))
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def export_array(snap: DataFrame, center: Coord, radius: int) -> str:
    """The same as one JSON array, for disks that fit on the driver."""
    return "[" + ",".join(r.json for r in export_cells(snap, center, radius).toLocalIterator()) + "]"


def import_cells(lines: DataFrame, more: str = "") -> DataFrame:
    """Rows of JSON texts (one column), strictly: a text that isn't a cell fails the job."""
    schema = CELL_JSON + (f", {more}" if more else "")
    return lines.select(F.from_json(F.col(lines.columns[0]), schema, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of JSON arrays of cells."""
    rows = spark.read.schema(CELL_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if rows.filter("q is null or r is null").limit(1).count():
        raise InvalidArgument("a cell has no coordinate")
    return rows
