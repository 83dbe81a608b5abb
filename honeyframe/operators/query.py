"""The filtering and ranking query over a snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from honeyframe.errors import InvalidArgument, ScanLimit
from honeyframe.functions import lexical
from honeyframe.functions.geometry import MAX_RADIUS, Coord, check_radius, near
from honeyframe.functions.scalars import has_all, has_any
from honeyframe.plans.planner import access_path

SORTS = ("score", "confidence", "recency", "coord")
MAX_CANDIDATES = 10_000


@dataclass(frozen=True)
class CellQuery:
    """What to look for; all clauses hold together. Zero and empty values switch a clause off."""

    query: str = ""
    require_tags: tuple[str, ...] = ()
    any_tags: tuple[str, ...] = ()
    exclude_tags: tuple[str, ...] = ()
    source_id: str = ""
    min_confidence: float = 0.0
    max_confidence: float = 0.0
    after: int | None = None
    before: int | None = None
    center: Coord | None = None
    radius: int = 0
    sort_by: str = "score"
    max_results: int = 0
    max_scan_rows: int = 0
    explain: bool = False
    embedding: tuple[float, ...] = ()
    embedding_candidate_limit: int = 0

    def validate(self) -> CellQuery:
        if self.sort_by not in SORTS:
            raise InvalidArgument(f"no such order: {self.sort_by}")
        if not 0 <= self.radius <= MAX_RADIUS:
            raise InvalidArgument("the radius is out of bounds")
        if self.radius:
            check_radius(self.center or (0, 0), self.radius)
        if not 0 <= self.embedding_candidate_limit <= MAX_CANDIDATES or self.max_scan_rows < 0:
            raise InvalidArgument("a budget is out of bounds")
        if self.embedding and self.max_scan_rows and (self.embedding_candidate_limit or not (self.require_tags or self.source_id or self.radius)):
            raise InvalidArgument("a budget with a vector needs a tag, a source or a radius, and no candidate limit")
        return self


def predicate(q: CellQuery) -> Column:
    """All clauses but the lexical one. Tags match as they are written, on every access path."""
    out = F.lit(True)
    if q.require_tags:
        out &= has_all("tags", list(q.require_tags))
    if q.any_tags:
        out &= has_any("tags", list(q.any_tags))
    if q.exclude_tags:
        out &= ~has_any("tags", list(q.exclude_tags))
    if q.source_id:
        out &= F.col("source_id") == q.source_id
    if q.min_confidence > 0:
        out &= F.col("confidence") >= q.min_confidence
    if q.max_confidence > 0:
        out &= F.col("confidence") <= q.max_confidence
    if q.after is not None:
        out &= F.col("valid_from") > q.after
    if q.before is not None:
        out &= F.col("valid_from") < q.before
    if q.radius > 0:
        out &= near("q", "r", q.center or (0, 0), q.radius)
    return out


def order_of(q: CellQuery, ordinal: Column) -> list[Column]:
    """A total order: ties go by the place at which the access path meets a cell."""
    by = {
        "score": [F.col("score").desc(), F.col("confidence").desc(), ordinal],
        "confidence": [F.col("confidence").desc(), ordinal],
        "recency": [F.col("valid_from").desc_nulls_last(), ordinal],
        "coord": [F.col("q").asc(), F.col("r").asc()],
    }
    return by[q.sort_by]


def scored(rows: DataFrame, q: CellQuery) -> DataFrame:
    return rows.filter(predicate(q) & lexical.matches(q.query)).withColumn("score", lexical.score(q.query))


def query_cells(snap: DataFrame, q: CellQuery, versions: DataFrame | None = None) -> DataFrame:
    """Cells that meet the query, best first, with score (and explanation).

    With ``max_scan_rows`` only so many physical versions of the access path are examined, as budget_reached tells; it
    needs ``versions``, the rows that the snapshot was taken from.
    """
    q.validate()
    path, ordinal = access_path(q)
    rows = snap
    if q.max_scan_rows:
        rows = within_budget(snap, versions if versions is not None else snap, q, path, ordinal)
    out = scored(rows, q)
    if q.explain:
        out = out.withColumn("explanation", lexical.explanation(q.query))
    out = out.orderBy(*order_of(q, ordinal))
    return out.limit(q.max_results) if q.max_results > 0 else out


def within_budget(snap: DataFrame, versions: DataFrame, q: CellQuery, path: str, ordinal: Column) -> DataFrame:
    """Cells of the first ``max_scan_rows`` rows that the access path meets; the cell in hand at the budget is still read whole.

    The budgeted part is found by a top-k, not by numbering all rows in one task.
    """
    met = versions
    if path == "tag":
        met = snap.filter(F.array_contains("tags", q.require_tags[0]))
    elif path == "source":
        met = snap.filter(F.trim("source_id") == q.source_id.strip())
    elif path == "spatial":
        met = snap.filter(near("q", "r", q.center or (0, 0), q.radius))
    first = met.select("key", "commit_seq", "q", "r").withColumn("_o", ordinal).orderBy("_o", "commit_seq").limit(q.max_scan_rows).select("key").distinct()
    return snap.join(first, "key", "left_semi")


def budget_reached(snap: DataFrame, versions: DataFrame, q: CellQuery) -> bool:
    """Whether more rows than the budget were to be examined; exactly as many is not more."""
    path, _ = access_path(q)
    met = versions
    if path == "tag":
        met = snap.filter(F.array_contains("tags", q.require_tags[0]))
    elif path == "source":
        met = snap.filter(F.trim("source_id") == q.source_id.strip())
    elif path == "spatial":
        met = snap.filter(near("q", "r", q.center or (0, 0), q.radius))
    return bool(q.max_scan_rows) and met.limit(q.max_scan_rows + 1).count() > q.max_scan_rows


def cells_by_source(snap: DataFrame, source: str) -> DataFrame:
    return snap.filter(F.trim("source_id") == source).orderBy("key")


def cells_by_tag(snap: DataFrame, tag: str) -> DataFrame:
    """The index holds trimmed tags and the raw tag is checked: a tag with white space around it is never found."""
    rows = snap.filter(F.array_contains("tags", tag)) if tag and tag == tag.strip() else snap.limit(0)
    return rows.orderBy("key")


def cells_in_week(snap: DataFrame, bucket: int) -> DataFrame:
    from honeyframe.functions.scalars import week_bucket

    return snap.filter(week_bucket() == bucket).orderBy("key")


def distinct_tags(snap: DataFrame) -> DataFrame:
    """Trimmed tags of visible cells, shorter ones first, then in binary order."""
    from honeyframe.functions.scalars import unique_sorted_tags

    return snap.select(F.explode(unique_sorted_tags()).alias("tag")).distinct().orderBy(F.octet_length("tag"), "tag")


def topics(snap: DataFrame) -> DataFrame:
    return distinct_tags(snap).orderBy("tag")


def get_cell(snap: DataFrame, q: int, r: int) -> DataFrame:
    from honeyframe.functions.geometry import pack_one

    return snap.filter(F.col("key") == pack_one(q, r))


def list_cells(snap: DataFrame, limit: int, max_rows: int = 0, versions: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` cells in key order, none for 0 or less.

    ``max_rows`` bounds the stored rows that are looked at, all of ``versions`` or, without them, cells. If the limit isn't
    met within them and there are more, ScanLimit is raised with what was found.
    """
    found = snap.orderBy("key").limit(max(limit, 0))
    if not max_rows or limit <= 0:
        return found
    stored = (snap if versions is None else versions).select("key")
    first = stored.orderBy("key").limit(max_rows).agg(F.max("key").alias("last"), F.count("*").alias("n")).first()
    if first.n < max_rows:
        return found
    within = snap.filter(F.col("key") <= first.last).orderBy("key").limit(limit)
    if within.count() < limit and stored.limit(max_rows + 1).count() > max_rows:
        raise ScanLimit(f"more than {max_rows} rows", within)
    return within
