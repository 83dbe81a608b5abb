"""Scalar functions over record columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from honeyframe.errors import InvalidArgument
from honeyframe.functions.geometry import _c, floor_div

WEEK_NS = 604_800 * 1_000_000_000
METRICS = ("cosine", "dot", "l2")


def valid_at(at, valid_from="valid_from", valid_to="valid_to") -> Column:
    """Whether a time (unix ns) is in the half-open window [from, to); a null bound is open."""
    at, low, high = _c(at), _c(valid_from), _c(valid_to)
    return (low.isNull() | (low <= at)) & (high.isNull() | (at < high))


def week_bucket(valid_from="valid_from") -> Column:
    """Number of the UTC week that a time falls in, rounded down; null for null."""
    return floor_div(valid_from, WEEK_NS)


def content_hash(content="raw_content") -> Column:
    return F.sha2(_c(content).cast("binary"), 256)


def unique_sorted_tags(tags="tags") -> Column:
    """Trimmed, without empty ones, each once, in binary order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(_c(tags), F.trim), lambda t: t != "")))


def folded_tags(tags="tags") -> Column:
    """In small letters, each once, in the order of their first places."""
    return F.array_distinct(F.transform(_c(tags), F.lower))


def canonical_pair(a, b) -> tuple[Column, Column]:
    return F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b))


def _sum_of(a, b, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda t, x: t + x)


def dot(a, b) -> Column:
    return _sum_of(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))


def cosine(a, b) -> Column:
    """0 where either vector is all zeros."""
    a, b = _c(a), _c(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def l2_similarity(a, b) -> Column:
    """The Euclidean distance, negated, so that more is nearer."""
    return -F.sqrt(_sum_of(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def similarity(metric: str, a, b) -> Column:
    if metric not in METRICS:
        raise InvalidArgument(f"no such metric: {metric}")
    return {"cosine": cosine, "dot": dot, "l2": l2_similarity}[metric](a, b)


def has_all(tags, wanted: list[str]) -> Column:
    tags = _c(tags)
    out = F.lit(True)
    for t in wanted:
        out = out & F.array_contains(tags, t)
    return out


def has_any(tags, wanted: list[str]) -> Column:
    return F.arrays_overlap(_c(tags), F.array(*[F.lit(t) for t in wanted]))


def uniform_cost() -> Column:
    return F.lit(1.0)


def hex_heuristic(q1, r1, q2, r2) -> Column:
    from honeyframe.functions.geometry import distance

    return distance(q1, r1, q2, r2).cast("double")


def euclidean_heuristic(q1, r1, q2, r2) -> Column:
    """Straight distance of hex centers that lie 1 apart."""
    dq, dr = (_c(q1) - _c(q2)).cast("double"), (_c(r1) - _c(r2)).cast("double")
    return F.sqrt(dq * dq + dq * dr + dr * dr)


def _cell(df: DataFrame, content, tags: Column, source: Column, confidence, now_ns: int) -> DataFrame:
    stamp = F.lit(now_ns).cast("long")
    return df.select("q", "r", _c(content).alias("raw_content"), tags.alias("tags"), source.alias("source_id"), _c(confidence).cast("double").alias("confidence"), stamp.alias("created_at"), stamp.alias("updated_at"))


def user_message_cells(df: DataFrame, content, session, confidence, now_ns: int) -> DataFrame:
    return _cell(df, content, F.array(F.lit("user-message"), F.lit("conversation")), F.concat(_c(session), F.lit("/user")), confidence, now_ns)


def assistant_response_cells(df: DataFrame, content, session, confidence, now_ns: int) -> DataFrame:
    return _cell(df, content, F.array(F.lit("assistant-response"), F.lit("conversation")), F.concat(_c(session), F.lit("/assistant")), confidence, now_ns)


def system_prompt_cells(df: DataFrame, content, version, now_ns: int) -> DataFrame:
    return _cell(df, content, F.array(F.lit("system-prompt")), F.concat(F.lit("system/"), _c(version)), F.lit(1.0), now_ns)


def fact_cells(df: DataFrame, content, source, fact_type: str, confidence, now_ns: int) -> DataFrame:
    tags = ["fact"] + ([fact_type] if fact_type and fact_type.casefold() != "fact" else [])
    return _cell(df, content, F.array(*[F.lit(t) for t in tags]), _c(source), confidence, now_ns)


def provenance(source, confidence, now_ns: int) -> Column:
    stamp = F.lit(now_ns).cast("long")
    return F.struct(_c(source).alias("source_id"), _c(confidence).cast("double").alias("confidence"), stamp.alias("created_at"), stamp.alias("updated_at"))
