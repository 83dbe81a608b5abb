"""Lexical scores of cells: the query is split on the driver, the score is one Column over its tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from honeyframe.functions.scalars import folded_tags

#: What each kind of match adds.
CONFIDENCE, TAG_EXACT, TAG_PREFIX, CONTENT_VERBATIM, CONTENT_FOLDED, SOURCE_EXACT = 0.1, 1.0, 0.8, 0.6, 0.5, 0.3


def tokens(query: str) -> list[str]:
    """Small letters, split at white space; a repeated token counts as often as it stands there."""
    return query.strip().lower().split()


def _parts(token: str, tags, content, source) -> tuple[Column, ...]:
    folded = folded_tags(tags)
    exact = F.size(F.filter(folded, lambda t: t == token))
    prefix = F.size(F.filter(folded, lambda t: t.startswith(token) & (t != token)))
    content = F.col(content)
    return exact, prefix, content.contains(token), F.lower(content).contains(token), F.lower(F.col(source)) == token


def score(query: str, tags="tags", content="raw_content", source="source_id", confidence="confidence") -> Column:
    """0.1 of the confidence, and for each token what tags, content and source add."""
    total = CONFIDENCE * F.col(confidence)
    for token in tokens(query):
        exact, prefix, verbatim, folded, same = _parts(token, tags, content, source)
        total = total + exact * TAG_EXACT + prefix * TAG_PREFIX
        total = total + F.when(verbatim, CONTENT_VERBATIM).when(folded, CONTENT_FOLDED).otherwise(0.0) + F.when(same, SOURCE_EXACT).otherwise(0.0)
    return total


def matches(query: str, tags="tags", content="raw_content", source="source_id") -> Column:
    """Whether at least one token is found somewhere; true for a query without tokens."""
    found = [(exact + prefix > 0) | folded | verbatim | same for exact, prefix, verbatim, folded, same in (_parts(t, tags, content, source) for t in tokens(query))]
    if not found:
        return F.lit(True)
    out = found[0]
    for x in found[1:]:
        out = out | x
    return F.coalesce(out, F.lit(False))


def _tag_hit(token: str):
    return lambda t: F.when(t == token, f" [tag:exact:{token}]").when(t.startswith(token), f" [tag:prefix:{token}]").otherwise("")


def explanation(query: str, score_col: str = "score", embedding_col: str | None = None) -> Column:
    """One line that says where a cell is, what it scored and which tokens matched where."""
    parts = [F.format_string("coord=(%d,%d) score=%.2f conf=%.2f", "q", "r", F.bround(score_col, 2), F.bround("confidence", 2))]
    if embedding_col:
        parts.append(F.format_string(" embedding=%.2f", F.bround(embedding_col, 2)))
    if query.strip():
        parts.append(F.lit(f' query="{query.strip().lower()}"'))
    for token in tokens(query):
        _, _, verbatim, folded, same = _parts(token, "tags", "raw_content", "source_id")
        hit = F.transform(folded_tags("tags"), _tag_hit(token))
        parts += [F.array_join(hit, ""), F.when(verbatim, f" [content:verbatim:{token}]").when(folded, f" [content:icase:{token}]").otherwise(""), F.when(same, f" [source:exact:{token}]").otherwise("")]
    parts.append(F.when(F.size("tags") > 0, F.concat(F.lit(" tags=["), F.array_join("tags", " "), F.lit("]"))).otherwise(""))
    stamp = F.date_format(F.timestamp_micros(F.call_function("div", F.col("valid_from"), F.lit(1000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts.append(F.when(F.col("valid_from").isNotNull(), F.concat(F.lit(" validFrom="), stamp)).otherwise(""))
    return F.concat(*parts)
