"""Every query by name: the operator on the synthetic tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from honeyframe.functions import geometry as G
from honeyframe.functions import lexical, scalars as S
from honeyframe.operators import analytics, context, facets as facet_ops, fov, graph, placement, query, seams as seam_ops, snapshot, spatial, vector
from honeyframe.operators.query import CellQuery, query_cells
from honeyframe.plans import oracle as O
from honeyframe.plans.lineage import cut
from honeyframe.sources import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

AT = X.BASE_NS + 200 * X.HOUR_NS
WEEK = AT // S.WEEK_NS
CENTER, RADIUS = (2, -3), 5
SEEDS = ((0, 0), (6, -2), (-5, 3))
WORDS = "the of"


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _ids(df: DataFrame, *more) -> DataFrame:
    return df.select("doc_id", "q", "r", *more)


def _score() -> F.Column:
    return F.round("score", 6).alias("score")


# The filtering query -------------------------------------------------------------------------------------------------

_SORTS = {"score": "ORDER BY score DESC, confidence DESC, o", "confidence": "ORDER BY confidence DESC, o", "recency": "ORDER BY valid_from DESC NULLS LAST, o", "coord": "ORDER BY q, r"}


def _select(name: str, q: CellQuery, where: str, spatial_order: bool = False) -> None:
    tokens = lexical.tokens(q.query)
    where = " AND ".join(x for x in (where, O.matched(tokens) if tokens else "") if x) or "true"
    place = O.spiral("q", "r", q.center) if spatial_order else "key"
    limit = f"LIMIT {q.max_results}" if q.max_results else ""
    body = f"SELECT doc_id, q, r, round(score, 6) AS score FROM (SELECT *, {O.score(tokens)} AS score, {place} AS o FROM cells WHERE {where}) {_SORTS[q.sort_by]} {limit}"
    register(name, O.sql(body, "cells"))(lambda spark, d: _ids(query_cells(X.cells(spark, d), q), _score()))


_select("query_lexical_top20", CellQuery(WORDS, max_results=20), "")
_select("query_lexical_folded", CellQuery("THE En src3", max_results=50), "")
_select("query_require_tags", CellQuery(require_tags=("en", "quality")), "list_contains(tags, 'en') AND list_contains(tags, 'quality')")
_select("query_any_tags", CellQuery(any_tags=("toxic", "short")), "list_has_any(tags, ['toxic', 'short'])")
_select("query_exclude_tags", CellQuery(exclude_tags=("en", "long")), "NOT list_has_any(tags, ['en', 'long'])")
_select("query_source", CellQuery(source_id="src3"), "source_id = 'src3'")
_select("query_confidence_range", CellQuery(min_confidence=0.25, max_confidence=0.625), "confidence >= 0.25 AND confidence <= 0.625")
_select("query_temporal_range", CellQuery(after=AT - 90 * X.HOUR_NS, before=AT), f"valid_from > {AT - 90 * X.HOUR_NS} AND valid_from < {AT}")
_select("query_radius", CellQuery(center=CENTER, radius=RADIUS), f"{O.dist('q', 'r', *CENTER)} <= {RADIUS}", True)
_select("query_sort_confidence", CellQuery(sort_by="confidence", max_results=40), "")
_select("query_sort_recency", CellQuery(sort_by="recency", max_results=40), "")
_select("query_sort_coord", CellQuery(sort_by="coord", max_results=40), "")
_select("query_sort_recency_radius", CellQuery(center=CENTER, radius=8, sort_by="recency", max_results=60), f"{O.dist('q', 'r', *CENTER)} <= 8", True)
_select(
    "query_combined",
    CellQuery(WORDS, require_tags=("en",), exclude_tags=("toxic",), source_id="src6", min_confidence=0.125, center=(0, 0), radius=30, max_results=25),
    f"list_contains(tags, 'en') AND NOT list_has_any(tags, ['toxic']) AND source_id = 'src6' AND confidence >= 0.125 AND {O.dist('q', 'r', 0, 0)} <= 30",
    True,
)
_select("query_none_found", CellQuery(require_tags=("absent",)), "list_contains(tags, 'absent')")


def _why(token: str) -> str:
    return f"""array_to_string([CASE WHEN lower(t) = '{token}' THEN ' [tag:exact:{token}]' WHEN starts_with(lower(t), '{token}') THEN ' [tag:prefix:{token}]' ELSE '' END FOR t IN tags], '')
      || CASE WHEN contains(raw_content, '{token}') THEN ' [content:verbatim:{token}]' WHEN contains(lower(raw_content), '{token}') THEN ' [content:icase:{token}]' ELSE '' END
      || CASE WHEN lower(source_id) = '{token}' THEN ' [source:exact:{token}]' ELSE '' END"""


@register(
    "query_explain",
    O.sql(
        f"""SELECT doc_id, 'coord=(' || q || ',' || r || ') score=' || printf('%.2f', round_even(score, 2)) || explanation AS explanation FROM (
      SELECT *, ' conf=' || printf('%.2f', round_even(confidence, 2)) || ' query="en the"' || {_why('en')} || {_why('the')} || ' tags=[' || array_to_string(tags, ' ') || ']'
        || CASE WHEN valid_from IS NOT NULL THEN ' validFrom=' || strftime(make_timestamp(valid_from // 1000), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS explanation, {O.score(['en', 'the'])} AS score FROM cells WHERE {O.matched(['en', 'the'])})
    ORDER BY score DESC, confidence DESC, key LIMIT 30""",
        "cells",
    ),
)
def _(spark, d):
    return query_cells(X.cells(spark, d), CellQuery("en THE", explain=True, max_results=30)).select("doc_id", "explanation")


@register("query_scan_budget", O.sql(f"SELECT doc_id, q, r, round({O.score([])}, 6) AS score FROM (SELECT * FROM cells ORDER BY key LIMIT 100) WHERE confidence >= 0.5", "cells"))
def _(spark, d):
    cells = X.cells(spark, d)
    return _ids(query_cells(cells, CellQuery(min_confidence=0.5, max_scan_rows=100), cells), _score())


@register("query_scan_budget_tag", O.sql(f"SELECT doc_id, q, r, round({O.score([])}, 6) AS score FROM (SELECT * FROM cells WHERE list_contains(tags, 'de') ORDER BY key LIMIT 30) WHERE confidence >= 0.5", "cells"))
def _(spark, d):
    cells = X.cells(spark, d)
    return _ids(query_cells(cells, CellQuery(require_tags=("de",), min_confidence=0.5, max_scan_rows=30), cells), _score())


@register("cells_by_source", O.sql("SELECT doc_id, q, r, key FROM cells WHERE trim(source_id) = 'src7'", "cells"))
def _(spark, d):
    return _ids(query.cells_by_source(X.cells(spark, d), "src7"), "key")


@register("cells_by_tag", O.sql("SELECT doc_id, q, r, key FROM cells WHERE list_contains(tags, 'fr')", "cells"))
def _(spark, d):
    return _ids(query.cells_by_tag(X.cells(spark, d), "fr"), "key")


@register("time_bucket_cells", O.sql(f"SELECT doc_id, q, r, {O.floor_div('valid_from', O.WEEK_NS)} AS week FROM cells WHERE {O.floor_div('valid_from', O.WEEK_NS)} = {WEEK}", "cells"))
def _(spark, d):
    return _ids(query.cells_in_week(X.cells(spark, d), WEEK), S.week_bucket().alias("week"))


@register("distinct_tags", O.sql("SELECT DISTINCT trim(t) AS tag FROM (SELECT unnest(tags) AS t FROM cells) WHERE trim(t) <> ''", "cells"))
def _(spark, d):
    return query.distinct_tags(X.cells(spark, d))


@register("get_cell", O.sql("SELECT doc_id, q, r, key, raw_content FROM cells WHERE q = 3 AND r = -2", "cells"))
def _(spark, d):
    return _ids(query.get_cell(X.cells(spark, d), 3, -2), "key", "raw_content")


@register("list_cells", O.sql("SELECT doc_id, q, r FROM cells ORDER BY key LIMIT 75", "cells"))
def _(spark, d):
    return _ids(query.list_cells(X.cells(spark, d), 75, 120))


@register("morton_order", O.sql("SELECT doc_id, key, row_number() OVER (ORDER BY key) AS place FROM cells", "cells"))
def _(spark, d):
    from pyspark.sql import Window

    # Numbered within ranges of keys, and over the ranges by their sizes, of which there is one row each.
    cells = cut(X.cells(spark, d).select("doc_id", "key").repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    sizes = cells.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    return cells.withColumn("nth", within).join(F.broadcast(sizes.withColumn("before", before)), "part").select("doc_id", "key", (F.col("nth") + F.col("before")).cast("long").alias("place"))


# Space -----------------------------------------------------------------------------------------------------------------


@register("walk_ring", O.sql(f"SELECT d.n AS spiral, d.q, d.r, c.doc_id IS NOT NULL AS found, coalesce(c.doc_id, -1) AS doc_id FROM {O.disk((12, -4), 7, 7)} d LEFT JOIN cells c USING (q, r)", "cells"))
def _(spark, d):
    return spatial.walk_ring(X.cells(spark, d), (12, -4), 7).select("spiral", "q", "r", "found", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"))


@register("walk_ring_at", O.sql(f"SELECT doc_id, q, r FROM cells WHERE {O.dist('q', 'r', *CENTER)} = 4 AND {O.valid(AT)}", "cells"))
def _(spark, d):
    return _ids(spatial.walk_ring_at(X.cells(spark, d), CENTER, 4, AT))


@register("scan_context", O.sql(f"SELECT doc_id, q, r, {O.spiral('q', 'r', CENTER)} AS spiral FROM cells WHERE {O.dist('q', 'r', *CENTER)} <= 6 ORDER BY spiral LIMIT 40", "cells"))
def _(spark, d):
    return _ids(spatial.scan_context(X.cells(spark, d), CENTER, 6, 40), "spiral")


@register("scan_context_at", O.sql(f"SELECT doc_id, q, r, {O.spiral('q', 'r', CENTER)} AS spiral FROM cells WHERE {O.dist('q', 'r', *CENTER)} <= 6 AND {O.valid(AT)} ORDER BY spiral LIMIT 40", "cells"))
def _(spark, d):
    return _ids(spatial.scan_context(X.cells(spark, d), CENTER, 6, 40, AT), "spiral")


@register("ring_density", O.sql(f"SELECT CAST(ring AS INT) AS ring, count(c.doc_id) AS occupied, CASE WHEN ring = 0 THEN 1 ELSE 6 * ring END AS total FROM {O.disk((14, 2), 0, 12)} d LEFT JOIN cells c USING (q, r) GROUP BY ring", "cells"))
def _(spark, d):
    return spatial.ring_density(X.cells(spark, d), (14, 2), 12)


@register("total_density", O.sql(f"SELECT count(c.doc_id) AS occupied, count(*) AS total FROM {O.disk((14, 2), 0, 12)} d LEFT JOIN cells c USING (q, r)", "cells"))
def _(spark, d):
    return spatial.total_density(spatial.ring_density(X.cells(spark, d), (14, 2), 12))


@register("untagged_cells", O.sql(f"SELECT q, r, {O.spiral('q', 'r', CENTER)} AS spiral FROM cells WHERE len(list_filter(tags, lambda t: t NOT IN ('en', 'medium', 'long', 'short'))) = 0 AND {O.dist('q', 'r', *CENTER)} <= 9", "cells"))
def _(spark, d):
    cells = X.cells(spark, d).withColumn("tags", F.filter("tags", lambda t: ~t.isin("en", "medium", "long", "short")))
    return spatial.untagged_cells(cells, CENTER, 9).select("q", "r", "spiral")


@register("walk_ring_facets", O.sql(f"""SELECT c.doc_id, string_agg(f.facet_id || ':' || f.derived_content, '|' ORDER BY f.facet_id) AS facets FROM cells c LEFT JOIN facets f ON f.key = c.key AND f.facet_id IN (1, 4)
   WHERE {O.dist('c.q', 'c.r', *CENTER)} = 3 AND {O.valid(AT).replace('valid_', 'c.valid_')} GROUP BY c.doc_id""", "cells", "facets"))
def _(spark, d):
    out = spatial.walk_ring_facets(X.cells(spark, d), X.facets(spark, d), CENTER, 3, 0b10010, AT)
    return out.select("doc_id", F.array_join(F.transform("facets", lambda x: F.concat_ws(":", x["facet_id"].cast("string"), x["derived_content"])), "|").alias("facets"))


@register("geometry_scalars", O.sql(f"""SELECT doc_id, q, r, -q - r AS s, key, CAST({O.dist('q', 'r', 3, -7)} AS INT) AS distance, {O.spiral('q', 'r', (3, -7))} AS spiral, CAST({O.floor_div('q', 3)} AS INT) AS coarse_q, CAST({O.floor_div('r', 3)} AS INT) AS coarse_r,
   CAST({O.floor_div('q', 4)} AS INT) AS multi_q, CAST({O.floor_div('r', 4)} AS INT) AS multi_r FROM coords""", "coords"))
def _(spark, d):
    c, m = G.coarsen("q", "r", 3), G.coarsen("q", "r", 2, 2)
    return X.cells(spark, d).select("doc_id", "q", "r", G.cube_s("q", "r").alias("s"), "key", G.distance("q", "r", 3, -7).alias("distance"), G.spiral("q", "r", (3, -7)).alias("spiral"), c[0].alias("coarse_q"), c[1].alias("coarse_r"), m[0].alias("multi_q"), m[1].alias("multi_r"))


@register("unpack_keys", O.sql("SELECT key, q, r FROM coords", "coords"))
def _(spark, d):
    q, r = G.unpack("key")
    return X.cells(spark, d).select("key", q.alias("q"), r.alias("r"))


@register("neighbors", O.sql("SELECT doc_id, i AS direction, q + a AS neighbor_q, r + b AS neighbor_r FROM coords, (VALUES (0, 1, 0), (1, 1, -1), (2, 0, -1), (3, -1, 0), (4, -1, 1), (5, 0, 1)) t(i, a, b)", "coords"))
def _(spark, d):
    return G.neighbors(X.cells(spark, d)).select("doc_id", "direction", "neighbor_q", "neighbor_r")


@register("spiral_range", f"SELECT n AS spiral, q, r, CAST(ring AS INT) AS ring FROM {O.disk((4, -9), 3, 6)}")
def _(spark, d):
    return G.annulus(spark, (4, -9), 3, 6).select("spiral", "q", "r", "ring")


@register("coarsen_cells", O.sql(f"SELECT CAST({O.floor_div('q', 4)} AS INT) AS q, CAST({O.floor_div('r', 4)} AS INT) AS r, count(*) AS n FROM coords GROUP BY 1, 2", "coords"))
def _(spark, d):
    q, r = G.coarsen("q", "r", 4)
    return X.cells(spark, d).groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("n"))


@register("refine_cells", O.sql("SELECT doc_id, q * 3 + i AS child_q, r * 3 + j AS child_r FROM coords, range(3) a(i), range(3) b(j)", "coords"))
def _(spark, d):
    return G.refine(X.cells(spark, d), 3).select("doc_id", F.col("child_q").cast("long").alias("child_q"), F.col("child_r").cast("long").alias("child_r"))


@register("superhex_children", O.sql("SELECT doc_id, i AS child, 2 * q - r + a AS child_q, q + 3 * r + b AS child_r FROM coords, (VALUES (0, 0, 0), (1, 1, 0), (2, 0, -1), (3, -1, 0)) t(i, a, b) WHERE false", "coords").replace("(VALUES (0, 0, 0), (1, 1, 0), (2, 0, -1), (3, -1, 0)) t(i, a, b) WHERE false", f"(SELECT CAST(n AS INT) AS i, q AS a, r AS b FROM {O.disk((0, 0), 0, 1)}) t"))
def _(spark, d):
    return G.superhex_children(X.cells(spark, d)).select("doc_id", "child", "child_q", "child_r")


def _summary(level: int) -> None:
    center = "(SELECT pq, pr, occupied, last_seq, pq AS cq, pr AS cr FROM g)"
    for _ in range(level):
        center = f"(SELECT pq, pr, occupied, last_seq, 2 * cq - cr AS cq, cq + 3 * cr AS cr FROM {center})"
    body = f"""SELECT CAST(pq AS INT) AS parent_q, CAST(pr AS INT) AS parent_r, CAST(cq AS INT) AS center_q, CAST(cr AS INT) AS center_r, occupied, {7**level}::BIGINT AS capacity, last_seq FROM {center}"""
    more = f"g AS (SELECT pq, pr, count(*) AS occupied, max(commit_seq) AS last_seq FROM {O.parents('live', level, 'commit_seq')} GROUP BY pq, pr)"

    @register(f"superhex_summary_l{level}", O.sql(body, "live", more=more))
    def _(spark, d):
        return analytics.superhex_summary(snapshot.snapshot(X.cell_versions(spark, d)), level)


for _level in (1, 2, 3):
    _summary(_level)


# Versions --------------------------------------------------------------------------------------------------------------

_LIVE = "SELECT q, r, commit_seq, raw_content FROM"


@register("snapshot_head", O.sql(f"{_LIVE} live", "live"))
def _(spark, d):
    return snapshot.snapshot(X.cell_versions(spark, d)).select("q", "r", "commit_seq", "raw_content")


def _at(seq: str) -> str:
    return f"(SELECT * FROM (SELECT * FROM versions WHERE commit_seq <= {seq} QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_seq DESC) = 1) WHERE NOT deleted)"


@register("snapshot_at_seq", O.sql(f"{_LIVE} {_at('400')}", "versions"))
def _(spark, d):
    return snapshot.snapshot(X.cell_versions(spark, d), 400).select("q", "r", "commit_seq", "raw_content")


_HALF = "(SELECT coalesce(max(commit_seq), 0) FROM versions WHERE wall_ns <= (SELECT min(wall_ns) + (max(wall_ns) - min(wall_ns)) // 2 FROM versions))"


@register("snapshot_at_time", O.sql(f"{_LIVE} {_at(_HALF)}", "versions"))
def _(spark, d):
    versions = X.cell_versions(spark, d)
    low, high = versions.agg(F.min("wall_ns"), F.max("wall_ns")).first()
    seq = snapshot.seq_at_time(X.commits(spark, d), low + (high - low) // 2)
    return snapshot.snapshot(versions, seq).select("q", "r", "commit_seq", "raw_content")


@register("snapshot_at_tag", O.sql(f"{_LIVE} {_at('250')}", "versions"))
def _(spark, d):
    tags = spark.createDataFrame([("early", 100), ("release", 250)], "label string, commit_seq long")
    return snapshot.snapshot(X.cell_versions(spark, d), snapshot.seq_of_tag(tags, "release")).select("q", "r", "commit_seq", "raw_content")


@register("snapshot_diff", O.sql("""SELECT 'cell' AS kind, NULL::VARCHAR AS id, commit_seq, q, r, CASE WHEN deleted THEN 'delete' ELSE 'put' END AS op FROM versions WHERE commit_seq > 100 AND commit_seq <= 300
   UNION ALL SELECT 'seam', id, commit_seq, 0, 0, 'put' FROM seams WHERE commit_seq > 100 AND commit_seq <= 300""", "versions", "seams"))
def _(spark, d):
    return snapshot.diff(X.cell_versions(spark, d), X.seams(spark, d), 100, 300).fillna(0, ["q", "r"])


@register("mvcc_stats", O.sql("SELECT max(commit_seq) AS head_seq, count(*) AS version_rows, count(DISTINCT key) AS coords FROM versions", "versions"))
def _(spark, d):
    return snapshot.stats(X.cell_versions(spark, d))


@register("prune_candidates", O.sql("SELECT q, r, commit_seq FROM (SELECT *, lead(commit_seq) OVER (PARTITION BY key ORDER BY commit_seq) AS n FROM versions) WHERE n <= 500", "versions"))
def _(spark, d):
    return snapshot.prunable(X.cell_versions(spark, d), 500).select("q", "r", "commit_seq")


@register("prune_keeps", O.sql("""SELECT q, r, commit_seq FROM versions WHERE (key, commit_seq) NOT IN (SELECT (key, commit_seq) FROM (SELECT *, lead(commit_seq) OVER (PARTITION BY key ORDER BY commit_seq) AS n FROM versions) WHERE n <= 500 ORDER BY key, commit_seq LIMIT 200)""", "versions"))
def _(spark, d):
    return snapshot.prune(X.cell_versions(spark, d), 500, 200)[0].select("q", "r", "commit_seq")


# Vectors ---------------------------------------------------------------------------------------------------------------


def _vector_of(spark, d, i: int = 0) -> list[float]:
    return list(X.vectors(spark, d).filter(F.col("vec_id") == i).select("embedding").first()[0])


_SIMILAR = {
    "cosine": "list_dot_product(v.embedding::DOUBLE[], x.e) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(x.e, x.e)))",
    "dot": "list_dot_product(v.embedding::DOUBLE[], x.e)",
    "l2": "-list_distance(v.embedding::DOUBLE[], x.e)",
}
_ASKED = "x AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)"


def _topk(metric: str) -> None:
    @register(f"vector_topk_{metric}", O.sql(f"SELECT q, r, key, round({_SIMILAR[metric]}, 6) AS score FROM vectors v, x ORDER BY {_SIMILAR[metric]} DESC, key LIMIT 10", "vectors", more=_ASKED))
    def _(spark, d):
        return vector.search(X.vectors(spark, d), _vector_of(spark, d), 10, metric=metric).select("q", "r", "key", F.round("score", 6).alias("score"))


for _metric in S.METRICS:
    _topk(_metric)


@register("vector_min_score", O.sql(f"SELECT q, r, key, round({_SIMILAR['cosine']}, 6) AS score FROM vectors v, x WHERE {_SIMILAR['cosine']} >= 0.2 ORDER BY {_SIMILAR['cosine']} DESC, key LIMIT 50", "vectors", more=_ASKED))
def _(spark, d):
    return vector.search(X.vectors(spark, d), _vector_of(spark, d), 50, min_score=0.2).select("q", "r", "key", F.round("score", 6).alias("score"))


@register("vector_index_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def _(spark, d):
    """Whether the index, at its own effort, finds 0.9 of what the exact search finds, over all ids divisible by 100."""
    exact, found = (QUERIES[x](spark, d).select("query_id", "key") for x in ("vector_topk_many", "vector_index_topk"))
    both = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "key"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("enough"))


@register("vector_index_topk")
def _(spark, d):
    v = X.vectors(spark, d)
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.build_index(v, 1).search_many(asked, 10).select("query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("vector_topk_many", O.sql("""SELECT query_id, key, rank FROM (SELECT a.vec_id AS query_id, v.key, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) DESC, v.key) AS rank
   FROM vectors a, vectors v WHERE a.vec_id % 100 = 0) WHERE rank <= 10""", "vectors"))
def _(spark, d):
    v = X.vectors(spark, d)
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.search_many(v, asked, 10).select("query_id", "key", F.col("rank").cast("long").alias("rank"))


@register("hybrid_vector_lexical", O.sql(f"""SELECT c.doc_id, round({O.score(['en'])} + {_SIMILAR['cosine']}, 6) AS score FROM cells c JOIN vectors v ON v.key = c.key, x
   WHERE list_contains(c.tags, 'en') AND {O.matched(['en'])}""", "cells", "vectors", more=_ASKED))
def _(spark, d):
    q = CellQuery("en", require_tags=("en",), embedding=tuple(_vector_of(spark, d)))
    return vector.query_cells(X.cells(spark, d), X.vectors(spark, d), q).select("doc_id", _score())


_WIDE = f"""near AS (SELECT key, sim, row_number() OVER (ORDER BY sim DESC, key) AS place FROM (SELECT key, {_SIMILAR['cosine']} AS sim FROM vectors v, x) ORDER BY place LIMIT 160),
 hits AS (SELECT c.*, sim, place, row_number() OVER (ORDER BY place) AS nth FROM near JOIN cells c USING (key) WHERE list_contains(tags, 'toxic')),
 steps AS (SELECT unnest([20, 40, 80, 160]) AS n), final AS (SELECT coalesce((SELECT min(n) FROM steps WHERE (SELECT count(*) FROM hits WHERE place <= n) >= 10), 160) AS n)"""


@register("vector_filtered_widening", O.sql(f"SELECT doc_id, round({O.score([])} + sim, 6) AS score FROM hits, final WHERE place <= final.n ORDER BY {O.score([])} + sim DESC, confidence DESC, key LIMIT 10", "cells", "vectors", more=f"{_ASKED}, {_WIDE}"))
def _(spark, d):
    q = CellQuery(require_tags=("toxic",), max_results=10, embedding=tuple(_vector_of(spark, d)))
    return vector.query_cells(X.cells(spark, d), X.vectors(spark, d), q).select("doc_id", _score())


@register("vector_exact_filter", O.sql(f"SELECT c.doc_id, round({O.score([])} + {_SIMILAR['cosine']}, 6) AS score FROM (SELECT * FROM cells WHERE source_id = 'src2' ORDER BY key LIMIT 40) c JOIN vectors v ON v.key = c.key, x", "cells", "vectors", more=_ASKED))
def _(spark, d):
    q = CellQuery(source_id="src2", max_scan_rows=40, embedding=tuple(_vector_of(spark, d)))
    return vector.query_cells(X.cells(spark, d), X.vectors(spark, d), q).select("doc_id", _score())


@register("count_embeddings", "SELECT least(count(*), 300) AS n FROM embeddings")
def _(spark, d):
    return spark.createDataFrame([(vector.count_vectors(X.vectors(spark, d), 300),)], "n long")


# Seams, facets, edges, graph -------------------------------------------------------------------------------------------

_NEAR_SEAM = f"({O.dist('a_q', 'a_r', *CENTER)} <= 12 OR {O.dist('b_q', 'b_r', *CENTER)} <= 12)"


@register("find_seams", O.sql(f"SELECT id, a_key, b_key FROM seams WHERE {_NEAR_SEAM}", "seams"))
def _(spark, d):
    return seam_ops.find_seams(X.seams(spark, d), CENTER, 12).select("id", "a_key", "b_key")


@register("find_seams_at", O.sql(f"SELECT id, a_key, b_key FROM seams WHERE {_NEAR_SEAM} AND {O.valid(AT)}", "seams"))
def _(spark, d):
    return seam_ops.find_seams(X.seams(spark, d), CENTER, 12, as_of=AT).select("id", "a_key", "b_key")


@register("unresolved_seams", O.sql(f"SELECT id, a_key, b_key FROM seams WHERE {_NEAR_SEAM} AND trim(resolution_status) = ''", "seams"))
def _(spark, d):
    return seam_ops.find_seams(X.seams(spark, d), CENTER, 12, True).select("id", "a_key", "b_key")


@register("seams_by_source", O.sql("SELECT id, a_key, b_key FROM seams WHERE trim(source_id) = 'scan-1'", "seams"))
def _(spark, d):
    return seam_ops.seams_by_source(X.seams(spark, d), "scan-1").select("id", "a_key", "b_key")


@register("seams_in_week", O.sql(f"SELECT id, a_key, b_key FROM seams WHERE {O.floor_div('valid_from', O.WEEK_NS)} = {WEEK}", "seams"))
def _(spark, d):
    return seam_ops.seams_in_week(X.seams(spark, d), WEEK).select("id", "a_key", "b_key")


@register("all_seams", O.sql("SELECT id, a_key, b_key, resolution_status FROM seams", "seams"))
def _(spark, d):
    return seam_ops.versions_of(X.seams(spark, d)).select("id", "a_key", "b_key", "resolution_status")


@register("mark_conflict", O.sql("SELECT id, least(a_key, b_key) AS a_key, greatest(a_key, b_key) AS b_key, 'mark_conflict' AS seam_type FROM seams", "seams"))
def _(spark, d):
    pairs = X.seams(spark, d).select("id", "a_q", "a_r", "a_key", "b_q", "b_r", "b_key")
    return seam_ops.mark_conflict(pairs, "id", "differs", AT).select("id", "a_key", "b_key", "seam_type")


_CHAIN = """next AS (SELECT a_key, b_key FROM seams QUALIFY row_number() OVER (PARTITION BY a_key ORDER BY b_key < a_key, b_key, id) = 1),
 chain AS (SELECT a_key AS start, b_key AS here, [a_key] AS seen, 1 AS hops FROM next UNION ALL SELECT start, n.b_key, list_append(seen, here), hops + 1 FROM chain JOIN next n ON n.a_key = here WHERE hops < 17 AND NOT list_contains(seen, here)),
 ends AS (SELECT start, arg_max(here, hops) AS here, max(hops) AS hops FROM chain GROUP BY start),
 resolved AS (SELECT e.start AS key, CASE WHEN hops <= 16 AND n.a_key IS NULL THEN c.key END AS target_key FROM ends e LEFT JOIN next n ON n.a_key = e.here LEFT JOIN coords c ON c.key = e.here)"""


@register("supersession_resolve", O.sql("SELECT key, coalesce(target_key, -1) AS target_key FROM resolved", "seams", more=_CHAIN, recursive=True))
def _(spark, d):
    return seam_ops.resolve_supersession(X.cells(spark, d), X.seams(spark, d)).select("key", F.coalesce("target_key", F.lit(-1)).alias("target_key"))


@register("edges_from", O.sql("SELECT to_q, to_r, relation, weight FROM edges WHERE from_q = 0 AND from_r = 0", "edges"))
def _(spark, d):
    return graph.edges_from(X.edges(spark, d), (0, 0)).select("to_q", "to_r", "relation", "weight")


@register("get_edge", O.sql("SELECT from_key, to_key, relation, weight FROM edges WHERE from_q = 0 AND from_r = 0 AND to_q = 1 AND to_r = 0 AND relation = 'evidence-route'", "edges"))
def _(spark, d):
    return graph.get_edge(X.edges(spark, d), (0, 0), (1, 0), "evidence-route").select("from_key", "to_key", "relation", "weight")


@register("facets_for_cell", O.sql("SELECT facet_id, derived_content FROM facets WHERE q = 1 AND r = -1", "facets"))
def _(spark, d):
    return facet_ops.facets_of(X.facets(spark, d), (1, -1)).select("facet_id", "derived_content")


@register("get_facet", O.sql("SELECT facet_id, derived_content, derivation_hash FROM facets WHERE q = 1 AND r = -1 AND facet_id = 4", "facets"))
def _(spark, d):
    return facet_ops.get_facet(X.facets(spark, d), (1, -1), 4).select("facet_id", "derived_content", "derivation_hash")


@register("stale_facets", O.sql("SELECT f.key, f.facet_id FROM facets f LEFT JOIN (SELECT * FROM cells WHERE doc_id % 7 <> 0) c USING (key) WHERE c.key IS NULL OR sha256(c.raw_content) <> f.derivation_hash", "facets", "cells"))
def _(spark, d):
    return facet_ops.stale_facets(X.facets(spark, d), X.cells(spark, d).filter("doc_id % 7 <> 0")).select("key", "facet_id")


_BFS = "reach AS (SELECT 0 AS q, 0 AS r, 0::BIGINT AS key, 0 AS level UNION SELECT to_q, to_r, to_key, level + 1 FROM reach JOIN edges ON from_key = key WHERE relation = 'evidence-route' AND level < 5)"


@register("bfs_walk", O.sql("SELECT q, r, min(level) AS level FROM reach GROUP BY q, r", "edges", more=_BFS, recursive=True))
def _(spark, d):
    return graph.walk(X.edges(spark, d), (0, 0), "evidence-route", 5).select("q", "r", "level")


#: From the first document's coordinate to that of the document with the number 150.
GOAL = G.spiral_offset(150)
# Every cost is a multiple of a quarter, so that sums are exact.
_COST = """paths(key, cost) USING KEY (key) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION
   SELECT to_key, min(paths.cost + weight) FROM paths JOIN cheapest ON from_key = paths.key LEFT JOIN recurring.paths known ON known.key = to_key WHERE known.cost IS NULL OR paths.cost + weight < known.cost GROUP BY to_key)"""


@register("shortest_path_cost", O.sql(f"SELECT key, cost FROM paths WHERE key = {G.pack_one(*GOAL)}", "edges", more="cheapest AS (SELECT from_key, to_key, min(CASE WHEN weight > 0 THEN weight ELSE 1 END) AS weight FROM edges GROUP BY ALL), " + _COST, recursive=True))
def _(spark, d):
    return graph.shortest_paths(X.edges(spark, d), (0, 0), goal=GOAL).filter(F.col("key") == G.pack_one(*GOAL)).select("key", "cost")


# Context ---------------------------------------------------------------------------------------------------------------


def _pack(pack: context.ContextPack) -> DataFrame:
    return pack.cells.select("doc_id", "ring")


@register("load_context_ring", O.sql(f"SELECT doc_id, CAST({O.dist('q', 'r', *CENTER)} AS INT) AS ring FROM cells WHERE {O.dist('q', 'r', *CENTER)} <= 5 ORDER BY {O.spiral('q', 'r', CENTER)} LIMIT 64", "cells"))
def _(spark, d):
    return _pack(context.load_context(X.cells(spark, d), context.ContextConfig((CENTER,), 5, 64)))


@register("load_context_asof", O.sql(f"SELECT doc_id, CAST({O.dist('q', 'r', *CENTER)} AS INT) AS ring FROM cells WHERE {O.dist('q', 'r', *CENTER)} <= 5 AND {O.valid(AT)} ORDER BY {O.spiral('q', 'r', CENTER)} LIMIT 64", "cells"))
def _(spark, d):
    return _pack(context.load_context(X.cells(spark, d), context.ContextConfig((CENTER,), 5, 64, as_of=AT)))


_SEED_ROWS = "(VALUES " + ", ".join(f"({i}, {q}, {r})" for i, (q, r) in enumerate(SEEDS)) + ") s(i, sq, sr)"
_MULTI = f"""ranked AS (SELECT i, doc_id, {O.dist('q', 'r', 'sq', 'sr')} AS ring, row_number() OVER (PARTITION BY i ORDER BY {O.spiral('q', 'r', ('sq', 'sr'))}) AS rank FROM cells, {_SEED_ROWS} WHERE {O.dist('q', 'r', 'sq', 'sr')} <= 4),
 firsts AS (SELECT doc_id, min((rank, i)) AS o, arg_min(ring, (rank, i)) AS ring FROM ranked WHERE rank <= 50 GROUP BY doc_id)"""


@register("load_context_multi_seed", O.sql("SELECT doc_id, CAST(ring AS INT) AS ring FROM firsts ORDER BY o LIMIT 50", "cells", more=_MULTI))
def _(spark, d):
    return _pack(context.load_context(X.cells(spark, d), context.ContextConfig(SEEDS, 4, 50)))


@register("context_stats", O.sql(f"SELECT CAST(max({O.spiral('q', 'r', CENTER)}) + 1 AS BIGINT) AS candidates_scanned, true AS result_limit_reached, CAST(max({O.dist('q', 'r', *CENTER)}) AS INT) AS max_ring_used FROM (SELECT * FROM cells WHERE {O.dist('q', 'r', *CENTER)} <= 5 ORDER BY {O.spiral('q', 'r', CENTER)} LIMIT 64)", "cells"))
def _(spark, d):
    return context.load_context(X.cells(spark, d), context.ContextConfig((CENTER,), 5, 64)).stats


_NEAREST = "least(" + ", ".join(O.dist("q", "r", *s) for s in SEEDS[:1]) + f", {1 << 30})"


@register("load_context_graph", O.sql(f"SELECT doc_id, CAST({_NEAREST} AS INT) AS ring FROM cells JOIN (SELECT DISTINCT key FROM reach) USING (key)", "cells", "edges", more=_BFS, recursive=True))
def _(spark, d):
    return _pack(context.load_context(X.cells(spark, d), context.ContextConfig(((0, 0),), max_cells=2000, max_hops=5, edge_filter=" evidence-route "), edges=X.edges(spark, d)))


_CANDIDATES = f"""starts AS (SELECT q, r, key AS target, false AS gone FROM coords WHERE key NOT IN (SELECT key FROM resolved) UNION ALL SELECT c.q, c.r, target_key, true FROM resolved JOIN coords c USING (key)),
 firsts AS (SELECT target, min({O.spiral('q', 'r', CENTER)}) AS place, arg_min({O.dist('q', 'r', *CENTER)}, {O.spiral('q', 'r', CENTER)}) AS ring, arg_min(gone, {O.spiral('q', 'r', CENTER)}) AS gone FROM starts WHERE {O.dist('q', 'r', *CENTER)} <= 9 AND target IS NOT NULL GROUP BY target)"""


@register("load_context_superseded", O.sql("SELECT doc_id, CAST(ring AS INT) AS ring, gone AS replaced FROM firsts JOIN coords ON key = target ORDER BY place LIMIT 200", "seams", more=f"{_CHAIN}, {_CANDIDATES}", recursive=True))
def _(spark, d):
    pack = context.load_context(X.cells(spark, d), context.ContextConfig((CENTER,), 9, 200, filter_superseded=True), X.seams(spark, d))
    return pack.cells.select("doc_id", "ring", F.col("superseded_from_q").isNotNull().alias("replaced"))


@register("context_explanations", O.sql(f"SELECT q, r, CAST({O.dist('q', 'r', *CENTER)} AS INT) AS ring, 'included' AS reason, -1::BIGINT AS superseded_by FROM (SELECT * FROM cells WHERE {O.dist('q', 'r', *CENTER)} <= 4 ORDER BY {O.spiral('q', 'r', CENTER)} LIMIT 30)", "cells"))
def _(spark, d):
    return context.load_context(X.cells(spark, d), context.ContextConfig((CENTER,), 4, 30)).explanations.fillna(-1, ["superseded_by"])


@register("context_seams", O.sql(f"SELECT id FROM seams WHERE {O.dist('a_q', 'a_r', *CENTER)} <= 10 OR {O.dist('b_q', 'b_r', *CENTER)} <= 10", "seams"))
def _(spark, d):
    pack = context.load_context(X.cells(spark, d), context.ContextConfig((CENTER,), 4, 30, include_seams=True, seam_radius=10), X.seams(spark, d))
    return pack.seams.select("id")


@register("assemble_cell_view", O.sql("""SELECT c.doc_id, (SELECT string_agg(facet_id || ':' || derived_content, '|' ORDER BY facet_id) FROM facets f WHERE f.key = c.key) AS facets,
   (SELECT string_agg(to_key || ':' || relation, '|' ORDER BY to_key, strlen(relation), relation) FROM edges e WHERE e.from_key = c.key) AS edges,
   (SELECT string_agg(id, '|' ORDER BY id) FROM seams s WHERE s.a_key = c.key OR s.b_key = c.key) AS seams FROM cells c WHERE c.q = 1 AND c.r = -1""", "cells", "facets", "edges", "seams"))
def _(spark, d):
    view = context.assemble_cell(X.cells(spark, d), (1, -1), context.AssembleOptions(True, True, True), facets=X.facets(spark, d), edges=X.edges(spark, d), seams=X.seams(spark, d))
    return view.select("doc_id", F.array_join(F.transform("facets", lambda x: F.concat_ws(":", x["facet_id"].cast("string"), x["derived_content"])), "|").alias("facets"), F.array_join(F.transform("edges", lambda x: F.concat_ws(":", x["to_key"].cast("string"), x["relation"])), "|").alias("edges"), F.array_join(F.transform("seams", lambda x: x["id"]), "|").alias("seams"))


@register("assemble_all_views", O.sql("""SELECT c.doc_id, coalesce(f.n, 0) AS n_facets, coalesce(e.n, 0) AS n_edges, coalesce(s.n, 0) AS n_seams FROM cells c LEFT JOIN (SELECT key, count(*) AS n FROM facets GROUP BY key) f USING (key)
   LEFT JOIN (SELECT from_key AS key, count(*) AS n FROM edges GROUP BY 1) e USING (key) LEFT JOIN (SELECT key, count(*) AS n FROM (SELECT a_key AS key FROM seams UNION ALL SELECT b_key FROM seams) GROUP BY key) s USING (key)""", "cells", "facets", "edges", "seams"))
def _(spark, d):
    views = context.assemble_cells(X.cells(spark, d), context.AssembleOptions(True, True, True), facets=X.facets(spark, d), edges=X.edges(spark, d), seams=X.seams(spark, d))
    return views.select("doc_id", *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(f"n_{c}") for c in ("facets", "edges", "seams")])


@register("fov_visible", O.fov("SELECT q, r, ring FROM VISIBLE", f"(SELECT q, r, CAST(ring AS INT) AS ring FROM {O.disk((1, 1), 0, 10)})", "blockers", (1, 1), 10, "ring", "blockers"))
def _(spark, d):
    return fov.field_of_view(spark, X.blockers(X.cells(spark, d)), (1, 1), 10).select("q", "r", "ring")


@register("load_context_fov", O.fov("SELECT doc_id, CAST(ring AS INT) AS ring FROM VISIBLE ORDER BY ring, q, r LIMIT 60", f"(SELECT doc_id, q, r, {O.dist('q', 'r', 1, 1)} AS ring FROM coords)", "blockers", (1, 1), 10, "doc_id, ring", "blockers"))
def _(spark, d):
    cells = X.cells(spark, d)
    return fov.load_context_fov(cells, X.blockers(cells), (1, 1), 10, 60).select("doc_id", "ring")


_EDGE = (20, 0)


@register("visible_hexes", O.fov("SELECT q, r FROM VISIBLE", "field", "empty", (16, 1), 6, "1 AS one", "coords", more=f"field AS {O.disk((16, 1), 0, 6)}, empty AS (SELECT q, r FROM field WHERE (q, r) NOT IN (SELECT (q, r) FROM coords))"))
def _(spark, d):
    return fov.visible_hexes(X.cells(spark, d), (16, 1), 6).select("q", "r")


@register("voronoi_partition", O.sql(f"""SELECT doc_id, seed_idx, CAST(d AS DOUBLE) AS cost FROM (SELECT doc_id, i AS seed_idx, {O.dist('q', 'r', 'sq', 'sr')} AS d FROM coords, {_SEED_ROWS}) WHERE d <= 8
   QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, seed_idx) = 1""", "coords"))
def _(spark, d):
    return fov.voronoi_partition(X.cells(spark, d), list(SEEDS), 8).select("doc_id", "seed_idx", "cost")


@register("load_context_voronoi", O.sql(f"""SELECT doc_id, seed_idx FROM (SELECT * FROM (SELECT doc_id, q, r, i AS seed_idx, {O.dist('q', 'r', 'sq', 'sr')} AS d FROM cells, {_SEED_ROWS} WHERE {O.valid(AT)}) WHERE d <= 6
   QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, seed_idx) = 1) QUALIFY row_number() OVER (PARTITION BY seed_idx ORDER BY d, q, r) <= 20""", "cells"))
def _(spark, d):
    return fov.load_context_voronoi(X.cells(spark, d), list(SEEDS), 6, 20, as_of=AT).select("doc_id", "seed_idx")


_WALK = f"""walk AS (SELECT i, sq AS q, sr AS r, 0.0::DOUBLE AS cost, 0 AS hops FROM {_SEED_ROWS} UNION SELECT i, w.q + a, w.r + b, cost + 1 + CASE WHEN (((w.q + a) * 3 + (w.r + b) * 5) % 4 + 4) % 4 = 0 THEN 2.5 ELSE 0 END, hops + 1
  FROM walk w, (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) t(a, b) WHERE hops < 5)"""


@register("voronoi_weighted", O.sql("SELECT CAST(q AS INT) AS q, CAST(r AS INT) AS r, i AS seed_idx, cost FROM walk QUALIFY row_number() OVER (PARTITION BY q, r ORDER BY cost, i, hops) = 1", more=_WALK, recursive=True))
def _(spark, d):
    weights = {(q, r): 2.5 for q in range(-20, 21) for r in range(-20, 21) if (q * 3 + r * 5) % 4 == 0}
    found = fov.voronoi_weighted(list(SEEDS), weights, 5)
    return spark.createDataFrame([(*c, i, cost) for c, (cost, i, _) in found.items()], "q int, r int, seed_idx int, cost double")


# Analytics and placement -----------------------------------------------------------------------------------------------


@register("tag_counts", O.sql("SELECT tag, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(tags) AS tag FROM cells) GROUP BY tag", "cells"))
def _(spark, d):
    return analytics.tag_counts(X.cells(spark, d))


@register("tag_cooccurrence", O.sql("SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.tag < b.tag GROUP BY ALL HAVING count(*) >= 5", "cells", more="t AS (SELECT DISTINCT doc_id, unnest(tags) AS tag FROM cells)"))
def _(spark, d):
    return analytics.tag_cooccurrences(X.cells(spark, d), 5)


_HEALTH = """SELECT (SELECT count(*) FROM present) AS cells, count(*) AS seams, count(*) FILTER (resolution_status = 'resolved') AS resolved, count(*) FILTER (resolution_status <> 'resolved') AS unresolved,
  count(*) FILTER (a_key NOT IN (SELECT key FROM present) OR b_key NOT IN (SELECT key FROM present)) AS orphaned_seams, (SELECT max(commit_seq) FROM versions) AS head_seq, (SELECT count(*) FROM versions) AS version_rows, (SELECT count(DISTINCT key) FROM versions) AS coords FROM seams"""


@register("health_check", O.sql(_HEALTH, "cells", "seams", "versions", more="present AS (SELECT * FROM cells WHERE doc_id % 7 <> 0)"))
def _(spark, d):
    return analytics.health(X.cells(spark, d).filter("doc_id % 7 <> 0"), X.seams(spark, d), X.cell_versions(spark, d))


@register("orphan_seams", O.sql("SELECT id FROM seams WHERE a_key NOT IN (SELECT key FROM present) OR b_key NOT IN (SELECT key FROM present)", "cells", "seams", more="present AS (SELECT * FROM cells WHERE doc_id % 7 <> 0)"))
def _(spark, d):
    return seam_ops.orphans(X.seams(spark, d), X.cells(spark, d).filter("doc_id % 7 <> 0"))


@register("free_placement", O.sql(f"SELECT q, r, n AS probes FROM {O.disk((0, 0), 0, 40)} WHERE (q, r) NOT IN (SELECT (q, r) FROM live) ORDER BY n LIMIT 1", "live"))
def _(spark, d):
    return placement.find_free(snapshot.snapshot(X.cell_versions(spark, d)), (0, 0), 40, must=False).select("q", "r", "probes")


@register("unused_placement", O.sql(f"SELECT q, r, n AS probes FROM {O.disk((0, 0), 0, 40)} WHERE (q, r) NOT IN (SELECT (q, r) FROM versions) ORDER BY n LIMIT 1", "versions"))
def _(spark, d):
    """No row if all coordinates of the disk have had a cell."""
    return placement.find_unused(X.cell_versions(spark, d), (0, 0), 40, must=False).select("q", "r", "probes")


@register("bulk_placement", O.sql(f"""SELECT b.vec_id, f.q, f.r FROM (SELECT q, r, row_number() OVER (ORDER BY n) AS k FROM {O.disk((0, 0), 0, 200)} WHERE (q, r) NOT IN (SELECT (q, r) FROM live)) f JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings) b USING (k)""", "live"))
def _(spark, d):
    """The vectors that find a place on the disk of 200 rings, as in the SQL; with ``must`` a disk that is too small is an error."""
    docs, taken = X.read(spark, d, "embeddings").select("vec_id"), snapshot.snapshot(X.cell_versions(spark, d))
    return placement.place_all(docs, taken, (0, 0), 200, "vec_id", must=False).select("vec_id", "q", "r")


@register("neighborhood_precision", O.sql(f"""SELECT a AS center, sum(CAST(same AS BIGINT))::BIGINT AS same, count(*) AS n FROM (SELECT x.vec_id AS a, x.label = y.label AS same FROM vectors x JOIN vectors y ON x.vec_id <> y.vec_id AND {O.dist('x.q', 'x.r', 'y.q', 'y.r')} <= 2
   QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY {O.spiral('y.q', 'y.r', ('x.q', 'x.r'))}) <= 8) GROUP BY a""", "vectors"))
def _(spark, d):
    docs = X.vectors(spark, d).select(F.col("vec_id").alias("id"), "q", "r", F.col("label").alias("topic"))
    return analytics.neighborhood_precision(docs, 8, 2)


@register("semantic_lattice_divergence", O.sql("SELECT round(0.5 * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 9) AS divergence FROM a FULL JOIN b USING (topic)", "cells", more="a AS (SELECT source_id AS topic, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS p FROM cells WHERE list_contains(tags, 'en') GROUP BY 1), b AS (SELECT source_id AS topic, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS p FROM cells WHERE list_contains(tags, 'toxic') GROUP BY 1)"))
def _(spark, d):
    cells = X.cells(spark, d)
    a, b = (cells.filter(F.array_contains("tags", t)).groupBy(F.col("source_id").alias("topic")).agg(F.count("*").alias("n")) for t in ("en", "toxic"))
    return analytics.total_variation(a, b).select(F.round("divergence", 9).alias("divergence"))


@register("useful_fraction", O.sql(f"""SELECT round(sum(CASE WHEN same THEN n_chars ELSE 0 END)::DOUBLE / sum(n_chars), 9) AS useful_fraction FROM (SELECT x.source = y.source AS same, y.n_chars FROM placed x JOIN placed y ON x.doc_id <> y.doc_id AND {O.dist('x.q', 'x.r', 'y.q', 'y.r')} <= 1)""", "placed"))
def _(spark, d):
    docs = X.at_spiral(X.read(spark, d, "documents"), F.col("doc_id")).select(F.col("doc_id").alias("id"), "q", "r", F.col("source").alias("topic"), F.col("n_chars").alias("n_bytes"))
    pairs = G.neighbors(docs.select("q", "r", F.col("topic").alias("center_topic"))).select("center_topic", F.col("neighbor_q").alias("q"), F.col("neighbor_r").alias("r")).join(docs, ["q", "r"])
    return analytics.useful_fraction(pairs).select(F.round("useful_fraction", 9).alias("useful_fraction"))


@register("coordinate_stability", "SELECT round(avg(CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 1.0 END), 9) AS stability FROM documents")
def _(spark, d):
    cells = X.cells(spark, d).select(F.col("doc_id").alias("id"), "q", "r")
    moved = cells.withColumn("q", F.when(F.col("id") % 4 == 0, F.col("q") + 1).otherwise(F.col("q")))
    return analytics.coordinate_stability(cells, moved).select(F.round("stability", 9).alias("stability"))


@register("latency_percentiles", "SELECT p AS percent, v[1 + (len(v) - 1) * p // 100] AS value FROM (SELECT list(value ORDER BY value) AS v FROM events), (VALUES (50), (95), (99)) t(p)")
def _(spark, d):
    return analytics.lower_percentile(X.read(spark, d, "events"), "value", [50, 95, 99])


# Writes and the changefeed ---------------------------------------------------------------------------------------------


@register("chat_cells", """SELECT conv_id, turn, array_to_string(CASE role WHEN 'user' THEN ['user-message', 'conversation'] WHEN 'assistant' THEN ['assistant-response', 'conversation'] ELSE ['system-prompt'] END, '|') AS tags,
   CASE role WHEN 'user' THEN conv_id || '/user' WHEN 'assistant' THEN conv_id || '/assistant' ELSE 'system/v1' END AS source_id, CASE role WHEN 'system' THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM conversations""")
def _(spark, d):
    turns = X.at_spiral(X.chat_turns(spark, d), F.col("turn")).withColumn("q", F.struct("conv_id", "turn"))
    session = F.col("conv_id").cast("string")
    parts = (
        S.user_message_cells(turns.filter("role = 'user'"), "text", session, 0.5, AT),
        S.assistant_response_cells(turns.filter("role = 'assistant'"), "text", session, 0.5, AT),
        S.system_prompt_cells(turns.filter("role not in ('user', 'assistant')"), "text", F.lit("v1"), AT),
    )
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("q.conv_id", "q.turn", F.array_join("tags", "|").alias("tags"), "source_id", "confidence")


@register("fact_cells", "SELECT doc_id, CASE WHEN lang IN ('de', 'fr', 'es') THEN 'fact|' || lang ELSE 'fact' END AS tags, source AS source_id FROM documents")
def _(spark, d):
    docs = X.read(spark, d, "documents").withColumn("q", F.col("doc_id")).withColumn("r", F.lit(0))
    out = S.fact_cells(docs.filter("lang is null or lang not in ('de', 'fr', 'es')"), "text", "source", "FACT", 0.9, AT)
    for lang in ("de", "fr", "es"):
        out = out.unionByName(S.fact_cells(docs.filter(F.col("lang") == lang), "text", "source", lang, 0.9, AT))
    return out.select(F.col("q").alias("doc_id"), F.array_join("tags", "|").alias("tags"), "source_id")


@register("batch_put_commits", "SELECT doc_id // 128 + 1 AS commit_seq, count(*) AS cells FROM documents GROUP BY 1")
def _(spark, d):
    from honeyframe.sources.store import batch_commits

    return batch_commits(X.cells(spark, d).drop("commit_seq"), "doc_id", 0).groupBy("commit_seq").agg(F.count("*").alias("cells"))


@register("delete_cascade", O.sql("""SELECT 'cells' AS family, count(*) AS n FROM cells WHERE doc_id % 10 <> 3 UNION ALL SELECT 'facets', count(*) FROM facets WHERE doc_id % 10 <> 3
   UNION ALL SELECT 'edges', count(*) FROM edges WHERE from_key NOT IN (SELECT key FROM gone) UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE key NOT IN (SELECT key FROM gone) UNION ALL SELECT 'seams', count(*) FROM seams""", "cells", "facets", "edges", "vectors", "seams", more="gone AS (SELECT key FROM cells WHERE doc_id % 10 = 3)"))
def _(spark, d):
    from honeyframe.sources.store import delete_cascade

    cells = X.cells(spark, d)
    families = {"cells": cells, "facets": X.facets(spark, d), "edges": X.edges(spark, d), "vectors": X.vectors(spark, d), "seams": X.seams(spark, d)}
    left = delete_cascade(families, cells.filter("doc_id % 10 = 3").select("key"))
    out = None
    for name, df in left.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("family"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("export_json", O.sql(f"SELECT doc_id, q, r, raw_content, source_id, confidence, array_to_string(tags, '|') AS tags FROM cells WHERE {O.dist('q', 'r', *CENTER)} <= 6", "cells"))
def _(spark, d):
    from honeyframe.sources.jsonio import export_cells, import_cells

    rows = import_cells(export_cells(X.cells(spark, d), CENTER, 6), "doc_id long")
    return rows.select("doc_id", "q", "r", "raw_content", "source_id", "confidence", F.array_join("tags", "|").alias("tags"))


@register("changefeed_since", O.sql("SELECT seq, op, q, r, payload, hash, encoded_len FROM changelog WHERE seq > 200 ORDER BY seq LIMIT 150", "changelog"))
def _(spark, d):
    from honeyframe.streaming.changefeed import read_since

    return read_since(X.changelog(spark, d), 200, 150).select("seq", "op", "q", "r", "payload", "hash", "encoded_len")


@register("changefeed_filtered", O.sql("SELECT seq, op, q, r FROM changelog WHERE seq > 50 AND op IN (6) AND key < 4096 ORDER BY seq LIMIT 80", "changelog"))
def _(spark, d):
    from honeyframe.streaming.changefeed import read_since

    return read_since(X.changelog(spark, d), 50, 80, ops=(6,), keys=F.col("key") < 4096).select("seq", "op", "q", "r")


@register("superhex_sync_replay", O.sql(f"SELECT CAST(pq AS INT) AS parent_q, CAST(pr AS INT) AS parent_r, count(*) AS occupied FROM {O.parents('live', 2, 'commit_seq')} GROUP BY pq, pr", "live"))
def _(spark, d):
    from honeyframe.streaming.superhex import SuperhexSync

    feed = X.changelog(spark, d)
    sync = SuperhexSync(spark, 2)
    last = feed.agg(F.max("seq")).first()[0] or 0
    for low in range(0, last, max(1, -(-last // 3))):  # three batches, as a stream would bring them
        high = low + max(1, -(-last // 3))
        sync.apply(feed.filter((F.col("seq") > low) & (F.col("seq") <= high)))
    return sync.summaries().select("parent_q", "parent_r", "occupied")


# The store ---------------------------------------------------------------------------------------------------------------

# Documents come in by commits of 128 in order of their ids; a last commit puts every tenth again.
_N = "(SELECT count(*) FROM documents)"
_LAST = f"(({_N} + 127) // 128 + 1)"
_PUTS = f"""puts AS (SELECT doc_id + 1 AS seq, doc_id // 128 + 1 AS commit_seq, doc_id, q, r, raw_content FROM cells
   UNION ALL SELECT {_N} + row_number() OVER (ORDER BY doc_id), {_LAST}, doc_id, q, r, 'again ' || raw_content FROM cells WHERE doc_id % 10 = 0)"""


@register("store_commits", O.sql("SELECT commit_seq, count(*) AS cells FROM puts GROUP BY ALL", "cells", more=_PUTS))
def _(spark, d):
    return X.store(spark, d).versions("cells").groupBy("commit_seq").agg(F.count("*").alias("cells"))


@register("store_head", O.sql("SELECT q, r, raw_content FROM puts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1", "cells", more=_PUTS))
def _(spark, d):
    return X.store(spark, d).view().select("q", "r", "raw_content")


@register("store_at_tag", O.sql("SELECT q, r, raw_content FROM cells", "cells"))
def _(spark, d):
    return X.store(spark, d).view_at_tag("loaded").select("q", "r", "raw_content")


@register("store_at_commit", O.sql("SELECT q, r, raw_content FROM cells WHERE doc_id < 256", "cells"))
def _(spark, d):
    return X.store(spark, d).snapshot("cells", 2).select("q", "r", "raw_content")


@register("store_diff", O.sql(f"SELECT 'cell' AS kind, commit_seq, q, r, 'put' AS op FROM puts WHERE commit_seq > 1 AND commit_seq <= {_LAST}", "cells", more=_PUTS))
def _(spark, d):
    store = X.store(spark, d)
    return store.diff(1, store.meta["head"]).select("kind", "commit_seq", "q", "r", "op")


@register("store_changefeed", O.sql("SELECT seq, 1 AS op, q, r, CASE WHEN strlen(raw_content) <= 4096 THEN raw_content END AS payload, sha256(raw_content) AS hash, strlen(raw_content) AS encoded_len FROM puts", "cells", more=_PUTS))
def _(spark, d):
    return X.store(spark, d).changelog().select("seq", "op", "q", "r", "payload", "hash", "encoded_len")


@register("store_outbox", O.sql("SELECT seq, q, r FROM puts WHERE seq > 150 ORDER BY seq LIMIT 300", "cells", more=_PUTS))
def _(spark, d):
    """What a consumer that stands at 150 reads next, by two bounded reads."""
    from honeyframe.streaming.changefeed import read_since

    feed = X.store(spark, d).changelog()
    first = cut(read_since(feed, 150, 200))
    last = first.agg(F.max("seq")).first()[0] or 150
    return first.unionByName(read_since(feed, last, 100)).select("seq", "q", "r")


@register("store_consumers", f"SELECT 'a' AS consumer, 100 AS seq UNION ALL SELECT 'b', {_N}")
def _(spark, d):
    store = X.store(spark, d)
    feed, now = store.changelog(), dict(store.consumers())
    for name, then in (("a", 100), ("b", store.view_at_tag("loaded").count())):
        store.advance_consumer(name, now.get(name, 0), now.get(name, 0))
        store.advance_consumer(name, now.get(name, 0), then)
    assert store.retention_floor() <= feed.count()
    return spark.createDataFrame(store.consumers(), "consumer string, seq long")


@register("store_tags", f"SELECT 'again' AS label, {_LAST} AS commit_seq UNION ALL SELECT 'loaded', {_LAST} - 1")
def _(spark, d):
    return spark.createDataFrame(X.store(spark, d).list_snapshot_tags(), "label string, commit_seq long")


@register("store_prune", O.sql(f"SELECT (SELECT count(*) FROM cells WHERE doc_id % 10 = 0) AS pruned, {_N} AS kept, {_LAST} AS oldest", "cells"))
def _(spark, d):
    """A fork of the store, in which a pass of a scheduler's size and one over all the rest leave one version of each cell."""
    from honeyframe.plans.lineage import checkpoint_dir

    other = X.store(spark, d).fork(f"{checkpoint_dir(spark)}/honeyframe-pruned-{X.uuid.uuid4().hex}")
    pruned = other.prune(other.meta["head"], 2048) + other.prune(other.meta["head"], None)
    return other.versions("cells").agg(F.lit(pruned).cast("long").alias("pruned"), F.count("*").alias("kept"), F.lit(other.oldest_snapshot_seq()).cast("long").alias("oldest"))


@register("store_superhex_sync", O.sql(f"SELECT CAST(pq AS INT) AS parent_q, CAST(pr AS INT) AS parent_r, count(*) AS occupied, max(seq) AS last_seq FROM {O.parents('newest', 2, 'seq')} GROUP BY pq, pr", "cells", more=_PUTS + ", newest AS (SELECT * FROM puts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1)"))
def _(spark, d):
    """Batches of the feed until nothing is left."""
    from honeyframe.streaming.superhex import SuperhexSync

    sync, feed = SuperhexSync(spark, 2), X.store(spark, d).changelog()
    size = max(256, -(-feed.count() // 4))
    while sync.sync(feed, size):
        pass
    return sync.summaries().select("parent_q", "parent_r", "occupied", "last_seq")


@register("store_import_json", O.sql(f"SELECT q, r, raw_content, source_id, array_to_string(tags, '|') AS tags, row_number() OVER (ORDER BY {O.spiral('q', 'r', CENTER)}) // 129 + 1 AS commit_seq FROM cells WHERE {O.dist('q', 'r', *CENTER)} <= 5", "cells"))
def _(spark, d):
    """A disk as JSON, read back into an empty store."""
    from honeyframe.plans.lineage import checkpoint_dir
    from honeyframe.sources.jsonio import export_cells, import_cells
    from honeyframe.sources.store import Store

    other = Store(spark, f"{checkpoint_dir(spark)}/honeyframe-import-{X.uuid.uuid4().hex}", max_value_bytes=1 << 31)
    other.import_cells(import_cells(export_cells(X.cells(spark, d), CENTER, 5)))
    return other.versions("cells").select("q", "r", "raw_content", "source_id", F.array_join("tags", "|").alias("tags"), "commit_seq")
