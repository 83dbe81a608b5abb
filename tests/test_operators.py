"""Operators on small tables of their own, against rules written out plainly."""

import math
import random

import pytest
from pyspark.sql import functions as F

from honeyframe import errors as E
from honeyframe.functions.geometry import NEIGHBORS, morton, pack_one
from honeyframe.operators import fov, graph, placement, query, seams, snapshot, vector
from honeyframe.operators.query import CellQuery

CELL = "q int, r int, key long, raw_content string, source_id string, confidence double, valid_from long, valid_to long, tags array<string>"


def cells(spark, rows):
    return spark.createDataFrame([(q, r, pack_one(q, r), text, src, conf, vf, None, tags) for q, r, text, src, conf, vf, tags in rows], CELL)


@pytest.mark.parametrize("sort", query.SORTS)
def test_capped_is_a_prefix(spark, sort):
    snap = cells(spark, [(i - 8, 0, "same text", "s", (i % 3) / 3, i % 4, ["shared"]) for i in range(16)])
    for q in (CellQuery("same", sort_by=sort), CellQuery(center=(0, 0), radius=9, sort_by=sort)):
        whole = [x.key for x in query.query_cells(snap, q).collect()]
        for n in (1, 5, 16):
            from dataclasses import replace

            assert [x.key for x in query.query_cells(snap, replace(q, max_results=n)).collect()] == whole[:n]


def test_query_bounds(spark):
    for bad in (CellQuery(radius=129), CellQuery(sort_by="x"), CellQuery(embedding=(1.0,), max_scan_rows=5), CellQuery(embedding_candidate_limit=10_001)):
        with pytest.raises(E.InvalidArgument):
            bad.validate()


def test_budget_boundary(spark):
    snap = cells(spark, [(i, 0, "x", "s", 1.0, None, []) for i in range(5)]).withColumn("commit_seq", F.lit(1))
    assert not query.budget_reached(snap, snap, CellQuery(max_scan_rows=5)) and query.budget_reached(snap, snap, CellQuery(max_scan_rows=4))


def test_widening_finds_the_only_match(spark):
    rows = [(i, 0, "t", "s", 0.5, None, ["keep"] if i == 50 else ["no"]) for i in range(60)]
    vectors = spark.createDataFrame([(i, 0, pack_one(i, 0), [float(100 - i), 0.0]) for i in range(60)], "q int, r int, key long, embedding array<float>")
    q = CellQuery(require_tags=("keep",), max_results=1, embedding=(1.0, 0.0))
    assert [x.q for x in vector.query_cells(cells(spark, rows), vectors, q, "dot").collect()] == [50]
    with pytest.raises(E.DimensionMismatch):
        vector.search(vectors, [1.0], 1)


def test_similarities(spark):
    from honeyframe.functions.scalars import cosine, dot, l2_similarity

    row = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(cosine("a", "b"), dot("a", "b"), l2_similarity("a", "b"), cosine("a", "z")).first()
    assert row[0] == pytest.approx(11 / math.sqrt(5) / 5) and row[1] == 11 and row[2] == pytest.approx(-math.sqrt(8)) and row[3] == 0


def seam_rows(spark, links):
    c = lambda n: (n, 0, pack_one(n, 0))
    return spark.createDataFrame([(f"{i:04d}", *c(a), *c(b), "supersedes", "", None, None) for i, (a, b) in enumerate(links)], "id string, a_q int, a_r int, a_key long, b_q int, b_r int, b_key long, seam_type string, resolution_status string, valid_from long, valid_to long")


def test_supersession_chains(spark):
    snap = cells(spark, [(i, 0, "x", "s", 1.0, None, []) for i in range(40)])
    sixteen = [(i, i + 1) for i in range(16)]
    found = {x.q: x.target_q for x in seams.resolve_supersession(snap, seam_rows(spark, sixteen)).collect()}
    assert found[0] == 16 and found[15] == 16
    seventeen = {x.q: x.target_q for x in seams.resolve_supersession(snap, seam_rows(spark, [*sixteen, (16, 17)])).collect()}
    assert seventeen[0] is None and seventeen[1] == 17
    cycle = {x.q: x.target_q for x in seams.resolve_supersession(snap, seam_rows(spark, [(1, 2), (2, 1), (3, 2), (5, 99)])).collect()}
    assert cycle == {1: None, 2: None, 3: None, 5: None}


def edges(spark, rows):
    return spark.createDataFrame([(*a, pack_one(*a), *b, pack_one(*b), rel, w) for a, b, rel, w in rows], "from_q int, from_r int, from_key long, to_q int, to_r int, to_key long, relation string, weight double")


def test_paths(spark):
    e = edges(spark, [((0, 0), (1, 0), "x", 10.0), ((0, 0), (1, 0), "cheap", 2.0), ((1, 0), (2, 0), "route", 2.0), ((0, 0), (2, 0), "direct", 9.0), ((2, 0), (0, 0), "back", 0.0)])
    assert graph.find_path(e, (0, 0), (2, 0)) == [(0, 0), (1, 0), (2, 0)]
    assert graph.find_path(e, (0, 0), (2, 0), "direct, x") == [(0, 0), (2, 0)]
    assert graph.find_path(e, (1, 0), (9, 9)) is None and graph.find_path(e, (4, 4), (4, 4)) == [(4, 4)]
    assert [(x.q, x.level) for x in graph.walk(e, (0, 0), max_hops=1).collect()] == [(0, 0), (1, 1), (2, 1)]
    with pytest.raises(E.ScanLimit):
        graph.find_path(e, (0, 0), (2, 0), max_edge_rows=2)


def hidden_by_clipping(b, t):
    """Whether the segment from the origin to t meets the closed hexagon of b, in exact arithmetic."""
    from fractions import Fraction as Q

    corners = [(3 * b[0] + x, 3 * b[1] + y) for x, y in ((2, -1), (1, -2), (-1, -1), (-2, 1), (-1, 2), (1, 1))]
    low, high, end = Q(0), Q(1), (3 * t[0], 3 * t[1])
    area = sum(corners[i][0] * corners[(i + 1) % 6][1] - corners[i][1] * corners[(i + 1) % 6][0] for i in range(6))
    sign = 1 if area > 0 else -1
    for i in range(6):
        (ax, ay), (bx, by) = corners[i], corners[(i + 1) % 6]
        c0, slope = sign * ((bx - ax) * -ay + (by - ay) * ax), sign * ((bx - ax) * end[1] - (by - ay) * end[0])
        if slope == 0:
            if c0 < 0:
                return False
        elif slope > 0:
            low = max(low, Q(-c0, slope))
        else:
            high = min(high, Q(-c0, slope))
    return low <= high


def test_sight_against_exact_clipping(spark):
    rng = random.Random(6)
    d2 = lambda c: c[0] ** 2 + c[0] * c[1] + c[1] ** 2
    disk = [(q, r) for q in range(-4, 5) for r in range(-4, 5) if max(abs(q), abs(r), abs(q + r)) <= 4]
    for _ in range(3):
        blocked = {c for c in disk if rng.random() < 0.2}
        want = {t for t in disk if not any(b not in ((0, 0), t) and d2(b) < d2(t) and hidden_by_clipping(b, t) for b in blocked)}
        got = fov.field_of_view(spark, spark.createDataFrame(sorted(blocked) or [(9, 9)], "q int, r int"), (0, 0), 4).collect()
        assert {(x.q, x.r) for x in got} == want


def test_weighted_partition_against_all_paths():
    rng = random.Random(8)
    for _ in range(6):
        ring = rng.randint(1, 3)
        seeds = [(rng.randint(-2, 2), rng.randint(-2, 2)) for _ in range(2)]
        weights = {(q, r): rng.choice((0, 0.5, 1.5)) for q in range(-6, 7) for r in range(-6, 7)}
        best = {}

        def go(c, cost, i, left, hops):
            if c not in best or (cost, i, hops) < best[c]:
                best[c] = cost, i, hops
            if left:
                for dq, dr in NEIGHBORS:
                    n = c[0] + dq, c[1] + dr
                    go(n, cost + 1 + weights.get(n, 0), i, left - 1, hops + 1)

        for i, s in enumerate(seeds):
            if s not in seeds[:i]:
                go(s, 0.0, i, ring, 0)
        assert fov.voronoi_weighted(seeds, weights, ring) == best


def test_prune_keeps_the_state(spark):
    versions = spark.createDataFrame([(1, s, s == 4) for s in (1, 2, 4, 7)] + [(2, 3, False)], "key long, commit_seq long, deleted boolean")
    kept, gone = snapshot.prune(versions, 5, 10)
    assert sorted(x.commit_seq for x in gone.collect()) == [1, 2]
    for seq in (5, 7):
        assert sorted(snapshot.snapshot(kept, seq).collect()) == sorted(snapshot.snapshot(versions, seq).collect())
    assert snapshot.prune_plan(100, 30) == (70, 2048) and snapshot.prune_plan(10, 0) is None
    assert snapshot.PruneScheduler(3, "low-latency").tick(versions)[1].count() == 2


def test_placement(spark):
    taken = cells(spark, [(0, 0, "x", "s", 1.0, None, []), (1, 0, "x", "s", 1.0, None, [])])
    row = placement.find_free(taken, (0, 0), 2).first()
    assert (row.q, row.r, row.probes) == (1, -1, 2)
    with pytest.raises(E.NoFreePlacement):
        placement.find_free(taken, (0, 0), 0)
    assert placement.place_many([("a", (0, 0)), ("b", (0, 0)), ("c", (1, 0))], set(), 3) == [("a", (0, 0)), ("b", (1, 0)), ("c", (2, 0))]


def test_placement_on_a_full_disk(spark, tmp_path):
    """The registered queries give what their SQL gives where every coordinate of the disk has had a cell: no row."""
    import duckdb

    from honeyframe.plans.catalog import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, i AS user_id, CASE WHEN i = 4920 THEN 'error' ELSE 'view' END AS event_type FROM range(4921) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name, n in (("unused_placement", 0), ("free_placement", 1)):
        got, want = QUERIES[name](spark, str(tmp_path)).collect(), con.execute(ORACLE_SQL[name]).fetchall()
        assert [tuple(x) for x in got] == want and len(got) == n
    full = spark.range(7).selectExpr("element_at(array(0, 1, 1, 0, -1, -1, 0), cast(id + 1 as int)) q", "element_at(array(0, 0, -1, -1, 0, 1, 1), cast(id + 1 as int)) r").withColumn("key", morton("q", "r"))
    assert placement.find_unused(full, (0, 0), 1, must=False).count() == 0
    with pytest.raises(E.NoFreePlacement):
        placement.find_unused(full, (0, 0), 1)


def test_bulk_placement_beyond_128_rings(spark, tmp_path):
    """The query equals its SQL with more documents than a disk of 128 rings holds; the operator places all on a wider disk."""
    import duckdb

    from honeyframe.functions.geometry import spiral_offset
    from honeyframe.plans.catalog import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, i AS user_id, CASE WHEN i % 5 = 0 THEN 'error' ELSE 'view' END AS event_type FROM range(90000) t(i)")
    con.execute("CREATE TABLE embeddings AS SELECT 3 * i AS vec_id FROM range(50000) t(i)")
    for name in ("events", "embeddings"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = sorted(tuple(x) for x in QUERIES["bulk_placement"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLE_SQL["bulk_placement"]).fetchall()) and len(got) == 120601 - 72000
    docs, taken = spark.range(50000), spark.range(90000).selectExpr("cast(id as int) q", "0 r").withColumn("key", morton("q", "r"))
    with pytest.raises(E.NoFreePlacement):
        placement.place_all(docs, taken, (4, 5), 128)
    placed = placement.place_all(docs, taken, (4, 5), 260).select("id", "q", "r").collect()
    free = (at for at in ((4 + q, 5 + r) for q, r in map(spiral_offset, range(60000))) if not (at[1] == 0 and at[0] >= 0))
    assert sorted((x.id, (x.q, x.r)) for x in placed) == list(enumerate(at for at, _ in zip(free, range(50000), strict=False)))


def test_goal_directed_paths_against_dijkstra(spark):
    """Costs to everything, and to one goal with and without a lower bound of the rest, on a random graph with parallel edges."""
    import heapq

    from honeyframe.functions.scalars import hex_heuristic

    rng = random.Random(9)
    at = [(rng.randint(-6, 6), rng.randint(-6, 6)) for _ in range(40)]
    dist = lambda a, b: (abs(a[0] - b[0]) + abs(a[1] - b[1]) + abs(a[0] - b[0] + a[1] - b[1])) // 2
    links = [(a, b, "r", float(max(dist(a, b), 1) + rng.randint(0, 3))) for a in at for b in rng.sample(at, 4) if a != b]
    edges = spark.createDataFrame([(*a, pack_one(*a), *b, pack_one(*b), r, w) for a, b, r, w in links], "from_q int, from_r int, from_key long, to_q int, to_r int, to_key long, relation string, weight double")
    best, queue = {}, [(0.0, at[0])]
    while queue:
        cost, x = heapq.heappop(queue)
        if x not in best:
            best[x] = cost
            for a, b, _, w in links:
                if a == x:
                    heapq.heappush(queue, (cost + w, b))
    got = {(x.q, x.r): x.cost for x in graph.shortest_paths(edges, at[0]).collect()}
    assert got == best
    for goal in (at[5], at[20]):
        for h in (None, hex_heuristic):
            path = graph.find_path(edges, at[0], goal, heuristic=h)
            if goal in best:
                cost = sum(min(w for a, b, _, w in links if (a, b) == step) for step in zip(path, path[1:], strict=False))
                assert path[0] == at[0] and path[-1] == goal and cost == best[goal]
            else:
                assert path is None
    assert graph.find_path(edges, at[0], (60, 60)) is None


def test_listings_and_their_budget(spark):
    snap = cells(spark, [(i, 0, "x", "s", 1.0, None, ["b", "a" * (i % 2 + 1)]) for i in range(10)])
    assert query.list_cells(snap, 3).count() == 3 and query.list_cells(snap, 0).count() == 0
    assert query.list_cells(snap, 10, 10).count() == 10 and query.list_cells(snap, 4, 4).count() == 4
    with pytest.raises(E.ScanLimit) as error:
        query.list_cells(snap, 9, 5)
    assert error.value.partial.count() == 5
    assert [x.tag for x in query.topics(snap).collect()] == ["a", "aa", "b"] and [x.tag for x in query.distinct_tags(snap).collect()] == ["a", "b", "aa"]


def test_seam_budgets(spark):
    rows = spark.createDataFrame([(f"{i}", 0, 0, 0, i, 0, i, "", None, None) for i in range(6)], "id string, a_q int, a_r int, a_key long, b_q int, b_r int, b_key long, resolution_status string, valid_from long, valid_to long")
    assert seams.find_seams(rows, (0, 0), 1, most=6, most_rows=6).count() == 6
    for bounds in ({"most": 5}, {"most_rows": 5}):
        with pytest.raises(E.ScanLimit):
            seams.find_seams(rows, (0, 0), 1, **bounds)
    new = seams.mark_supersedes(rows, "id", "newer", 7).filter("id = '3'").first()
    assert (new.seam_type, new.a_q, new.b_q, new.reason, new.detected_at) == ("supersedes", 0, 3, "newer", 7)


def test_vectors_by_a_callers_function(spark):
    snap = cells(spark, [(i, 0, "x" * i, "s", 1.0, None, []) for i in range(5)])
    made = vector.reindex(snap, lambda texts: [[float(len(t)), 1.0] if t else None for t in texts])
    assert sorted((x.q, list(x.embedding)) for x in made.collect()) == [(i, [float(i), 1.0]) for i in range(1, 5)]
    assert vector.default_effort(10, 64) == 100 and vector.default_effort(100, 64) == 200 and vector.default_effort(1, 4096) == 400
    for count, most in ((11, 10), (1, 0), (1, 20_001)):
        with pytest.raises(E.InvalidArgument):
            vector.check_rebuild(count, most)
    index = vector.build_index(made, 3)
    assert vector.publish_index(index, 3).revision == 3
    with pytest.raises(E.IndexChanged):
        vector.publish_index(index, 4)


def test_index_is_fitted_on_a_spread_sample(spark, monkeypatch):
    """Beyond ``sample`` vectors centers are fitted on about so many, not in one task; every vector is indexed and found."""
    from pyspark.ml.clustering import KMeans

    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df, *more: seen.append((df.rdd.getNumPartitions(), df.count())) or fit(self, df, *more))
    rng = random.Random(5)
    rows = [(i, 0, pack_one(i, 0), [rng.gauss(0, 1) for _ in range(8)]) for i in range(2000)]
    made = spark.createDataFrame(rows, "q int, r int, key long, embedding array<float>")
    asked = made.filter("q % 200 = 0").select(F.col("key").alias("query_id"), "embedding")
    for metric in ("cosine", "dot", "l2"):
        index = vector.build_index(made, 1, lists=20, sample=500, metric=metric)
        assert seen[-1][0] > 1 and 400 < seen[-1][1] < 600
        assert index.rows.select("key").distinct().count() == index.count == 2000
        found = {(x.query_id, x.rank): x.key for x in index.search_many(asked, 5, effort=10_000, block=4).collect()}
        for row in asked.collect():
            assert [found[row.query_id, n] for n in range(1, 6)] == [x.key for x in vector.search(made, row.embedding, 5, metric=metric).collect()]


def test_index_is_fitted_by_matrix_products(spark, monkeypatch):
    """Spark's k-means only starts, on as many partitions as its rows need; what follows ends with each center the mean of its rows."""
    from pyspark.ml.clustering import KMeans

    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df, *more: seen.append((df.rdd.getNumPartitions(), self.getMaxIter())) or fit(self, df, *more))
    rng = random.Random(6)
    rows = [(i, 0, pack_one(i, 0), [rng.gauss(10 * (i % 3 == j), 0.5) for j in range(3)]) for i in range(300)]
    made = spark.createDataFrame(rows, "q int, r int, key long, embedding array<float>")
    for metric in ("cosine", "l2"):
        index = vector.build_index(made, 1, lists=3, metric=metric)
        assert seen[-1] == (2, 1)
        held = [(x["list"], x.embedding) for x in index.rows.select("list", "embedding").collect()]
        for n, center in enumerate(index.centers):
            own = [v if metric == "l2" else [x / math.hypot(*v) for x in v] for at, v in held if at == n]
            assert own and max(abs(sum(x) / len(own) - c) for x, c in zip(zip(*own, strict=True), center, strict=True)) < 1e-3


def test_near_ties_go_by_key_within_a_task(spark):
    """Scores that nine digits don't tell apart are ranked by key, as SQL does, also where a task keeps only its best."""
    rows = [(key, [1.0, 1e-6 * (5 - key)]) for key in range(1, 6)]  # the greatest key has the greatest score, by 1e-11
    made = spark.createDataFrame(rows, "key long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [x.key for x in vector.search_many(made, asked, 2).orderBy("rank").collect()] == [1, 2]


def test_prompts_views_and_heuristics(spark):
    from honeyframe.functions import scalars
    from honeyframe.operators import context, spatial

    snap = cells(spark, [(0, 0, "one two three", "s", 0.9, None, []), (1, 0, "four five six seven", "s", 0.8, None, []), (2, 0, "eight", "s", 0.7, None, [])])
    assert [x.q for x in context.fit_prompt(snap, 4)] == [0, 2] and context.fit_prompt(snap, 0) == []
    assert context.filter_views(snap).count() == 3 and context.filter_views(snap, F.col("confidence") > 0.75).count() == 2
    row = spark.range(1).select(scalars.hex_heuristic(F.lit(0), F.lit(0), F.lit(2), F.lit(-1)).alias("hex"), scalars.euclidean_heuristic(F.lit(0), F.lit(0), F.lit(2), F.lit(-1)).alias("straight"), scalars.uniform_cost().alias("one")).first()
    assert (row.hex, row.one) == (2.0, 1.0) and row.straight == pytest.approx(math.sqrt(3))
    drawn = spatial.render_occupied(snap, (0, 0), 2)
    assert drawn.count("*") == 3 and drawn.count(".") == 16
