import random

import pytest
from pyspark.sql import functions as F

from honeyframe.errors import InvalidArgument
from honeyframe.functions import geometry as G


def walk(radius):
    """Rings step by step: from (k, 0) six sides, each along the next direction."""
    out = [(0, 0)]
    for k in range(1, radius + 1):
        q, r = k, 0
        for side in range(6):
            dq, dr = G.NEIGHBORS[(side + 2) % 6]
            for _ in range(k):
                out.append((q, r))
                q, r = q + dq, r + dr
    return out


def test_spiral_is_the_walk(spark):
    want = walk(12)
    rows = G.disk(spark, (0, 0), 12).orderBy("spiral").collect()
    assert [(x.q, x.r) for x in rows] == want == [G.spiral_offset(n) for n in range(len(want))]
    q, r = G.spiral_inverse("spiral")
    bad = G.disk(spark, (5, -9), 20).withColumn("n", G.spiral("q", "r", (5, -9))).withColumn("a", q + 5).withColumn("b", r - 9).filter("n <> spiral or a <> q or b <> r")
    assert bad.isEmpty()


def test_morton_round_trip(spark):
    rng = random.Random(4)
    coords = [(rng.randint(-(1 << 17), 1 << 17), rng.randint(-(1 << 17), (1 << 17) - 1)) for _ in range(300)] + [(0, 0), (G.MAX_COORD, 0), (-G.MAX_COORD, 0), (0, -G.MAX_COORD)]
    a, b = G.unpack("key")
    rows = spark.createDataFrame(coords, "q int, r int").withColumn("key", G.morton("q", "r")).withColumn("a", a).withColumn("b", b).collect()
    assert all(x.key == G.pack_one(x.q, x.r) and (x.a, x.b) == (x.q, x.r) for x in rows)
    assert spark.createDataFrame([(G.MAX_COORD, 1)], "q int, r int").select(G.morton("q", "r")).first()[0] is None
    with pytest.raises(InvalidArgument):
        G.pack_one(G.MAX_COORD, 1)


def test_superhex_children_have_their_parent(spark):
    q, r = G.superhex_parent("child_q", "child_r")
    rows = G.superhex_children(G.disk(spark, (3, -2), 9)).withColumn("pq", q).withColumn("pr", r)
    assert rows.filter("pq <> q or pr <> r").isEmpty() and rows.select("child_q", "child_r").distinct().count() == rows.count()


def test_coarsen_undoes_refine(spark):
    q, r = G.coarsen("child_q", "child_r", 3)
    assert G.refine(G.disk(spark, (0, 0), 4), 3).filter((q != F.col("q")) | (r != F.col("r"))).isEmpty()
    with pytest.raises(InvalidArgument):
        G.coarsen("q", "r", 1)


def test_bounds():
    with pytest.raises(InvalidArgument):
        G.check_radius((0, 0), 129)
    with pytest.raises(InvalidArgument):
        G.check_radius((G.MAX_COORD, 0), 1)


def test_render():
    text = G.render_grid((0, 0), 1, lambda c: "x" if c == (0, 0) else "longer")
    assert text.splitlines()[1].startswith("[longe]") and "[x]" in text.splitlines()[1] and G.render_grid((0, 0), -1) == ""
