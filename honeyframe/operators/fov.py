"""Line of sight and nearest-seed partitions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from honeyframe.errors import InvalidArgument
from honeyframe.functions.geometry import NEIGHBORS, Coord, check_radius, disk, distance, near, pack_one
from honeyframe.functions.scalars import valid_at

MAX_FOV_RADIUS, MAX_VORONOI_RADIUS, MAX_SEEDS = 256, 64, 32
#: The corners of a hexagon around its center, in thirds of a step.
CORNERS = ((2, -1), (1, 1), (-1, 2), (-2, 1), (-1, -1), (1, -2))


def _cross(aq, ar, bq, br) -> Column:
    return aq * br - ar * bq


def visible(coords: DataFrame, blockers: DataFrame, center: Coord, radius: int) -> DataFrame:
    """Those of ``coords`` in the disk that no blocker hides.

    A coordinate is hidden if a blocker, neither itself nor the center, is nearer by straight distance and the direction
    to it lies within the closed angle that the blocker's corners span. A blocker is seen unless another hides it. Both
    sides are bounded by the disk, so the comparison runs against a broadcast table of blockers in whole numbers.
    """
    if radius < 0:
        return coords.limit(0)
    check_radius(center, radius, MAX_FOV_RADIUS)
    bq, br = F.col("q") - center[0], F.col("r") - center[1]
    own = blockers.filter(near("q", "r", center, radius)).select(bq.cast("long").alias("bq"), br.cast("long").alias("br")).distinct().filter("bq <> 0 or br <> 0")
    corners = F.array(*[F.struct((3 * F.col("bq") + a).alias("x"), (3 * F.col("br") + b).alias("y")) for a, b in CORNERS])
    own = own.withColumn("c", corners)
    left = F.get(F.filter("c", lambda v: F.forall("c", lambda o: _cross(v["x"], v["y"], o["x"], o["y"]) >= 0)), F.lit(0))
    right = F.get(F.filter("c", lambda v: F.forall("c", lambda o: _cross(o["x"], o["y"], v["x"], v["y"]) >= 0)), F.lit(0))
    own = own.select("bq", "br", (F.col("bq") * F.col("bq") + F.col("bq") * F.col("br") + F.col("br") * F.col("br")).alias("bd"), left["x"].alias("lx"), left["y"].alias("ly"), right["x"].alias("rx"), right["y"].alias("ry"))
    rows = coords.filter(near("q", "r", center, radius)).withColumn("_q", (F.col("q") - center[0]).cast("long")).withColumn("_r", (F.col("r") - center[1]).cast("long"))
    q, r = F.col("_q"), F.col("_r")
    hidden = (F.col("bd") < q * q + q * r + r * r) & (_cross(F.col("lx"), F.col("ly"), q, r) >= 0) & (_cross(q, r, F.col("rx"), F.col("ry")) >= 0)
    return rows.join(F.broadcast(own), hidden, "left_anti").drop("_q", "_r")


def field_of_view(spark, blockers: DataFrame, center: Coord, radius: int) -> DataFrame:
    """Every visible coordinate, whether it has a cell or not, by (distance, q, r)."""
    coords = disk(spark, center, max(radius, 0))
    return visible(coords, blockers, center, radius).orderBy("ring", "q", "r")


def visible_hexes(snap: DataFrame, center: Coord, radius: int) -> DataFrame:
    """What is seen where empty coordinates block the view."""
    coords = disk(snap.sparkSession, center, radius)
    empty = coords.join(snap.select("key"), "key", "left_anti").select("q", "r")
    return visible(coords, empty, center, radius).orderBy("ring", "q", "r")


def load_context_fov(snap: DataFrame, blockers: DataFrame, center: Coord, radius: int, max_cells: int = 0, as_of: int | None = None) -> DataFrame:
    """Visible cells, nearest first, by (distance, q, r); 256 of them by default."""
    rows = snap if as_of is None else snap.filter(valid_at(as_of))
    seen = visible(rows, blockers, center, radius).withColumn("ring", distance("q", "r", *center))
    return seen.orderBy("ring", "q", "r").limit(max_cells or 256)


def _seeds(seeds: list[Coord]) -> list[tuple[int, Coord]]:
    """Each seed once, with its first number."""
    if not seeds or len(seeds) > MAX_SEEDS:
        raise InvalidArgument("1 to 32 seeds are needed")
    first: dict[Coord, int] = {}
    for i, s in enumerate(seeds):
        pack_one(*s)
        first.setdefault(s, i)
    return [(i, s) for s, i in first.items()]


def voronoi_partition(coords: DataFrame, seeds: list[Coord], radius: int = 0) -> DataFrame:
    """Each of ``coords`` within reach of a seed with the nearest one: seed_idx, cost and hops; ties go to the first seed.

    Without weights cost and hops are the distance: one Column over at most 32 seeds, no join.
    """
    radius = radius or 4
    own = _seeds(seeds)
    if radius > MAX_VORONOI_RADIUS:
        raise InvalidArgument("the radius is out of bounds")
    reach = [F.when(near("q", "r", s, radius), F.struct(distance("q", "r", *s).alias("d"), F.lit(i).alias("i"))) for i, s in own]
    best = F.array_min(F.array_compact(F.array(*reach)))
    rows = coords.withColumn("_b", best).filter("_b is not null")
    return rows.withColumn("seed_idx", F.col("_b.i")).withColumn("cost", F.col("_b.d").cast("double")).withColumn("hops", F.col("_b.d")).drop("_b")


def voronoi_weighted(seeds: list[Coord], weights: dict[Coord, float], radius: int = 0) -> dict[Coord, tuple[float, int, int]]:
    """Owner of each coordinate as (cost, seed, hops): entering a hexagon costs 1 and its weight, in at most ``radius`` steps.

    Costs are summed exactly. At most 32 seeds' disks of radius 64 are walked, on the driver. In each layer of steps a
    state is kept for each seed where it is cheaper than that seed's states of fewer steps: those alone can reach further.
    """
    radius = radius or 4
    own = _seeds(seeds)
    if radius > MAX_VORONOI_RADIUS or any(not (0 <= w < float("inf")) for w in weights.values()):
        raise InvalidArgument("weights are finite and not negative, and the radius is bounded")
    enter = {c: 1 + Fraction(w) for c, w in weights.items() if w}
    best: dict[tuple[int, Coord], Fraction] = {(i, s): Fraction(0) for i, s in own}
    owner: dict[Coord, tuple[Fraction, int, int]] = {}
    layer = dict(best)
    for hops in range(radius + 1):
        for (i, c), cost in layer.items():
            if c not in owner or (cost, i, hops) < owner[c]:
                owner[c] = cost, i, hops
        after: dict[tuple[int, Coord], Fraction] = {}
        for (i, (q, r)), cost in layer.items():
            for dq, dr in NEIGHBORS:
                c = q + dq, r + dr
                if max(map(abs, (*c, sum(c)))) > (1 << 18) - 1:
                    continue
                total = cost + enter.get(c, 1)
                if total < best.get((i, c), total + 1):
                    best[i, c] = after[i, c] = total
        layer = after
    return {c: (float(cost), i, hops) for c, (cost, i, hops) in owner.items()}


def load_context_voronoi(snap: DataFrame, seeds: list[Coord], radius: int = 0, per_seed: int = 0, weights: dict[Coord, float] | None = None, as_of: int | None = None) -> DataFrame:
    """Cells of each seed's region, by (cost, seed, hops, q, r), at most ``per_seed`` (64 by default) for each."""
    from pyspark.sql import Window

    rows = snap if as_of is None else snap.filter(valid_at(as_of))
    if weights:
        found = voronoi_weighted(seeds, weights, radius)
        table = snap.sparkSession.createDataFrame([(pack_one(*c), i, cost, hops) for c, (cost, i, hops) in found.items()], "key long, seed_idx int, cost double, hops int")
        rows = rows.join(F.broadcast(table), "key")  # bounded by the seeds' disks
    else:
        rows = voronoi_partition(rows, seeds, radius)
    place = F.row_number().over(Window.partitionBy("seed_idx").orderBy("cost", "hops", "q", "r"))
    return rows.withColumn("place", place).filter(F.col("place") <= (per_seed or 64))


def voronoi_region(owned: DataFrame, seed_idx: int) -> DataFrame:
    return owned.filter(F.col("seed_idx") == seed_idx)
