"""Hexagonal geometry as Column expressions; axial coordinates (q, r), third cube coordinate s = -q - r."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from honeyframe.errors import InvalidArgument

#: Legal coordinates have |q|, |r| and |s| up to this.
MAX_COORD = (1 << 18) - 1
MAX_RADIUS = 128
MAX_SEAM_RADIUS = 64
#: The six steps to a neighbour, in order.
NEIGHBORS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
Coord = tuple[int, int]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def cube_s(q, r) -> Column:
    return -_c(q) - _c(r)


def distance(q1, r1, q2, r2) -> Column:
    dq, dr = _c(q1) - _c(q2), _c(r1) - _c(r2)
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("int")


def in_bounds(q, r) -> Column:
    q, r = _c(q), _c(r)
    return (F.abs(q) <= MAX_COORD) & (F.abs(r) <= MAX_COORD) & (F.abs(q + r) <= MAX_COORD)


def near(q, r, center: Coord, radius: int) -> Column:
    """Within ``radius`` of a fixed center. The bounding box comes first: Parquet row groups are skipped by it."""
    q, r = _c(q), _c(r)
    box = q.between(center[0] - radius, center[0] + radius) & r.between(center[1] - radius, center[1] + radius)
    return box & (distance(q, r, *center) <= radius)


def _zigzag(x: Column) -> Column:
    x = x.cast("long")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def _spread(x: Column) -> Column:
    """Bits three apart: binary digits read as octal ones, which names ``x`` only once however far they go."""
    return F.conv(F.bin(x), 8, 10).cast("long")


def morton(q, r) -> Column:
    """Key of a coordinate: the zigzag codes of q, r and s interleaved. Never negative; null outside the legal range."""
    q, r = _c(q), _c(r)
    parts = [_spread(_zigzag(x)) for x in (q, r, -q - r)]
    return F.when(in_bounds(q, r), parts[0].bitwiseOR(F.shiftleft(parts[1], 1)).bitwiseOR(F.shiftleft(parts[2], 2)))


def unpack(key) -> tuple[Column, Column]:
    """q and r of a key; null for a key that no legal coordinate has."""
    key = _c(key)

    def gather(at: int) -> Column:
        bits = [F.shiftleft(F.shiftright(key, 3 * i + at).bitwiseAND(F.lit(1)), i) for i in range(20)]
        z = reduce(Column.bitwiseOR, bits)
        return F.shiftright(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1)))

    q, r = gather(0), gather(1)
    good = morton(q, r) == key
    return F.when(good, q).cast("int"), F.when(good, r).cast("int")


def pack_one(q: int, r: int) -> int:
    """morton() of one coordinate, on the driver."""
    if max(abs(q), abs(r), abs(q + r)) > MAX_COORD:
        raise InvalidArgument(f"({q}, {r}) is outside the lattice")
    key = 0
    for at, x in enumerate((q, r, -q - r)):
        z = 2 * x if x >= 0 else -2 * x - 1
        key |= sum((z >> i & 1) << 3 * i + at for i in range(21))
    return key


def ring_position(dq, dr) -> Column:
    """Place of an offset in the walk around its ring, from 0."""
    dq, dr = _c(dq), _c(dr)
    k = ring_number(dq, dr)
    return (
        F.when(k == 0, 0)
        .when((dq == k) & (dr > -k), -dr)
        .when((dr == -k) & (dq > 0), 2 * k - dq)
        .when((-dq - dr == k) & (dq > -k), 2 * k - dq)
        .when((dq == -k) & (dr < k), 3 * k + dr)
        .otherwise(5 * k + dq)
    )


def ring_number(dq, dr) -> Column:
    return distance(dq, dr, 0, 0)


def spiral(q, r, center: Coord | tuple = (0, 0)) -> Column:
    """Place of a coordinate in the walk of rings 0, 1, 2, ... around a center: the order of every spatial read."""
    dq, dr = _c(q) - _c(center[0]), _c(r) - _c(center[1])
    k = ring_number(dq, dr).cast("long")
    return F.when(k == 0, F.lit(0).cast("long")).otherwise(1 + 3 * k * (k - 1) + ring_position(dq, dr))


def spiral_inverse(n) -> tuple[Column, Column]:
    """The offset (dq, dr) at a place of the spiral."""
    n = _c(n).cast("long")
    k = F.when(n == 0, 0).otherwise(F.floor((F.sqrt(12.0 * n - 3) + 3) / 6)).cast("long")
    p = F.when(k == 0, 0).otherwise(n - 1 - 3 * k * (k - 1))
    side = F.when(k == 0, 0).otherwise(F.floor(p / F.greatest(k, F.lit(1))))
    j = F.when(k == 0, 0).otherwise(p - side * k)
    q = F.when(k == 0, 0).when(side == 0, k).when(side == 1, k - j).when(side == 2, -j).when(side == 3, -k).when(side == 4, j - k).otherwise(j)
    r = F.when(k == 0, 0).when(side == 0, -j).when(side == 1, -k).when(side == 2, j - k).when(side == 3, j).when(side == 4, k).otherwise(k - j)
    return q.cast("int"), r.cast("int")


def floor_div(x, by: int) -> Column:
    """Whole division by a positive number that rounds down; exact for any bigint."""
    x = _c(x)
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def coarsen(q, r, factor: int, levels: int = 1) -> tuple[Column, Column]:
    """The parallelogram of factor x factor coordinates that holds (q, r), so many levels up."""
    if factor < 2 or levels < 1:
        raise InvalidArgument("factor must be 2 or more and levels 1 or more")
    q, r = _c(q), _c(r)
    for _ in range(levels):
        q, r = floor_div(q, factor), floor_div(r, factor)
    return q.cast("int"), r.cast("int")


def refine(df: DataFrame, factor: int, q: str = "q", r: str = "r") -> DataFrame:
    """Each coarse coordinate's factor x factor fine ones, as child_q and child_r."""
    if factor < 2:
        raise InvalidArgument("factor must be 2 or more")
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = df.withColumn("_dq", F.explode(steps)).withColumn("_dr", F.explode(steps))
    return out.withColumn("child_q", F.col(q) * factor + F.col("_dq")).withColumn("child_r", F.col(r) * factor + F.col("_dr")).drop("_dq", "_dr")


def superhex_parent(q, r, levels: int = 1) -> tuple[Column, Column]:
    """The super-hexagon of seven that holds (q, r), so many levels up; none for levels <= 0."""
    q, r = _c(q).cast("long"), _c(r).cast("long")
    for _ in range(max(levels, 0)):
        # A child differs from its center by less than half a parent either way, so rounding finds the parent.
        q, r = F.floor((3 * q + r + 3) / 7), F.floor((2 * r - q + 3) / 7)
    return q.cast("int"), r.cast("int")


def superhex_center(q, r, levels: int = 1) -> tuple[Column, Column]:
    q, r = _c(q), _c(r)
    for _ in range(max(levels, 0)):
        q, r = 2 * q - r, q + 3 * r
    return q, r


def neighbors(df: DataFrame, q: str = "q", r: str = "r") -> DataFrame:
    """Each coordinate's six neighbours in order, as direction, neighbor_q and neighbor_r."""
    steps = F.array(*[F.struct(F.lit(i).alias("direction"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(NEIGHBORS)])
    out = df.withColumn("_n", F.explode(steps))
    return out.withColumn("direction", F.col("_n.direction")).withColumn("neighbor_q", F.col(q) + F.col("_n.a")).withColumn("neighbor_r", F.col(r) + F.col("_n.b")).drop("_n")


def superhex_children(df: DataFrame, q: str = "q", r: str = "r") -> DataFrame:
    """Each super-hexagon's seven children, center first and then its ring, as child, child_q and child_r."""
    steps = F.array(*[F.struct(F.lit(i).alias("child"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(((0, 0), *[spiral_offset(n) for n in range(1, 7)]))])
    cq, cr = superhex_center(q, r)
    out = df.withColumn("_n", F.explode(steps))
    return out.withColumn("child", F.col("_n.child")).withColumn("child_q", cq + F.col("_n.a")).withColumn("child_r", cr + F.col("_n.b")).drop("_n")


def spiral_offset(n: int) -> Coord:
    """spiral_inverse() of one place, on the driver."""
    if n == 0:
        return 0, 0
    k = 1
    while 3 * k * (k + 1) < n:
        k += 1
    side, j = divmod(n - 1 - 3 * k * (k - 1), k)
    return ((k, -j), (k - j, -k), (-j, j - k), (-k, j), (j - k, k), (j, k - j))[side]


def disk_size(radius: int) -> int:
    return 1 + 3 * radius * (radius + 1)


def annulus(spark: SparkSession, center: Coord, low: int, high: int) -> DataFrame:
    """Coordinates at distance low..high of a center: spiral (order), ring, q, r and key; those that have no key are left out.

    They are made on the driver: a radius bounds their number, to 197,377 for the widest operator.
    """
    import pandas as pd

    low = max(low, 0)
    first, end = (0 if low == 0 else disk_size(low - 1)), disk_size(high) if high >= low else 0
    n = np.arange(first, max(first, end), dtype=np.int64)
    k = np.where(n == 0, 0, np.floor((np.sqrt(12.0 * n - 3 + 4 * (n == 0)) + 3) / 6).astype(np.int64))
    side, j = np.divmod(np.where(k == 0, 0, n - 1 - 3 * k * (k - 1)), np.maximum(k, 1))
    dq = np.select([k == 0, side == 0, side == 1, side == 2, side == 3, side == 4], [0, k, k - j, -j, -k, j - k], j)
    dr = np.select([k == 0, side == 0, side == 1, side == 2, side == 3, side == 4], [0, -j, -k, j - k, j, k], k - j)
    q, r = dq + center[0], dr + center[1]
    code = [np.where(x >= 0, 2 * x, -2 * x - 1) for x in (q, r, -q - r)]
    key = sum((c >> i & 1) << 3 * i + at for at, c in enumerate(code) for i in range(20))
    good = np.max(np.abs([q, r, q + r]), axis=0) <= MAX_COORD if len(n) else np.zeros(0, bool)
    rows = pd.DataFrame({"spiral": n, "ring": k.astype(np.int32), "q": q.astype(np.int32), "r": r.astype(np.int32), "key": np.asarray(key, np.int64) if len(n) else n})[good]
    return spark.createDataFrame(rows, "spiral long, ring int, q int, r int, key long")


def disk(spark: SparkSession, center: Coord, radius: int) -> DataFrame:
    return annulus(spark, center, 0, radius)


def ring(spark: SparkSession, center: Coord, k: int) -> DataFrame:
    return annulus(spark, center, k, k) if k >= 0 else annulus(spark, center, 1, 0)


def check_radius(center: Coord, radius: int, most: int = MAX_RADIUS) -> None:
    """The whole disk must be on the lattice."""
    if not 0 <= radius <= most:
        raise InvalidArgument(f"radius {radius} is not in 0..{most}")
    if max(abs(center[0]), abs(center[1]), abs(center[0] + center[1])) + radius > MAX_COORD:
        raise InvalidArgument("the disk leaves the lattice")


def render_grid(center: Coord, radius: int, label=None) -> str:
    """The disk as text, a row for each r; labels of up to five characters, ``.`` without a label function."""
    if radius < 0:
        return ""
    radius, width = min(radius, 10), 7
    at: dict[Coord, str] = {}
    for n in range(disk_size(radius)):
        dq, dr = spiral_offset(n)
        text = "." if label is None else label((center[0] + dq, center[1] + dr))
        at[int(dr), dq + int(dr / 2)] = text[:5]
    columns = [c for _, c in at]
    lines = []
    for row in range(-radius, radius + 1):
        shown = (at.get((row, c), "") for c in range(min(columns), max(columns) + 1))
        lines.append(" " * (width // 2 * (row % 2)) + "".join((f"[{x}]" if x else "").ljust(width) for x in shown))
    return "\n".join(lines)
