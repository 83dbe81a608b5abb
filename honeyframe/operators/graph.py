"""Typed, directed edges: walks and cheapest paths by joins of a frontier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from honeyframe.errors import InvalidArgument, ScanLimit
from honeyframe.functions.geometry import Coord, pack_one
from honeyframe.plans.lineage import cut


def relations(text: str) -> list[str]:
    """The relations of a comma-separated filter, trimmed; none means all."""
    return [x.strip() for x in text.split(",") if x.strip()]


def edges_from(edges: DataFrame, at: Coord) -> DataFrame:
    """Outgoing edges by the key of their end, then shorter relations first."""
    return edges.filter(F.col("from_key") == pack_one(*at)).orderBy("to_key", F.octet_length("relation"), "relation")


def get_edge(edges: DataFrame, start: Coord, end: Coord, relation: str) -> DataFrame:
    return edges.filter((F.col("from_key") == pack_one(*start)) & (F.col("to_key") == pack_one(*end)) & (F.col("relation") == relation))


def walk(edges: DataFrame, start: Coord, relation: str = "", max_hops: int = 0, max_nodes: int = 0) -> DataFrame:
    """Coordinates reached from a start, itself first, in breadth-first order: level, q, r, key, path (the order within a level).

    A coordinate's place is the least path of edges to it, compared edge by edge, so no level has to be numbered in one
    task. Bounds of 0 or less don't bind.
    """
    wanted = relations(relation)
    own = edges.filter(F.col("relation").isin(wanted)) if wanted else edges
    own = own.select("from_key", "to_key", "to_q", "to_r", F.struct("to_key", F.octet_length("relation").alias("n"), "relation").alias("step"))
    spark = edges.sparkSession
    step_type = own.schema["step"].dataType.simpleString()
    seen = spark.createDataFrame([(0, *start, pack_one(*start))], "level int, q int, r int, key long").withColumn("path", F.expr(f"cast(array() as array<{step_type}>)"))
    frontier, level, count = seen, 0, 1
    while (max_hops <= 0 or level < max_hops) and (max_nodes <= 0 or count < max_nodes):
        level += 1
        met = frontier.select("key", "path").join(own, F.col("key") == F.col("from_key"))
        found = met.select(F.col("to_key").alias("key"), "to_q", "to_r", F.concat("path", F.array("step")).alias("path"))
        found = found.groupBy("key").agg(F.min(F.struct("path", "to_q", "to_r")).alias("m")).join(seen.select("key"), "key", "left_anti")
        frontier = cut(found.select(F.lit(level).alias("level"), F.col("m.to_q").alias("q"), F.col("m.to_r").alias("r"), "key", F.col("m.path").alias("path")))
        new = frontier.count()
        if not new:
            break
        seen, count = seen.unionByName(frontier), count + new
    out = seen.orderBy("level", "path")
    return out.limit(max_nodes) if max_nodes > 0 else out


def costs(edges: DataFrame, relation: str = "", cost: Column | None = None) -> DataFrame:
    """One edge per pair of ends at its least cost: a weight of 0 or less counts as 1, a negative ``cost`` closes the edge."""
    wanted = relations(relation)
    own = edges.filter(F.col("relation").isin(wanted)) if wanted else edges
    price = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0) if cost is None else cost
    own = own.withColumn("price", price.cast("double"))
    if cost is not None:
        if not own.filter(F.isnan("price") | F.col("price").isNull() | (F.abs("price") == float("inf"))).isEmpty():
            raise InvalidArgument("a cost isn't finite")
        own = own.filter("price >= 0")
    return own.groupBy("from_key", "to_key").agg(F.min("price").alias("price"), F.first("to_q").alias("to_q"), F.first("to_r").alias("to_r"))


def shortest_paths(edges: DataFrame, start: Coord, relation: str = "", cost: Column | None = None, max_rounds: int = 0, max_edge_rows: int = 0, goal: Coord | None = None, heuristic: Callable[..., Column] | None = None) -> DataFrame:
    """Cheapest paths to all that is reachable: key, q, r, cost, hops, path (coordinates). Ties: fewer hops, then the least path.

    Only what a round has made cheaper is joined in the next. With a ``goal`` only its path is sure to be the cheapest: as
    soon as it has any cost, what can't lead to it for that cost goes no further. ``heuristic``, a function of two
    coordinates, says what the rest of a way costs at least; without it that is nothing.
    """
    if max_edge_rows and edges.limit(max_edge_rows + 1).count() > max_edge_rows:
        raise ScanLimit(f"more than {max_edge_rows} edges")
    own = cut(costs(edges, relation, cost))
    spark = edges.sparkSession
    best = spark.createDataFrame([(pack_one(*start), 0.0, 0, [start])], "key long, cost double, hops int, path array<struct<q: int, r: int>>")
    changed, turn = best, 0
    while True:
        turn += 1
        if max_rounds and turn > max_rounds:
            raise ScanLimit(f"not settled after {max_rounds} rounds", best)
        met = changed.join(own, F.col("key") == F.col("from_key"))
        met = met.select(F.col("to_key").alias("key"), (F.col("cost") + F.col("price")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array(F.struct(F.col("to_q").alias("q"), F.col("to_r").alias("r")))).alias("path"))
        both = best.select("key", F.struct("cost", "hops", "path").alias("old")).join(met.groupBy("key").agg(F.min(F.struct("cost", "hops", "path")).alias("new")), "key", "full")
        better = F.col("old").isNull() | (F.col("new") < F.col("old"))
        chosen = cut(both.select("key", F.coalesce(better, F.lit(False)).alias("better"), F.when(F.coalesce(better, F.lit(False)), F.col("new")).otherwise(F.col("old")).alias("s")))
        best = chosen.select("key", "s.*")
        changed = chosen.filter("better").select("key", "s.*")
        if goal is not None:
            found = best.filter(F.col("key") == pack_one(*goal)).select("cost").first()
            at = F.element_at("path", -1)
            ahead = F.lit(0.0) if heuristic is None else heuristic(at["q"], at["r"], F.lit(goal[0]), F.lit(goal[1]))
            changed = changed.filter(F.col("key") != pack_one(*goal))  # a way through the goal is no shorter way to it
            changed = changed if found is None else changed.filter(F.col("cost") + ahead <= found.cost)
        if changed.isEmpty():
            break
    end = F.element_at("path", -1)
    return best.select("key", end["q"].alias("q"), end["r"].alias("r"), "cost", "hops", "path")


def find_path(edges: DataFrame, start: Coord, goal: Coord, relation: str = "", cost: Column | None = None, max_rounds: int = 0, max_edge_rows: int = 0, heuristic: Callable[..., Column] | None = None) -> list[Coord] | None:
    """The cheapest path's coordinates, by a search towards the goal; None if it can't be reached."""
    if start == goal:
        return [start]
    row = shortest_paths(edges, start, relation, cost, max_rounds, max_edge_rows, goal, heuristic).filter(F.col("key") == pack_one(*goal)).select("path").first()
    return None if row is None else [(x.q, x.r) for x in row.path]
