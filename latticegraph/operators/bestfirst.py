"""Best-first search over computed neighbours as supersteps, for searches whose frontier is too large for one task.

Any number of searches goes through a step together. Two tables are the state: reached, to which every step appends the
points it found at a smaller cost than before (search, key, labels, parent, g, h, step), and open, the points not yet
expanded. A step expands the open points of the lowest estimates f = g + h, whole levels of f until at least width points
of a search are taken; which levels these are comes from counts by (search, f), so nothing is sorted and ties go together.
Neighbours of a key that several searches expand are computed once. A reached point is dropped if it was reached before
at no larger cost; a point reached again at a smaller one is opened again.

The cheapest goal reached is the incumbent of its search. Open points with f no lower than its cost are dropped, so a
search ends when the least f is no lower than the incumbent, when nothing is open, or after max_steps steps. With an
estimate that never exceeds the true cost (none, or a small weight) the path found is a shortest one.

What was reached before is looked up by scanning reached against the new points, which are broadcast while their count
allows and else shuffled, so the large table does not move. Only counts of a step reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance
from ..functions.calculators import PairCalculator, Provider
from ..storage import written
from . import canonical
from .search import appended, united
from .supersteps import Listener, Progress, observed, paths_along, tell

#: Rows of at most this many, each a key and a number, are sent to every executor.
SMALL = 500_000

REACHED = ("search", "key", "labels", "parent", "g", "h", "step")


def _estimate(name: str, weight: float) -> Column:
    """The estimate of a row with key and goals."""
    key, goals = F.col("key"), F.col("goals")
    known = {"none": lambda: F.lit(0.0), "manhattan": lambda: distance.nearest_goal(key, goals), "squared": lambda: distance.nearest_goal(key, goals, distance.squared_euclidean)}
    if name not in known:
        raise ValueError(f"no estimate {name}")
    return (known[name]() * F.lit(float(weight))).cast("double")


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def best_first(
    searches: DataFrame,
    *,
    heuristic: str = "manhattan",
    weight: float = 1.0,
    width: int = 1000,
    max_steps: int = 200,
    ceiling: float | None = None,
    provider: Provider = PairCalculator,
    folder: str | None = None,
    listener: Listener | None = None,
) -> DataFrame:
    """All points reached: REACHED. searches has search, starts, goals, labels, xi and delta; these two are the same in all.

    Points are entered only below the ceiling, if there is one. folder keeps progress, so that a run that was lost goes on.
    A listener is told reached, expanded and open points, unfinished searches and the least estimate of every step.
    """
    spark = searches.sparkSession
    searches = written(searches.select("search", "starts", "goals", "labels", "xi", "delta"), "searches")
    scale = searches.select("xi", "delta").distinct().limit(2).collect()
    if len(scale) > 1:
        raise ValueError("searches of one run share xi and delta")
    n_searches = searches.count()
    goals = searches.select("search", "goals")
    starts = searches.select("search", F.explode("starts").alias("key"), "labels", "goals").distinct()
    estimate = _estimate(heuristic, weight)
    columns = ["search", "key", "labels", "parent", "g", "h", "step"]
    if not scale:
        return starts.select("search", "key", "labels", F.lit(None).cast("array<bigint>").alias("parent"), F.lit(0).alias("g"), estimate.alias("h"), F.lit(0).alias("step"))
    xi, delta = scale[0]
    progress = Progress(spark, folder, (heuristic, weight, width, ceiling, xi, delta, n_searches))
    progress.recover()
    kept = progress.load()
    if kept is None:
        first = starts.select("search", "key", "labels", F.lit(None).cast("array<bigint>").alias("parent"), F.lit(0).alias("g"), estimate.alias("h"), F.lit(0).alias("step"))
        reached, step = [written(first, "reached")], 0
        front = written(first.select("search", "key", "labels", "g", (F.col("g") + F.col("h")).alias("f")), "open")
    else:
        step, tables, _ = kept
        reached, front = tables["reached"], tables["open"][0]
    while step < max_steps:
        step += 1
        # the cheapest goal of each search, and the level of f up to which it is expanded now
        ends = searches.select("search", F.explode("goals").alias("key")).distinct()
        incumbents = united(reached).join(_side(ends, n_searches), ["search", "key"]).groupBy("search").agg(F.min("g").alias("incumbent"))
        useful = front.join(_side(incumbents, n_searches), "search", "left").filter("incumbent is null or f < incumbent").drop("incumbent")
        levels = useful.groupBy("search", "f").count()
        before = F.coalesce(F.sum("count").over(Window.partitionBy("search").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut, plan = observed(
            levels.withColumn("before", before).groupBy("search").agg(F.max(F.when(F.col("before") < width, F.col("f"))).alias("cut"), F.min("f").alias("least"), F.sum("count").alias("open")),
            "levels", unfinished=F.count(F.lit(1)), least=F.min("least"), open=F.coalesce(F.sum("open"), F.lit(0)),
        )
        if not plan["unfinished"]:
            break
        dealt = useful.join(_side(cut, n_searches), "search")
        now, taken = observed(dealt.filter("f <= cut").groupBy("search", "key").agg(F.first("labels").alias("labels"), F.min("g").alias("g")), "now", expanded=F.count(F.lit(1)))
        near = canonical.neighbour_keys(now, delta)
        arrived = now.join(near.drop("labels"), "key").groupBy("search", F.col("neighbour")).agg(F.min(F.struct("g", "key")).alias("by"), F.first("labels").alias("labels"))
        arrived, come = observed(arrived.select("search", F.col("neighbour").alias("key"), "labels", F.col("by.key").alias("parent"), (F.col("by.g") + 1).alias("g")), "arrived", rows=F.count(F.lit(1)))
        # points reached before at no larger cost: found by a scan of the large table against the new points
        named = _side(arrived.select("search", "key", F.col("g").alias("now_g")), come["rows"])
        old = united(reached).select("search", "key", "g").join(named, ["search", "key"]).filter("g <= now_g").select("search", "key").distinct()
        fresh = arrived.join(_side(old, come["rows"]), ["search", "key"], "left_anti")
        if ceiling is not None:
            fresh = written(fresh, "fresh")
            low = canonical.energies_of(fresh, xi, delta, provider).filter(F.col("energy") < ceiling).select("key")
            fresh = fresh.join(low, "key", "left_semi")
        fresh = fresh.join(_side(goals, n_searches), "search").withColumn("h", estimate).withColumn("step", F.lit(step))
        fresh, new = observed(fresh.select(*columns), "reached", reached=F.count(F.lit(1)))
        front = written(dealt.filter("f > cut").select("search", "key", "labels", "g", "f").unionByName(fresh.select("search", "key", "labels", "g", (F.col("g") + F.col("h")).alias("f"))), "open")
        reached = appended(reached, fresh)
        metrics = {**plan, **taken, **new}
        progress.save(step, {"reached": reached, "open": [front]}, metrics)
        tell(listener, step, metrics)
    return united(reached)


def members(searches: DataFrame) -> DataFrame:
    """search and first: the smallest number among the searches with its starts, goals, labels, xi and delta."""
    rows = searches.select("search", F.sha2(F.to_json(F.struct("starts", "goals", "labels", "xi", "delta")), 256).alias("problem")).distinct()
    return rows.join(rows.groupBy("problem").agg(F.min("search").alias("first")), "problem").select("search", "first")


def best_paths(searches: DataFrame, reached: DataFrame) -> DataFrame:
    """search, step (0 at the start) and key of the cheapest path of every search that reached a goal.

    Of several cheapest goals the smallest key is taken, of several parents the one of the first and smallest.
    """
    best = reached.groupBy("search", "key").agg(F.min_by("parent", F.struct("g", "step", "parent")).alias("parent"), F.min("g").alias("g"))
    best = written(best, "links")
    ends = searches.select("search", F.explode("goals").alias("key")).distinct().join(best.select("search", "key", "g"), ["search", "key"])
    ends = ends.groupBy("search").agg(F.min(F.struct("g", "key")).alias("end")).select("search", F.col("end.key").alias("key"))
    ways = paths_along(best, ends, keys=("search", "key"))
    length = ways.groupBy("search").agg(F.max("hop").alias("length"))
    return ways.join(length, "search").select("search", (F.col("length") - F.col("hop")).alias("step"), "key")
