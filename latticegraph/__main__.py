"""Command line: keys and neighbours of crystal files, path searches, their phases, and floods in a point store."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import barrier, canonical
from .sources import cif, points, structures
from .sources import results as results_source


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="latticegraph")
    top.add_argument("--xi", type=float, default=1.5, help="unit of the vonorms")
    top.add_argument("--delta", type=int, default=30, help="intervals of a cell edge")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("keys", "neighbours"):
        commands.add_parser(name).add_argument("files")
    for name in ("astar", "parameters", "sample", "sweep", "ratchet", "find-barrier"):
        sub = commands.add_parser(name)
        sub.add_argument("start")
        sub.add_argument("end")
        sub.add_argument("--out", help="file for the result as JSON")
        sub.add_argument("--iterations", type=int, default=10_000)
        sub.add_argument("--beam", type=int, default=1000)
        sub.add_argument("--attempts", type=int, default=10)
        sub.add_argument("--rounds", type=int, default=3)
        sub.add_argument("--step", type=float, default=0.01, help="least fall of a barrier")
        sub.add_argument("--xi-factor", type=float, default=0.8, help="xi of a finer resolution, by that before")
        sub.add_argument("--delta-factor", type=float, default=1.2, help="delta of a finer resolution, by that before")
        sub.add_argument("--from", dest="previous", help="file of results whose resolution and best barrier are taken over")
    flood = commands.add_parser("flood").add_subparsers(dest="action", required=True)
    setup = flood.add_parser("setup")
    for name in ("store", "start", "end"):
        setup.add_argument(name)
    setup.add_argument("--width", type=float, default=0.005)
    setup.add_argument("--description", default="")
    for name in ("run", "check"):
        sub = flood.add_parser(name)
        sub.add_argument("store")
        sub.add_argument("search", type=int)
        if name == "run":
            sub.add_argument("--steps", type=int, default=100)
            sub.add_argument("--batch", type=int, default=1000)
    flood.add_parser("status").add_argument("store")
    return top


def _ends(spark: SparkSession, args) -> tuple[DataFrame, DataFrame]:
    start, end = (structures.keys_of(cif.read(spark, p), args.xi, args.delta) for p in (args.start, args.end))
    return start, end


def searches(spark: SparkSession, args) -> DataFrame:
    """One search from all keys of the start files to all keys of the end files; unlike compositions raise ValueError."""
    start, end = _ends(spark, args)
    rows = start.select("key", "elements", "labels", F.lit("starts").alias("kind")).union(end.select("key", "elements", "labels", F.lit("goals").alias("kind")))
    found = rows.groupBy("elements", "labels").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("key"))).alias(k) for k in ("starts", "goals"))).collect()
    if len(found) != 1 or not found[0].starts or not found[0].goals:
        raise ValueError("start and end must have the same elements, in the same numbers")
    row = found[0]
    schema = "search bigint, starts array<array<bigint>>, goals array<array<bigint>>, labels array<int>, xi double, delta int"
    return spark.createDataFrame([(0, row.starts, row.goals, row.labels, args.xi, args.delta)], schema)


def results(spark: SparkSession, args) -> DataFrame:
    ceiling = None
    if args.previous:
        before = results_source.previous(spark, args.previous).first()
        if before is None:
            raise ValueError(f"no barrier in {args.previous}")
        args.xi, args.delta, ceiling = before.xi or args.xi, before.delta or args.delta, before.ceiling
    rows, bounds = searches(spark, args), {"max_iterations": args.iterations, "beam": args.beam}
    finer = {"xi_factor": args.xi_factor, "delta_factor": args.delta_factor}
    if args.command == "astar":
        return barrier.run(barrier.tasks(rows, **bounds))
    if args.command == "parameters":
        return barrier.parameter_search(rows, **bounds)
    if args.command == "sample":
        return barrier.sample(rows, args.attempts, **bounds)
    known = canonical.written(barrier.sample(rows, args.attempts, **bounds), "sampled")
    top = known
    if ceiling is not None:  # the phases go on from the lower of both barriers
        top = known.withColumn("barrier", F.when(F.col("found"), F.least("barrier", F.lit(ceiling))))
    if args.command == "ratchet":
        return barrier.ratchet(rows, top, args.step, rounds=args.rounds, **finer, **bounds)
    swept = known.union(barrier.sweep(rows, top, args.attempts, args.rounds, **finer, **bounds))
    if args.command == "sweep":
        return swept
    swept = canonical.written(swept, "swept")
    return barrier.ratchet(rows, swept, args.step, rounds=args.rounds, **finer, **bounds)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command and returns the lines it printed, each a JSON object."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("latticegraph").getOrCreate()
    if args.command == "keys":
        out = structures.to_json(structures.keys_of(cif.read(spark, args.files), args.xi, args.delta), args.xi, args.delta).select("structure_id", "point")
    elif args.command == "neighbours":
        keys = structures.keys_of(cif.read(spark, args.files), args.xi, args.delta)
        out = canonical.neighbour_keys(keys, args.delta).select("key", "neighbour")
    elif args.command == "flood":
        if args.action == "setup":
            start, end = _ends(spark, args)
            elements = start.select("elements").first()[0]
            store = points.PointStore.create(spark, args.store, args.xi, args.delta, elements)
            number = store.create_search(args.description, start, end, args.width)
            out = spark.createDataFrame([(number,)], "search int")
        else:
            store = points.PointStore.open(spark, args.store)
            if args.action == "status":
                out = store.status()
            elif args.action == "check":
                out = store.check(args.search)
            else:
                steps = store.run(args.search, args.steps, args.batch)
                out = spark.createDataFrame([(args.search, steps, store.is_complete(args.search), store.barrier(args.search))], "search int, steps int, complete boolean, barrier double")
    else:
        out = results(spark, args)
    lines = [json.dumps(json.loads(r[0])) for r in out.select(F.to_json(F.struct("*"))).toLocalIterator()]
    if getattr(args, "out", None):
        Path(args.out).write_text("\n".join(lines) + "\n")
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
