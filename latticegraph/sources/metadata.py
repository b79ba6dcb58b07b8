"""Metadata of a store with its search processes as JSON: resolution, elements and the ends of every search.

The fields are those of the files in use. What a store holds is collected to the driver only here: a row for each search
and its ends.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import structures
from .points import PointStore

#: Names of the fields, as they stand in metadata files.
FIELDS = ("description", "xi", "delta", "atom_list", "calculator_model", "time_created", "search_processes")
PROCESS = ("search_id", "start_cnfs", "end_cnfs", "time_created", "frontier_width")
#: Frontier width of a search whose metadata name none.
WIDTH = 0.005


def parse(text: str) -> dict:
    """The fields of a metadata text; ValueError if one that a store needs is missing or of another kind."""
    meta = json.loads(text)
    if missing := [f for f in ("xi", "delta", "atom_list") if f not in meta]:
        raise ValueError(f"fields are missing: {missing}")
    if not isinstance(meta["delta"], int) or not meta["atom_list"]:
        raise ValueError("delta is a whole number, and there are elements")
    out = {f: meta.get(f) for f in FIELDS}
    out["search_processes"] = [{**dict.fromkeys(PROCESS), "frontier_width": WIDTH, **p} for p in out["search_processes"] or []]
    return out


def create(spark: SparkSession, path: str, text: str) -> PointStore:
    """A new store with the searches that a metadata text lists, numbered anew from 1 in their order.

    An end of another length than the elements ask for, or with coordinates outside delta, raises ValueError.
    """
    meta = parse(text)
    names, delta = meta["atom_list"], meta["delta"]
    labels = [list(dict.fromkeys(names)).index(n) for n in names]
    for process in meta["search_processes"]:
        for key in [*(process["start_cnfs"] or []), *(process["end_cnfs"] or [])]:
            if len(key) != 7 + 3 * (len(names) - 1) or not all(0 <= x < delta for x in key[7:]):
                raise ValueError(f"no key of {len(names)} atoms at delta {delta}: {key}")
    store = PointStore.create(spark, path, float(meta["xi"]), delta, names)
    rows = lambda keys: spark.createDataFrame([(list(map(int, k)), labels) for k in keys or []], "key array<bigint>, labels array<int>")
    for process in meta["search_processes"]:
        store.create_search(process.get("description") or meta["description"] or "", rows(process["start_cnfs"]), rows(process["end_cnfs"]), process["frontier_width"])
    return store


def of_store(store: PointStore, description: str = "", calculator: str = "") -> str:
    """Metadata text of a store."""
    ends = {}
    for r in store.table("end").orderBy("search", "kind", "key").collect():
        ends.setdefault(r.search, {"start": [], "goal": []})[r.kind].append(list(r.key))
    now = datetime.now(UTC).isoformat(timespec="seconds")
    processes = [dict(zip(PROCESS, (r.search, ends[r.search]["start"], ends[r.search]["goal"], now, r.width))) for r in store.table("search").orderBy("search").collect()]
    return json.dumps(dict(zip(FIELDS, (description, store.xi, store.delta, store.elements, calculator, now, processes))))


def keys_of_points(store: PointStore, texts: DataFrame) -> DataFrame:
    """key and labels of points given as JSON (column point), for create_search.

    A text that is no point, or one of another xi, delta or composition than the store's, raises ValueError.
    """
    rows = structures.from_json(texts)
    fits = (F.col("xi") == store.xi) & (F.col("delta") == store.delta) & (F.col("elements") == F.array(*map(F.lit, store.elements)))
    odd = rows.filter(~F.coalesce(fits, F.lit(False)) | F.col("key").isNull()).select("point").limit(3).collect()
    if odd:
        raise ValueError(f"points that do not fit the store: {[r.point for r in odd]}")
    labels = [list(dict.fromkeys(store.elements)).index(n) for n in store.elements]
    return rows.select("key", F.array(*map(F.lit, labels)).alias("labels"))
