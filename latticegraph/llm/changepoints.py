"""Penalised change points of daily series: memoised depth-first branch-and-bound from the series end.

A series of n days is cut into segments of at least SHORTEST days. With S and Q the sum and the sum of squares of a
segment of n days, V = 1 + floor((n Q - S S) / (n n)) and its cost is n floor(1000 ln V); the costs plus PENALTY for
every cut are made least. Ties go to the fewest segments, then to the earliest starts, compared from the last segment
backwards.

best(e), the cheapest cutting of the first e days, is the least of cost(s, e) + PENALTY + best(s) over the start s of the
last segment. The search goes depth first from the end of the series. Starts are taken in the order of
cost(s, e) + PENALTY + bound(s) with a lower bound of best(s), and those that are solved already make the first
incumbent; the search of e ends at the first start whose sum is above the incumbent. The cutoff is strict, so starts that
tie are followed. A solved subproblem leaves its key (cost, segments, start of the last segment) behind; as best(s) is the
same whatever follows, comparing these keys compares all starts from the last backwards.

The first bounds rest on the sum of squared errors E = Q - S S / n, which never falls when a segment grows. Because
V >= max(1, E / n), a segment costs at least f(n, E) = n (1000 g(E / n) - 1) with the concave g(x) = ln x from 1 on and
x - 1 below. f grows with E and f(a + b, E + F) >= f(a, E) + f(b, F), so the costs of segments are at least the sum of f
over pieces of them. Days before s are taken in windows of WINDOWS days: each holds no cut, or one, and then at least
PENALTY and the f of its two pieces are due (cuts are SHORTEST days apart, and a window has no room for two).

Sums by (key, day) are pre-aggregated before the shuffle, so a hot key moves one row per day and map task; a search sees
one series, as long as its days. Integers are exact: values are taken from the mean, which changes no cost, and beyond
62 bits Python integers take over.

Defined results: a series that is shorter than two segments is one segment; days without rows count 0; rows with a null
day or value are left out; rows with a null key are a series of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import column, thrifty

SHORTEST = 5
PENALTY = 10_000
#: Days of the windows that the first bounds are made of; at most SHORTEST + 1.
WINDOWS = (6, 5)
#: Days of a series up to which all costs are computed at once.
TABLE = 256
_NEVER = 1 << 61


class Series:
    """The search over one series of integers."""

    def __init__(self, values, shortest: int = SHORTEST, penalty: int = PENALTY):
        self.values = [int(v) for v in values]
        self.n, self.shortest, self.penalty = len(self.values), shortest, penalty
        middle = sum(self.values) // self.n
        near = [v - middle for v in self.values]
        # n Q and S S stay below n n max^2
        exact = np.int64 if (self.n * max(map(abs, near), default=0)) ** 2 < 1 << 62 else object
        near = np.array(near, exact)
        self.sums = np.concatenate([np.zeros(1, exact), np.cumsum(near, dtype=exact)])
        self.squares = np.concatenate([np.zeros(1, exact), np.cumsum(near * near, dtype=exact)])
        # costs by end - 1 and start; of a longer series a row is made when its end is opened
        self.table = None
        if self.n <= TABLE:
            starts, ends = np.arange(self.n), np.arange(1, self.n + 1)[:, None]
            self.table = self.costs(np.minimum(starts, ends - 1), ends)
        self.opened = 0

    def spreads(self, starts: np.ndarray, end) -> np.ndarray:
        """V of the segments from each start to end."""
        n = end - starts
        s, q = self.sums[end] - self.sums[starts], self.squares[end] - self.squares[starts]
        return (n * q - s * s) // (n * n) + 1

    def costs(self, starts: np.ndarray, end) -> np.ndarray:
        return (end - starts) * np.floor(1000 * np.log(self.spreads(starts, end).astype(float))).astype(np.int64)

    def first_bounds(self) -> np.ndarray:
        """A lower bound of best(e) for every e."""
        n = self.n

        def floor_of(a, b):
            """f of the pieces from a to b, a little less for rounding."""
            m = b - a
            s, q = (self.sums[b] - self.sums[a]).astype(float), (self.squares[b] - self.squares[a]).astype(float)
            x = np.maximum(q - s * s / m, 0) / m * (1 - 1e-9)
            return m * (1000 * np.where(x >= 1, np.log(np.maximum(x, 1)), x - 1) - 1)

        least = {}
        for w in WINDOWS:
            if w > self.shortest + 1 or n < w:
                continue
            a = np.arange(n - w + 1)
            r = floor_of(a, a + w)
            for c in range(1, w):
                r = np.minimum(r, self.penalty + floor_of(a, a + c) + floor_of(a + c, a + w))
            least[w] = r.tolist()
        out = [-1001.0 * e for e in range(n + 1)]
        for e in range(1, n + 1):
            for w, r in least.items():
                if e >= w and (x := out[e - w] + r[e - w]) > out[e]:
                    out[e] = x
        return np.maximum(np.floor(np.array(out)) - 1, 0).astype(np.int64)

    def solve(self) -> tuple[int, list[int]]:
        """Least cost of the series and the starts of its segments."""
        n, short = self.n, self.shortest
        best, bound = np.full(n + 1, _NEVER), self.first_bounds()  # a solved start has no bound any more
        pieces, last = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        stack = [self._opened(n)]
        while stack:
            end, row, whole = stack[-1]
            many, incumbent = short + len(row), whole
            if len(row):
                # also starts that were solved below another start
                reached = row + best[short:many]
                incumbent = min(whole, int(reached.min()))
                total = row + bound[short:many]
                i = int(total.argmin())
                if total[i] <= incumbent:
                    stack.append(self._opened(short + i))
                    continue
            stack.pop()
            key = (1, 0) if whole == incumbent else (n + 1, 0)
            if len(row):
                for s in np.flatnonzero(reached == incumbent) + short:
                    key = min(key, (int(pieces[s]) + 1, int(s)))
            best[end], bound[end], pieces[end], last[end] = incumbent, _NEVER, *key
        starts, e = [], n
        while e:
            e = int(last[e])
            starts.append(e)
        return int(best[n]), starts[::-1]

    def _opened(self, end: int) -> tuple[int, np.ndarray, int]:
        """A subproblem: its end, the costs and the penalty by start of the last segment, and the cost of one segment."""
        self.opened += 1
        many = max(end - 2 * self.shortest + 1, 0)
        if self.table is None:
            costs = self.costs(np.concatenate([[0], np.arange(self.shortest, self.shortest + many)]), end)
            return end, costs[1:] + self.penalty, int(costs[0])
        return end, self.table[end - 1, self.shortest : self.shortest + many] + self.penalty, int(self.table[end - 1, 0])

    def segments(self) -> tuple[int, list[tuple[int, int, int, int, int]]]:
        """Least cost, and first day, days, total, spread and cost of each segment."""
        best, starts = self.solve()
        out = []
        for a, b in zip(starts, [*starts[1:], self.n]):
            at = np.array([a])
            out.append((a, b - a, sum(self.values[a:b]), int(self.spreads(at, b)[0]), int(self.costs(at, b)[0])))
        return best, out


COLUMNS = ("segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost")


def segments(rows: DataFrame, *, key: str, day: str, value: str, shortest: int = SHORTEST, penalty: int = PENALTY) -> DataFrame:
    """One row per segment of each key's series of daily sums: key and COLUMNS. day and value are whole numbers."""
    taken = rows.select(column(key).alias("key"), column(day).cast("long").alias("day"), column(value).cast("long").alias("value")).filter("day is not null and value is not null")
    daily = taken.groupBy("key", "day").agg(F.sum("value").alias("value"))
    # a count of partitions of its own: a series is few bytes and much work
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series = daily.repartition(n, "key").groupBy("key").agg(F.collect_list(F.struct("day", "value")).alias("days"))
    schema = StructType([StructField(key, rows.schema[key].dataType), *(StructField(c, LongType()) for c in COLUMNS)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                of, out = [], []
                for k, days in enumerate(part.column(1)):
                    flat = days.values
                    when, what = (flat.field(c).to_numpy() for c in ("day", "value"))
                    first = int(when.min())
                    values = np.zeros(int(when.max()) - first + 1, np.int64)
                    values[when - first] = what
                    best, found = Series(values, shortest, penalty).segments()
                    of += [k] * len(found)
                    out += [(i, first + a, d, t, v, c, len(found), best) for i, (a, d, t, v, c) in enumerate(found, 1)]
                if of:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *(pa.array(c, pa.int64()) for c in zip(*out))], [key, *COLUMNS])

    return series.mapInArrow(thrifty(run), schema)


def brute_force(values, shortest: int = SHORTEST, penalty: int = PENALTY) -> tuple[int, list[int]]:
    """The same by trying every cutting; for short series in tests."""

    def cost(part):
        n, s, q = len(part), sum(part), sum(v * v for v in part)
        return n * math.floor(1000 * math.log(1 + (n * q - s * s) // (n * n)))

    def cuttings(e):
        yield (0,)
        for s in range(shortest, e - shortest + 1):
            for head in cuttings(s):
                yield (*head, s)

    values = [int(v) for v in values]
    ranked = ((sum(cost(values[a:b]) for a, b in zip(c, (*c[1:], len(values)))) + penalty * (len(c) - 1), len(c), c[::-1]) for c in cuttings(len(values)))
    best, _, starts = min(ranked)
    return best, list(starts[::-1])
