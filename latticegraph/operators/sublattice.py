"""Sublattices of a given index as Hermite matrices, generated by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hermite_matrices(spark: SparkSession, index: int) -> DataFrame:
    """a, b, c, d, e, f of all upper triangular matrices ((a, d, e), (0, b, f), (0, 0, c)) of determinant index.

    d and e run over 0 .. a - 1 and f over 0 .. b - 1, one matrix per sublattice.
    """
    return sublattices(spark.range(1).select(F.lit(index).alias("n")), "n").drop("n")


def sublattices(rows: DataFrame, index: str) -> DataFrame:
    """rows with a, b, c, d, e, f of every sublattice of the index that stands in a column (a whole number of at least 1)."""
    span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    divisors = lambda n: F.explode(F.filter(F.sequence(F.lit(1), n), lambda x: n % x == 0))
    n = F.col(index).cast("int")
    sides = rows.withColumn("a", divisors(n)).withColumn("c", (n / F.col("a")).cast("int")).withColumn("b", divisors(F.col("c")))
    sides = sides.withColumn("c", (F.col("c") / F.col("b")).cast("int"))
    return sides.withColumn("d", span(F.col("a"))).withColumn("e", span(F.col("a"))).withColumn("f", span(F.col("b"))).select(*rows.columns, *"abcdef")


def supercell_atoms(atoms: DataFrame, index: int, delta: int) -> DataFrame:
    """Atoms (id, label, x, y, z in delta-ths) of every supercell of an index, in units of 1 / (index * delta).

    The old vectors times the matrix are the new ones, so coordinates are turned by its adjugate, once for every
    translation of the old lattice inside the new cell. The table of matrices depends on the index alone.
    """
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    moves = hermite_matrices(atoms.sparkSession, index).select("*", span("a").alias("z1")).select("*", span("b").alias("z2")).select("*", span("c").alias("z3"))
    rows = atoms.crossJoin(F.broadcast(moves))
    y1, y2, y3 = (F.col(n) + F.col(z) * delta for n, z in (("x", "z1"), ("y", "z2"), ("z", "z3")))
    a, b, c, d, e, f = (F.col(n) for n in "abcdef")
    new = (y1 * b * c - y2 * d * c + y3 * (d * f - b * e), y2 * a * c - y3 * a * f, y3 * a * b)
    return rows.select("id", *"abcdef", "label", *(F.pmod(v, F.lit(index * delta)).cast("long").alias(n) for v, n in zip(new, "xyz")))


def common_atoms(m: str, n: str, least: str) -> Column:
    """Least common multiple of two columns of at least 1, or its least multiple that is not below a third column."""
    gcd = f"aggregate(sequence(1, cast(least({m}, {n}) as int)), 1, (g, k) -> if({m} % k = 0 and {n} % k = 0, k, g))"
    lcm = F.expr(f"cast({m} * {n} div {gcd} as bigint)")
    return F.when(F.col(least) > lcm, lcm * F.ceil(F.col(least) / lcm)).otherwise(lcm)


def greatest_common_divisor(a: Column, b: Column) -> Column:
    """By division with remainder; 92 divisions are enough for any two whole numbers of 64 bits."""
    first = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), first, step, lambda s: s["a"])
