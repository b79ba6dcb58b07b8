"""Queries whose work once grew faster than their rows: what goes through the costly step, and results on repeated ids."""

import duckdb
import pytest

from latticegraph.operators import sublattice, supersteps
from latticegraph.plans import crystal_queries, relational_queries, store_queries


@pytest.fixture
def parts(spark, tmp_path):
    """A table of parts with ids that repeat, with equal and with other sizes."""
    rows = [(k % 40 + 1, k % 7 * (k % 3) + 1) for k in range(150)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def answer(folder, sql, *names):
    db = duckdb.connect()
    for name in names:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return sorted(db.execute(sql).fetchall())


def above(df, node, other):
    """How often a node stands in the optimized plan before another does."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index(other)].count(node)


def test_matrices_are_multiplied_once_for_an_index(spark, parts, monkeypatch):
    asked, plain = [], sublattice.sublattices
    monkeypatch.setattr(sublattice, "sublattices", lambda rows, index: asked.append(rows.count()) or plain(rows, index))
    got = relational_queries.matrix_products(spark, parts).collect()
    assert sorted(map(tuple, got)) == answer(parts, relational_queries.ORACLE_SQL["j14_matrix_products"], "part")
    assert max(asked) <= 4


def test_steps_are_told_apart_inside_the_row_of_an_id(spark, parts):
    rows = store_queries.step_candidates(spark, parts)
    assert sorted(map(tuple, rows.collect())) == answer(parts, store_queries.ORACLE_SQL["k16_step_candidates"], "part")
    assert above(rows, "Aggregate", "Generate explode") == 1  # the counts alone


def test_paths_are_resampled_in_one_shuffle_without_tables_of_groups(spark, tmp_path):
    rows = [(k % 17, k * 7 % 5, k * k % 23) for k in range(120)] + [(50, 1, 4), (51, 1, 4), (51, 2, 4), (51, 3, 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = crystal_queries.resampled_paths(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == answer(tmp_path, crystal_queries.ORACLE_SQL["w3_resampled_paths"], "lineitem")
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "HashAggregate" not in plan and plan.count("Exchange ") == 1


@pytest.mark.parametrize("name", ["u4_deleted_edges", "j16_nearest_end_pair"])
def test_edges_need_no_hash_table(spark, parts, name):
    rows = [(k % 9 + 1, k * k % 13 + 1) for k in range(200)] + [(4, 4)] * 3
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{parts}/lineitem.parquet")
    spark.createDataFrame([(k, k % 7 + 1) for k in range(1, 14)], "p_partkey long, p_size int").write.mode("overwrite").parquet(f"{parts}/part.parquet")
    got = relational_queries.QUERIES[name](spark, parts)
    assert sorted(map(tuple, got.collect())) == answer(parts, relational_queries.ORACLE_SQL[name], "lineitem", "part")
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_ways_are_put_together_from_leaps(spark, monkeypatch):
    rows, plain = {}, supersteps.written
    monkeypatch.setattr(supersteps, "written", lambda df, name="step": rows.setdefault(name, []).append(df.count()) or plain(df, name))
    links = spark.createDataFrame([(k, k - 1 if k % 1000 else None) for k in range(2000)], "id long, parent long")
    ends = [999, 998, 700, 1300, 0]
    got = supersteps.paths_along(links, spark.createDataFrame([(k,) for k in ends], "id long")).collect()
    assert sorted((r.goal, r.hop, r.id) for r in got) == sorted((e, h, e - h) for e in ends for h in range(e % 1000 + 1))
    assert max(rows["ways"]) == sum(e % 1000 // 256 + 1 for e in ends)
