"""Queries on tables whose shape larger copies of the given ones have, against their SQL."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from markerloom.operators import distrib
from markerloom.plans import queries
from markerloom.types import Groups


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    found = queries.QUERIES[name](spark, str(folder))
    expected = con.sql(queries.ORACLES[name])
    assert found.columns == expected.columns
    rows = sorted(map(tuple, found.collect()), key=repr)
    assert rows == sorted(expected.fetchall(), key=repr)
    return rows


@pytest.mark.parametrize("people, retained", [(100, None), (20, 10)])
def test_depth_where_no_part_has_enough_suppliers(spark, tmp_path, people, retained):
    suppliers = [{"s_suppkey": k, "s_nationkey": k % 3} for k in range(people)]
    items = [{"l_partkey": k // 2, "l_suppkey": k} for k in range(20) for _ in range(k % 4 + 1)]
    rows = same_as_sql(spark, tmp_path, "depth_stats_ps", supplier=suppliers, lineitem=items)
    assert {r[4] for r in rows} == {retained}


def events(people):
    return [{"event_id": u, "user_id": u, "event_type": "view", "ts": datetime.datetime(2024, 1, 1, u % 5)} for u in range(people)]


@pytest.mark.parametrize("block", [1 << 12, 4])
def test_grid_of_cells(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(distrib, "BLOCK", block)
    assert len(same_as_sql(spark, tmp_path, "distrib_grid_ev", events=events(23))) == 13 * 12 - 1


def test_no_cell_of_the_grid_is_shuffled(spark):
    seen = spark.createDataFrame([(3, 5, 2, 9), (3, 700, 7, 9)], "g1 int, g2 int, markers long, n_markers long")
    assert distrib.with_empty_cells(seen, Groups("a", "b", 9, 999)).count() == 10 * 1000
    plan = distrib.with_empty_cells(seen, Groups("a", "b", 9, 999))._jdf.queryExecution().executedPlan().toString()
    # The last step that makes cells is above all shuffles.
    assert "Generate" in plan and "Exchange" not in plan[: plan.index("Generate")].replace("BroadcastExchange", "")


@pytest.mark.parametrize("few", [1, 1000])
def test_no_block_of_the_grid_is_shuffled_where_few_cells_were_seen(spark, monkeypatch, few):
    monkeypatch.setattr(distrib, "BROADCAST_CELLS", few)
    monkeypatch.setattr(distrib, "BLOCK", 16)
    seen = spark.createDataFrame([(3, 5, 2, 9), (3, 70, 7, 9), (0, 0, 1, 9)], "g1 int, g2 int, markers long, n_markers long")
    grid = distrib.with_empty_cells(seen, Groups("a", "b", 9, 99))
    rows = {(r.g1, r.g2): r.markers for r in grid.collect()}
    assert grid.count() == len(rows) == 1000 and {k: n for k, n in rows.items() if n} == {(3, 5): 2, (3, 70): 7, (0, 0): 1}
    plan = distrib.with_empty_cells(seen, Groups("a", "b", 9, 99))._jdf.queryExecution().executedPlan().toString()
    assert ("REPARTITION_BY_NUM" in plan) == (few == 1)
