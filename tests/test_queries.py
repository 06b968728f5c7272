"""Every registered query with SQL gives what DuckDB gives; the rest run."""

import math
import os

import duckdb
import pytest

from wayfold import column_queries, queries, registry  # noqa: F401  both register their queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


def same(spark, duck, name, found, sql):
    columns = sorted(found.columns)
    got = sorted(tuple(map(plain, r)) for r in found.select(columns).collect())
    assert sorted(duck.sql(sql).columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(tuple(map(plain, r)) for r in duck.sql(f"SELECT {quoted} FROM ({sql})").fetchall()), name


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    if name in registry.SQL:
        same(spark, duck, name, found, registry.SQL[name])
    else:
        assert found.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 402
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("name", "module", "operator"), [("unexpected_keys", "governance", "unexpected"), ("first_reaching", "batch", "suggestion"), ("session_windows", "sessions", "sessions")])
def test_queries_call_the_operators_they_are_listed_for(spark, monkeypatch, name, module, operator):
    called = []
    owner = getattr(queries, module)
    whole = getattr(owner, operator)
    monkeypatch.setattr(owner, operator, lambda *a, **b: called.append(operator) or whole(*a, **b))
    registry.QUERIES[name](spark, SF)
    assert called == [operator]


def on(duck_tables, folder, name, spark):
    """The query over tables written into ``folder`` against its SQL on the same."""
    import pyarrow.parquet as pq

    c = duckdb.connect()
    for table, rows in duck_tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    same(spark, c, name, registry.QUERIES[name](spark, str(folder)), registry.SQL[name])


def recorded(rows):
    """Events of (user_id, seconds, type, value)."""
    import pyarrow as pa

    user, at, kind, value = zip(*rows, strict=True)
    return {"events": pa.table({"event_id": list(range(len(rows))), "ts": pa.array([x * 1_000_000 for x in at], pa.timestamp("us")), "user_id": list(user), "event_type": list(kind), "value": list(map(float, value))})}


@pytest.mark.parametrize("name", ["laps", "top5_plus_best"])
def test_laps_of_tracks_that_start_on_a_multiple(spark, tmp_path, name):
    values = [0, 300, 300, 500, 0, 450, 100, 700, 900, 600, 600, 600]
    on(recorded([(u, i * 3600, "view", v + (500 if u == 2 and i == 0 else 0)) for u in (1, 2, 3) for i, v in enumerate(values[: 3 if u == 3 else None])]), tmp_path, name, spark)


def test_null_scans_of_lags_with_equal_scores(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = []
    for user in range(300):
        # two clicks within one gap of the rest: what they differ by is the same at every lag that leaves both in one gap
        start = rng.uniform(0, 86400)
        rows += [(user, start + k * 50 * 3600 * 0.9, "view", round(rng.expovariate(1 / 50), 2)) for k in range(14)]
        rows += [(user, start + 7 * 45 * 3600 * 0.98 + k * 3600 * rng.uniform(1, 2), "click", round(rng.expovariate(1 / 50), 2)) for k in (0, 1)]
    on(recorded([(u, int(t), e, v) for u, t, e, v in rows]), tmp_path, "null_scans", spark)


def test_unexpected_keys_test_no_pair_of_values_by_their_file_alone(spark):
    plan = registry.QUERIES["unexpected_keys"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert all("," in n.split("[")[1].split("]")[0] for n in plan.splitlines() if "Contains(" in n and "Join" in n)


def test_interp_grid_sorts_and_shuffles_its_data_only(spark):
    plan = registry.QUERIES["interp_grid"](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    made = next(i for i, n in enumerate(plan) if "Generate explode" in n)
    assert not any("Exchange" in n or "Sort [" in n for n in plan[:made])


def test_interp_grid_of_ties_gaps_and_single_points(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows = [(user, at, "view", round(rng.uniform(0, 100), 2)) for user in range(40) for at in rng.sample([0, 3600, 7200, 7201, 9000, 43200, 46800, 50400, 50401, 90000, 200000, 208800, 252000, 252001], 1 + user % 14)]
    on(recorded([r for r in rows for _ in range(1 + (r[0] == 7))]), tmp_path, "interp_grid", spark)


@pytest.mark.parametrize("name", ["correction_path", "diagnostics_report", "zoom_plan", "heading_rates"])
def test_tasks_of_smoothed_rows_are_bounded(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [n for n in plan.splitlines() if "Exchange " in n]
    assert dealt and all("REPARTITION_BY_NUM" in n for n in dealt)


def test_tasks_grow_with_rows(spark):
    from wayfold.operators import chunks

    df = spark.range(10)
    assert chunks.tasks_of(df) == 1 and chunks.tasks_of(df, 100_000_000) == 400 and chunks.tasks_of(df, 100_000) == spark.sparkContext.defaultParallelism


def test_mesh_field_shuffles_features_only(spark):
    plan = registry.QUERIES["mesh_field"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange " in n for n in plan.splitlines()) == 1


def test_medians_sort_rows_in_tasks_of_bounded_size_only(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["medians"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan
