"""Every registered query of the library against its SQL, and the plans' shape."""

import os

import duckdb
import pytest

from momentlens import catalog

SF = "/root/testdata/sf0.001"
#: Queries on time, whose rounding shows on more rows only.
TIMED = ["r1_live_windows", "r2_live_segments", "r5_live_alerts", "r7_chat_bursts", "w5_rolling_zscore", "w20_chat_features", "w23_trailing_avg", "a1_chat_window_stats"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple("None" if x is None or x != x else str(round(x, 6) if isinstance(x, float) else x) for x in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, sql, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), sql.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", TIMED)
def test_timed_query_agrees_on_more_rows(spark, name):
    con, larger = duckdb.connect(), SF.replace("0.001", "0.01")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{larger}/events.parquet')")
    got, want = catalog.queries()[name](spark, larger).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["j1_interval_join", "j2_point_in_interval", "j7_integrate", "w3_sliding_pipeline"])
def test_interval_joins_have_no_nested_loop(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_the_entry_is_read_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0
