import importlib.util

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_names():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 80


def test_entry(spark):
    assert entry.entry(spark).columns == ["from_state", "to_state", "prob", "cnt"]


def same(spark, folder, name):
    """Spark's rows beside DuckDB's, whatever their order."""
    import glob
    import os

    import duckdb

    db = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = db.sql(entry.oracle_sql()[name])
    cols = sorted(want.columns)
    got = entry.queries()[name](spark, folder)
    assert sorted(got.columns) == cols

    def plain(rows):
        return sorted((tuple("~" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows))

    assert plain(map(tuple, got.select(*[f"`{c}`" for c in cols]).collect())) == plain(db.sql(entry.oracle_sql()[name]).select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", ["canonical_events", "session_attribution", *(f"cube_{c}" for c in ("session", "transition", "action", "cond_transition", "path", "quality")), "determinism", "stationary", "action_information", "markov_order_flow", "decompose_parts", "per_service_transition", "modularity_of_services", "paths_within_services", "dict_screens_approx_error"])
def test_against_sql(spark, name):
    same(spark, FOLDER, name)


def test_without_the_text_subpackage(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n == "pathloom.llm" else find(n, *a))
    assert not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
