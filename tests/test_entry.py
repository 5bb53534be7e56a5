"""The driver's contract, and each query against its SQL."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from neumes.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].reset_index(drop=True)
    for c in frame.columns:
        values = frame[c].astype(object)
        if pd.api.types.is_numeric_dtype(frame[c].dtype) and not pd.api.types.is_bool_dtype(frame[c].dtype):  # integers with nulls may come as floats
            frame[c] = pd.Series([None if pd.isna(v) else round(float(v), 5) for v in values], dtype=object)
        else:
            frame[c] = pd.Series([None if pd.isna(v) else str(v) for v in values], dtype=object)
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLES[name]).fetchdf())


def test_every_query_has_sql():
    """All but the distances of whole texts, for which SQL takes the square of their lengths; test_whole_texts.py has a plain table for it."""
    assert set(QUERIES) - set(ORACLES) == {"model_error_rates"} and set(ORACLES) <= set(QUERIES)


def test_types_are_those_of_the_sql(spark, duck):
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name in sorted(ORACLES):
        ours = {f.name: kinds.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in QUERIES[name](spark, SF).schema.fields}
        assert ours == {r[0]: r[1] for r in duck.execute("DESCRIBE " + ORACLES[name]).fetchall()}, name


@pytest.mark.parametrize("missing", ["xxhash", "neumes.llm", "corpus_pipeline"])
def test_entry_without_the_training_data_part(missing):
    """In a process of its own, where a module cannot be imported."""
    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; print(len([q for q in e.queries() if not q.startswith('op') and q != 'pipeline']), sum(q.startswith('op') for q in e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    plain, ops = map(int, subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split())
    assert plain == len(QUERIES) and ops in ((0, 13) if missing == "corpus_pipeline" else (0,))


def test_entry(spark):
    found = driver.entry(spark)
    assert {r.model for r in found.collect()} == {"light", "heavy"}
    assert set(driver.oracle_sql()) <= set(driver.queries()) and set(QUERIES) <= set(driver.queries())


def test_library_does_not_need_the_training_data_part():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "neumes")):
        if os.path.basename(folder) != "llm" and f"{os.sep}llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "llm" not in text.read(), f


def test_plans_stay_on_the_jvm(spark):
    """No Python on the hot paths that Columns express; width bands and overlaps are equi-joins."""
    plan = lambda n: QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for name in ("segmented_staves", "annotation_decode", "spine_extract", "span_islands", "interval_overlap_match", "boundary_distance", "replay_sample", "stage_eligibility"):
        assert "Python" not in plan(name) and "Arrow" not in plan(name), name
    for name in ("width_band_pool", "width_pairs", "interval_overlap_match", "iou_dedup_pairs"):
        assert "NestedLoop" not in plan(name) and "Cartesian" not in plan(name), name
    scan = plan("scan_project_filter")
    assert "PushedFilters: [IsNotNull(l_quantity)" in scan and "l_comment" not in scan
