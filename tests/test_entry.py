import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tagweave.plans.queries import QUERIES
from tagweave.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "kind", "pos", "pat", "n", "cmd"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) == set(QUERIES) & set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    cols = df.columns
    got = Counter(tuple(r[c] for c in sorted(cols)) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == sorted(cols)
    idx = [dcols.index(c) for c in sorted(cols)]
    want = Counter(tuple(r[i] for i in idx) for r in cur.fetchall())
    assert got == want


def test_entry_works_without_the_optional_parts(tmp_path):
    """The same queries are there when the training-data folder and pipeline are gone."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "tagweave", tmp_path / "tagweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [*sorted(QUERIES), str(len(QUERIES))]
