"""Every query that SQL can express gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from orbweave import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    want = rows(columns, rel.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want) and got
    bad = [(a, b) for a, b in zip(got, want, strict=True) if any(x != y and not (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4)) for x, y in zip(a, b, strict=True))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_parts():
    """The driver may take the corpus subpackage and its pipeline away."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['orbweave.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'score_base' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)
