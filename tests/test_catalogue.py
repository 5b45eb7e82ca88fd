"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from scanfold.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = catalogue.queries()[name](spark, sf_dir)
    want = con.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert _rows(df.columns, df.collect()) == _rows(cols, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry_without_the_llm_subpackage(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    with monkeypatch.context() as m:
        for name in [n for n in sys.modules if n.startswith("scanfold.llm")]:
            m.delitem(sys.modules, name)
        for name in ("scanfold.llm", "scanfold.llm.queries", "corpus_pipeline"):
            m.setitem(sys.modules, name, None)
        importlib.reload(entry)
        assert set(entry.queries()) == set(catalogue.queries()) and set(entry.oracle_sql()) == set(catalogue.oracle_sql())
        assert entry.entry(spark).count() > 0
    importlib.reload(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries())
