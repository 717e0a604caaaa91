"""Operators over literal inputs against the rows they state, and every registered query with SQL against that SQL over the smallest tables."""

import glob
import os

import duckdb
import pytest

from lattica import catalog

from .stated_rows import CASES

TABLES = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", CASES)
def test_rows_are_those_stated(spark, name):
    case, sql = CASES[name]
    out, want = case(spark, ""), duckdb.sql(sql)
    assert sorted(out.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in out.collect()], out.columns) == plain(want.fetchall(), want.columns)


NEW = ("depths_from_suppliers", "weighted_distances", "topological_layers", "passages_held", "words_held", "greedy_merges", "similarity_pairs", "missing_elements")


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", NEW)
def test_rows_are_those_of_the_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    out, want = catalog.queries()[name](spark, TABLES), db.sql(catalog.oracle_sql()[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in out.collect()], out.columns) == plain(want.fetchall(), want.columns)


def test_no_query_ignores_its_tables():
    class Unread(Exception):
        pass

    class Session:
        def __getattr__(self, name):
            raise Unread

    for f in catalog.queries().values():
        with pytest.raises(Unread):
            f(Session(), TABLES)
