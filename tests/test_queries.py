"""Queries against their SQL on the small tables."""

import math
import os

import duckdb
import pytest

from docgrid.plans import queries, report_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = queries.QUERIES | report_queries.QUERIES, queries.ORACLE | report_queries.ORACLE
TABLES = "nation customer supplier part orders lineitem documents".split()
#: These render all invoices; together they take minutes.
SLOW = {"header_detect", "column_naming", "column_bands_header", "box_to_column", "items_positional", "items_discarded", "items_conflicts", "mode_summary"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(rows):
    return sorted((tuple(None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW or os.environ.get("TEST_SLOW")])
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    want = [[r[names.index(c)] for c in columns] for r in cursor.fetchall()]
    assert sorted(names) == columns and normal(map(tuple, df.select(columns).collect())) == normal(want)
