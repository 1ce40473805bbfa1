import os

import duckdb
import pytest

from mulberry.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
COLUMNS = {"p2_found": ["id_a", "id_b"], "p3_found": ["id_a", "id_b"], "p4_found": ["id"], "p5_found": ["id", "domain"], "p6_found": ["group_id", "field", "id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert name not in COLUMNS or rows
    if name in SQL:
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
        told = c.execute(SQL[name])
        order = [d[0] for d in told.description]
        assert sorted(tuple(str(r[n]) for n in order) for r in rows) == sorted(tuple(map(str, r)) for r in told.fetchall())
