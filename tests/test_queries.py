"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = {n: s for n, s in entry.oracle_sql().items() if n.startswith(("q_", "p1_"))}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    told = db.execute(SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in told.fetchall())


# what must hold of the rows of queries that SQL can't express
INVARIANTS = {
    "q_structured_chunks": ({"id", "parent_id", "domain", "source", "version", "page", "kind", "title", "child_text", "embedding_text", "element"}, lambda r: 0 < len(r.child_text) <= 420 and r.embedding_text.endswith(r.child_text)),
    "q_near_dup_ratio": ({"id_a", "id_b", "ratio"}, lambda r: r.id_a < r.id_b and 0.85 <= r.ratio <= 1),
    "q_ltr_train": ({"feature", "mean", "scale", "coef"}, lambda r: r.scale >= 0 and abs(r.coef) < 100),
    "q_exam_questions": ({"doc", "ord", "num", "stem", "options", "answer", "analysis", "needs_review"}, lambda r: r.ord >= 1 and r.needs_review == (r.answer == "") and set(r.answer) <= set("ABCD")),
}


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith(("q_", "p1_")) and n not in SQL))
def test_rows_of_the_others(spark, name):
    columns, holds = INVARIANTS[name]
    rows = entry.queries()[name](spark, DATA).collect()
    assert rows and set(rows[0].asDict()) == columns and all(map(holds, rows))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
