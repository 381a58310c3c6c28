import duckdb
import pytest

from tessera.llm import catalog

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_rows_and_types_agree(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    kinds = {c: t for c, t, *_ in con.execute(f"DESCRIBE {catalog.ORACLE[name]}").fetchall()}
    assert kinds == {c: TYPES[t] for c, t in df.dtypes}
    order = sorted(kinds)
    want = con.execute(f"SELECT {', '.join(order)} FROM ({catalog.ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*order).collect()))) == sorted(map(repr, want))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
