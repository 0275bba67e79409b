"""Every registered query that has SQL gives its rows."""

import duckdb
import pytest

from vitrine.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


def shown(value):
    if isinstance(value, list):
        return str([shown(x) for x in value])
    if value is None or value != value:
        return "NULL"
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in found.collect()]
    if name not in registry.SQL:
        assert rows
        return
    result = duck.execute(registry.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    keys = sorted(columns)
    want = sorted(tuple(shown(r[columns.index(k)]) for k in keys) for r in result.fetchall())
    assert sorted(tuple(shown(r[k]) for k in keys) for r in rows) == want


def test_cards_read_the_whole_table(spark, tmp_path):
    names = [(1, "Brand#1", "red rod", 3), (2, "Brand#1", "old rod", 3), (19_999, "Brand#1", "red rod", 3), (20_000, "Brand#1", "hot gizmo", 4)]
    spark.createDataFrame(names, "p_partkey long, p_brand string, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert {r.pos for r in registry.QUERIES["ensemble_card"](spark, str(tmp_path)).collect()} == {2, 19_999, 20_000}
    assert [r.pos for r in registry.QUERIES["best_by_avg"](spark, str(tmp_path)).collect()] == [19_999]
