import duckdb
import pytest

from spindrift.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_every_query_has_a_stable_schema(spark):
    for name, f in registry.QUERIES.items():
        assert f(spark, SF).columns, name


def test_reputation_decides_as_the_sql_does(spark, tmp_path):
    """Outcomes that depend on hosts, as the driver's do not: the posterior blocks some hosts, the same in both engines."""
    pages = [(i, f"https://h{i * 7 % 23}.site{i * 7 % 23 % 5}.{['com', 'org', 'co.uk'][i * 7 % 23 % 3]}/x/{i}") for i in range(1200)] + [(5, "https://h5.site0.co.uk/x/5"), (None, None)]
    labels = [(i, None if i % 50 == 0 else int((i * 31 % 97) / 97 < [0.95, 0.9, 0.2, 0.8][i * 7 % 23 % 4]), 0) for i in range(1100)]
    for name, rows, schema in (("pages", pages, "page_id long, url string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = con.execute(registry.ORACLES["op8_urlrep"])
    names = [d[0] for d in found.description]
    got = registry.QUERIES["op8_urlrep"](spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got))) == sorted(map(str, found.fetchall()))
    blocked = {r.host for r in got if r.verdict == "block" and r.rule is None}
    assert blocked and all(int(h.split(".")[0][1:]) % 4 == 2 for h in blocked) and len(blocked) < 23
