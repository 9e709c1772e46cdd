"""Each rule of the contracts finds the rows that break it, and no others."""

import duckdb
import pytest
import rule_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(rule_rows.EXPECTED))
def test_reasons(spark, name):
    rows = rule_rows.TABLES[name](spark, SF) if name in rule_rows.TABLES else rule_rows.EVENTS[name](rule_rows.table(spark, SF, "events"))
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = sorted(rows.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({rule_rows.EXPECTED[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in rows.select(*columns).collect()))) == sorted(map(str, want))
