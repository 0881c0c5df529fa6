import duckdb

from hirameki.plans.catalog import ORACLES, QUERIES


def test_perplexities_of_repeated_and_null_keys(spark, tmp_path):
    orders = [1, 1, 1, 2, 3, 3, None, None, 4]
    items = [(1, 0.02), (1, 0.07), (1, None), (2, 0.0), (3, None), (3, None), (None, 0.05), (5, 0.01)]
    tables = {"orders": spark.createDataFrame([(k,) for k in orders], "o_orderkey long"), "lineitem": spark.createDataFrame(items, "l_orderkey long, l_tax double")}
    with duckdb.connect() as db:
        for name, rows in tables.items():
            rows.write.parquet(f"{tmp_path}/{name}.parquet")
            db.sql(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = db.sql(ORACLES["ppl_fields"]).fetchall()
    got = [tuple(r) for r in QUERIES["ppl_fields"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 5
