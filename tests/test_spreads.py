"""Spreads of an order's lines at a rounding's bound: summed line by line, as SQL does on a table in that order."""

import duckdb

from tests.conftest import same
from verdure.plans import catalogue

LINES = [(12306, 1, 15.0, 56268.13, 0.08, 0.08), (12306, 2, 12.0, 31945.49, 0.07, 0.03), (12306, 3, 50.0, 86298.11, 0.01, 0.0), (12306, 4, 44.0, 24681.09, 0.02, 0.04), (112050, 2, 11.0, 25137.43, 0.05, 0.02), (112050, 3, 19.0, 41720.97, 0.02, 0.02), (112050, 4, 19.0, 60623.43, 0.01, 0.03), (112050, 7, 19.0, 102643.0, 0.06, 0.06)]


def test_quality_check_at_a_bound(spark, tmp_path):
    kinds = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(LINES, kinds).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalogue.queries()["quality_check"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet') order by l_orderkey, l_linenumber")
    columns = sorted(df.columns)
    assert same((tuple(r) for r in df.select(*columns).collect()), duck.sql(catalogue.oracle_sql()["quality_check"]), columns)
