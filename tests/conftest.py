import os
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Run a query in Spark and its SQL in DuckDB and compare columns, rows and values."""

    def check(query, sql):
        got = query(spark, SF).toPandas()
        con = duckdb.connect()
        for t in os.listdir(SF):
            con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
        want = con.sql(sql).df()
        names = sorted(want.columns)
        assert sorted(got.columns) == names
        plain = lambda df: sorted(map(repr, df[names].astype(object).where(df[names].notna(), None).map(lambda v: v.item() if hasattr(v, "item") else v).values.tolist()))
        assert plain(got) == plain(want)

    return check
