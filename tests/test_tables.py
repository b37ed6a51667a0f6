"""Writes to a database that comes with Spark: each row once, all rows or none."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodemill.sources import tables

SCHEMA = "ID bigint, NAME string, N int"


@pytest.fixture
def url(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    with tables._connection(spark, url, None) as run:
        run(["create table ITEMS (ID bigint not null primary key, NAME varchar(100), N int)", "insert into ITEMS values (1, 'one', 1), (2, 'two', 2), (3, 'three', 3)"])
    return url


def items(spark, url):
    return {r["ID"]: (r["NAME"], r["N"]) for r in tables.read_jdbc(spark, url, "ITEMS").collect()}


def left_over(spark, url):
    return [r[0] for r in tables.read_jdbc(spark, url, "SYS.SYSTABLES").select("TABLENAME").collect() if r[0].startswith("ITEMS_")]


def test_rows_are_taken_in_once(spark, url):
    rows = spark.createDataFrame([(2, "zwei", None), (4, "vier", 4), (4, "vier", 4), (5, "b", 1), (5, "a", 9), (None, "x", 0)], SCHEMA).repartition(4)
    want = {1: ("one", 1), 2: ("zwei", None), 3: ("three", 3), 4: ("vier", 4), 5: ("a", 9)}
    for _ in range(2):
        tables.upsert_jdbc(rows, url, "ITEMS", ["ID"])
        assert items(spark, url) == want and not left_over(spark, url)
    tables.upsert_jdbc(spark.createDataFrame([(4, "four", None), (6, "six", None)], SCHEMA), url, "ITEMS", ["ID"], null_keeps=True)
    assert items(spark, url) == want | {4: ("four", 4), 6: ("six", None)}
    tables.upsert_jdbc(spark.createDataFrame([], SCHEMA), url, "ITEMS", ["ID"])
    tables.upsert_jdbc(spark.range(6, 8).select(F.col("id").alias("ID")), url, "ITEMS", ["ID"])
    assert len(items(spark, url)) == 7


def test_a_task_that_fails_half_way_leaves_nothing(spark, url, tmp_path):
    before = items(spark, url)
    failing = spark.range(0, 400, 1, 4).select(F.col("id").alias("ID"), F.when(F.col("id") == 333, F.raise_error(F.lit("broken"))).otherwise(F.lit("new")).alias("NAME"), F.lit(0).alias("N"))
    with pytest.raises(Exception, match="broken"):
        tables.upsert_jdbc(failing, url, "ITEMS", ["ID"], batch=10)
    assert items(spark, url) == before and not left_over(spark, url)
    tables.upsert_jdbc(failing.where("ID != 333"), url, "ITEMS", ["ID"], batch=10)
    assert len(items(spark, url)) == 399 and items(spark, url)[1] == ("new", 0)
    with pytest.raises(Exception):
        tables.upsert_jdbc(failing.where("ID < 9").withColumn("NAME", F.repeat(F.lit("long"), 100)), url, "ITEMS", ["ID"])
    assert len(items(spark, url)) == 399 and not left_over(spark, url)


def test_what_a_task_wrote_twice_counts_once(spark, url, monkeypatch):
    write = tables.write_jdbc
    monkeypatch.setattr(tables, "write_jdbc", lambda df, *how: [write(df, *how) for _ in range(2)])  # as if all tasks had been lost after their commit
    tables.upsert_jdbc(spark.createDataFrame([(1, "eins", 1), (9, "neun", 9)], SCHEMA), url, "ITEMS", ["ID"])
    assert items(spark, url) == {1: ("eins", 1), 2: ("two", 2), 3: ("three", 3), 9: ("neun", 9)}


def test_statements_of_other_databases():
    columns = ["id", "a", "b"]
    assert tables.upsert_statement("jdbc:mysql://x", "t", "s", ["id"], columns) == "insert into t (id, a, b) select id, a, b from s on duplicate key update a = values(a), b = values(b)"
    assert tables.upsert_statement("jdbc:postgresql://x", "t", "s", ["id"], columns, True) == "merge into t t using s s on t.id = s.id when matched then update set a = coalesce(s.a, t.a), b = coalesce(s.b, t.b) when not matched then insert (id, a, b) values (s.id, s.a, s.b)"
