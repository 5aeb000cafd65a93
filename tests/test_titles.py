"""Titles that are cut off within a character reference, against the SQL of the queries that show them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.plans import queries

TITLES = ["a &amp", "b &amp;&am", "&lt", "&#39", "x &amp; y &#39;z&#39; &copy", "&amp;lt; &nbsp;&middot;", "&"]


def test_references_that_need_a_semicolon(spark):
    values = {"&amp": "&amp", "&amp;": "&", "&ampx;": "&ampx;", "&#65": "&#65", "&#65;b": "Ab", "&#x41;&#x41": "A&#x41", "&notin;&not": "∉&not", "&nosuch;": "&nosuch;", "&&lt;": "&<", "&amp;lt;": "&lt;"}
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    assert [r.y for r in rows.select(text.decode_entities(F.col("x"), closed=True).alias("y")).collect()] == list(values.values())


@pytest.mark.parametrize("name", ["page_title", "page_records"])
def test_titles_that_are_cut_off(spark, tmp_path, name):
    rows = [(i, f"https://a.example.com/p/{i}", f"<html><head><title>{t}</title></head><body><a href='/x'>t</a></body></html>") for i, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
