import html
import random

from pyspark.sql import functions as F

from tidemill.functions import text


def decoded(spark, values, **kw):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    return [r.y for r in rows.select(text.decode_entities(F.col("x"), **kw).alias("y")).collect()]


def test_references_as_the_standard_library_has_them(spark):
    r = random.Random(1)
    parts = ["&", "&amp;", "&amp", "&notit;", "&notin;", "&not", "&copy", "&copyx", "&NotEqualTilde;", "&lt", "&lt;b", "&#65;", "&#65", "&#x1F600;", "&#x1f600z", "&#0;", "&#128;", "&#99999999999;", "&#xD800;", "&#;", "&#x;", "&nosuch;", "&frac12", "&fjlig;", "&CounterClockwiseContourIntegral;", "x", " ", ";", "é", "=", "1"]
    values = ["".join(r.choice(parts) for _ in range(r.randint(0, 6))) for _ in range(400)]
    assert decoded(spark, values) == [html.unescape(v) for v in values]
    assert decoded(spark, [None]) == [None]


def test_references_in_attributes(spark):
    values = {"?a=1&copy=2": "?a=1&copy=2", "?a&copy;": "?a©", "&copy": "©", "&copy ": "© ", "&notit;": "&notit;", "&lt1": "&lt1", "&amp&amp;b": "&&b", "&#65b": "Ab", "&#65": "A"}
    assert decoded(spark, list(values), in_attribute=True) == list(values.values())
