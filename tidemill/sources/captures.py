"""Reading captures and writing mirrors. Nothing here fetches: pages, assets, responses and robots files are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from . import mirror


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages (page_id, url, html, ...)."""
    return spark.read.parquet(path)


def assets(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Stored files as (path, content, size), with the reader's pushdown of names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", "content", F.col("length").alias("size"))


def archived(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(path, content, size) of the records of one type in a folder of archives, read in ranges of bytes. Unlike ``assets`` and
    ``style_sheets``, which read files that others stored one by one, the driver lists archives here, not rows."""
    return mirror.archive(spark, folder).filter(F.col("type") == kind).select(F.col("url").alias("path"), F.col("body").alias("content"), F.col("length").alias("size"))


def style_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """(path, body) of the .css files in a folder."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.css").select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def robots(files: DataFrame) -> DataFrame:
    """(host, content) of captured robots files (host, status, content); a failed one has no rules, so allows all."""
    return files.filter(F.coalesce("status", F.lit(200)) < 400).select("host", F.coalesce("content", F.lit("")).alias("content"))


def served(requests: DataFrame, files: DataFrame, root: str = "index.html") -> DataFrame:
    """(path, file, status) of a local server: the query goes; /, folders and missing files are the root's index (200),
    and 404 where that is missing too. files: path."""
    clean = F.regexp_replace(F.regexp_replace("path", r"\?[\s\S]*$", ""), "^/", "")
    asked = requests.withColumn("_want", F.when((clean == "") | clean.endswith("/"), F.lit(root)).otherwise(clean))
    known = files.select(F.col("path").alias("_f")).distinct()
    both = asked.join(known, F.col("_want") == F.col("_f"), "left")
    index = known.filter(F.col("_f") == root).select(F.lit(True).alias("_has"), F.lit(1).alias("_j"))
    both = both.withColumn("_j", F.lit(1)).join(index, "_j", "left")  # one row at most
    file = F.coalesce("_f", F.when(F.col("_has"), F.lit(root)))
    return both.select("path", file.alias("file"), F.when(file.isNull(), 404).otherwise(200).alias("status"))


# -- sinks ----------------------------------------------------------------------------------------------------------
def write_pages(rows: DataFrame, path: str) -> None:
    """(path, html) as a table."""
    rows.write.mode("overwrite").parquet(path)


def write_assets(rows: DataFrame, path: str) -> None:
    """Stored assets by folder; rows that only repeat a content have none of their own."""
    rows.filter("is_new").withColumn("folder", F.regexp_extract("canonical_path", "^assets/([^/]+)/", 1)).write.mode("overwrite").partitionBy("folder").parquet(path)


def write_rewritten(rows: DataFrame, path: str) -> None:
    """A second table beside the captured one: Spark does not overwrite what it reads."""
    rows.write.mode("overwrite").parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON document."""
    manifest.coalesce(1).write.mode("overwrite").text(path)


def stored_page(url: Column, html: Column) -> Column:
    """Path and size (characters) of a page when stored."""
    return F.struct(paths.page_path(url).alias("path"), F.length(html).cast("long").alias("bytes"))
