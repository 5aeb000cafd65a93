"""Manifests of what was stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pages(stored: DataFrame) -> DataFrame:
    return stored.select("ord", "url", "path")


def assets(stored: DataFrame, with_size: bool = False) -> DataFrame:
    """(ord, url, path, hash), or size in place of the hash."""
    return stored.select("ord", "url", "path", "size" if with_size else "hash")


def collisions(stored: DataFrame) -> DataFrame:
    """(path, urls): paths that several pages share, so that later ones overwrite earlier ones."""
    return stored.groupBy("path").agg(F.count("*").alias("urls")).filter("urls > 1")


def manifest(page_rows: DataFrame, asset_rows: DataFrame, base_url: str, generated_at: str | None = None) -> DataFrame:
    """One row of JSON text: version, baseUrl, generatedAt and both lists in order. A manifest is one document by nature:
    its lists are bounded by what one file may name."""
    fields = [c for c in asset_rows.columns if c != "ord"]
    listed = lambda df, cols, out: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *cols))), lambda x: F.struct(*(x[c].alias(c) for c in cols))).alias(out)).withColumn("_j", F.lit(1))
    both = listed(page_rows, ["url", "path"], "pages").join(listed(asset_rows, fields, "assets"), "_j")
    when = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return both.select(F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit(base_url).alias("baseUrl"), when.alias("generatedAt"), "pages", "assets")).alias("json"))


def by_site(page_rows: DataFrame, asset_rows: DataFrame, generated_at: str | None = None) -> DataFrame:
    """(site, json): a manifest for each site of pages (site, ord, url, path) and assets (site, ord, url, path, hash). Its rows
    meet by site, so a mirror of many sites is never one document."""

    def listed(df: DataFrame, cols: list[str], out: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("ord", *cols)))  # of one site: what its document holds
        return df.groupBy("site").agg(F.transform(ordered, lambda x: F.struct(*(x[c].alias(c) for c in cols))).alias(out))

    both = listed(page_rows, ["url", "path"], "pages").join(listed(asset_rows, ["url", "path", "hash"], "assets"), "site", "left")
    when = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    none = F.array().cast(both.schema["assets"].dataType)
    return both.select("site", F.to_json(F.struct(F.lit("1.0").alias("version"), F.col("site").alias("baseUrl"), when.alias("generatedAt"), "pages", F.coalesce("assets", none).alias("assets"))).alias("json"))
