"""Assets from captured responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kinds, paths
from . import filters


def from_responses(responses: DataFrame) -> DataFrame:
    """Assets of responses whose body, if they have one, can be what they say. A missing body has no hash."""
    valid = F.col("body").isNull() | filters.is_valid_content(F.col("body"), F.col("mime"), F.col("url"))
    return responses.filter(valid).select(
        "url", kinds.asset_type(F.col("url"), F.col("mime")).alias("type"), F.col("mime").alias("mime_type"), "size", paths.content_hash(F.col("body"), 16).alias("hash"), F.col("body").alias("content"), "status"
    )


def basic(contents: DataFrame) -> DataFrame:
    """Assets of (url, content binary, mime or null), unchecked; the MIME type then follows from the URL."""
    mime = F.coalesce("mime", kinds.mime_type(F.col("url")))
    return contents.select("url", kinds.asset_type(F.col("url"), F.col("mime")).alias("type"), mime.alias("mime_type"), F.octet_length("content").cast("long").alias("size"), paths.content_hash(F.col("content"), 16).alias("hash"), "content")


def limited(assets: DataFrame, most: int, types: list[str] | None = None, stored: int = 0, order: str = "ord") -> DataFrame:
    """The first assets (type, ``order``, ...) that may still be fetched: ``most`` less those ``stored`` already, of the
    wanted types, if any are named."""
    wanted = assets.filter(F.col("type").isin(*types)) if types is not None else assets
    return wanted.orderBy(order).limit(max(0, most - stored))
