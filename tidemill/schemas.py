"""Record types of a site capture as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _i, _b = T.StringType(), T.LongType(), T.IntegerType(), T.BinaryType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, not rest) for name, kind, *rest in fields])


#: Asset types; no other value of ``type`` is produced.
ASSET_TYPES = ("html", "css", "js", "image", "font", "media", "api", "document", "unknown")
PARSED_URL = _struct(*((c, _s) for c in ("original", "normalized", "protocol", "hostname", "port", "pathname", "search", "hash")))
PAGE_URL = T.StructType([*PARSED_URL.fields, T.StructField("depth", _i, False), T.StructField("parent_url", _s)])
HEADERS = T.MapType(_s, _s)
ASSET = _struct(("url", _s), ("type", _s), ("mime_type", _s), ("size", _l), ("hash", _s), ("content", _b), ("headers", HEADERS), ("status", _i))
DOWNLOADED_ASSET = T.StructType([*ASSET.fields, T.StructField("local_path", _s), T.StructField("downloaded_at", T.TimestampType())])
PAGE = _struct(("url", _s), ("html", _s), ("title", _s), ("status", _i), ("fetched_at", T.TimestampType()))
PAGE_LINK = _struct(("src", _s), ("dst", _s), ("pos", _i))
PAGE_ASSET = _struct(("page", _s), ("url", _s), ("type", _s), ("pos", _i))
NETWORK_REQUEST = _struct(("id", _s), ("nav_id", _l), ("url", _s), ("method", _s), ("type", _s), ("mime_type", _s), ("headers", HEADERS), ("ts", T.TimestampType()))
NETWORK_RESPONSE = _struct(
    ("id", _s), ("nav_id", _l), ("url", _s), ("method", _s), ("mime_type", _s), ("status", _i), ("size", _l), ("headers", HEADERS), ("body", _b),
    ("timing", _struct(("start_time", _l), ("end_time", _l), ("duration", _l))), ("ts", T.TimestampType()),
)
QUEUE_ITEM = _struct(("url", _s), ("depth", _i), ("parent", _s), ("priority", _i), ("retry", _i), ("ord", _l))
FILE_MANIFEST = _struct(
    ("version", _s), ("base_url", _s), ("generated_at", _s),
    ("pages", T.ArrayType(_struct(("url", _s), ("path", _s)))), ("assets", T.ArrayType(_struct(("url", _s), ("path", _s), ("hash", _s)))),
)
URL_MAP = _struct(("url", _s), ("local_path", _s))
ROBOTS_RULE = _struct(("host", _s), ("kind", _s), ("pattern", _s), ("pos", _i))
SPA_EVENT = _struct(("type", _s), ("url", _s), ("timestamp", _l))
NAVIGATION = _struct(("url", _s), ("html", _s), ("status", _i), ("title", _s))
FAILURE = _struct(("url", _s), ("error_code", _s), ("error_message", _s))
