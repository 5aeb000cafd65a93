"""Asset types, MIME types and the folders that follow from them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# Extensions by asset type.
TYPE_BY_EXTENSION = {
    "html": "html", "htm": "html", "css": "css", "js": "js", "mjs": "js", "json": "api", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image",
    "svg": "image", "webp": "image", "ico": "image", "bmp": "image", "woff": "font", "woff2": "font", "ttf": "font", "otf": "font", "eot": "font",
    "mp4": "media", "webm": "media", "ogg": "media", "mp3": "media", "wav": "media", "pdf": "document", "xml": "document",
}
# Folders of stored assets by asset type, and of guessed ones by extension.
FOLDER_BY_TYPE = {"css": "css", "js": "js", "image": "img", "font": "fonts", "api": "api", "media": "media", "document": "documents"}
IMAGES, FONTS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico"), ("woff", "woff2", "ttf", "otf", "eot")
# MIME types by extension.
MIME_BY_EXTENSION = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "application/javascript", "mjs": "application/javascript", "json": "application/json",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "ico": "image/x-icon",
    "bmp": "image/bmp", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf", "eot": "application/vnd.ms-fontobject",
    "mp4": "video/mp4", "webm": "video/webm", "ogg": "audio/ogg", "mp3": "audio/mpeg", "wav": "audio/wav", "pdf": "application/pdf", "xml": "text/xml", "txt": "text/plain",
}


def looked_up(key: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*table.items()))), key), F.lit(default))


def asset_type(url: Column, mime: Column) -> Column:
    """By what the MIME type contains, else by the loose extension."""
    has = lambda x: F.coalesce(F.contains(mime, F.lit(x)), F.lit(False))
    return (
        F.when(has("html"), "html").when(has("css"), "css").when(has("javascript") | has("application/js"), "js").when(has("json"), "api")
        .when(has("image/"), "image").when(has("font/"), "font").when(has("video/") | has("audio/"), "media").when(has("application/pdf"), "document")
        .otherwise(looked_up(urls.ext_loose(url), TYPE_BY_EXTENSION, "unknown"))
    )


def asset_type_browser(url: Column, mime: Column) -> Column:
    """The variant of captures in a browser: any font MIME type, and fewer extensions."""
    has = lambda x: F.coalesce(F.contains(mime, F.lit(x)), F.lit(False))
    some = {k: v for k, v in TYPE_BY_EXTENSION.items() if k not in ("html", "htm", "mjs", "json", "pdf", "xml")}
    return (
        F.when(has("html"), "html").when(has("css"), "css").when(has("javascript"), "js").when(has("json"), "api").when(has("image/"), "image")
        .when(has("font"), "font").when(has("video/") | has("audio/"), "media").otherwise(looked_up(urls.ext_loose(url), some, "unknown"))
    )


def asset_type_short(url: Column, mime: Column) -> Column:
    """A coarser classifier; scripts are scripts here too, and extensions need not be letters only."""
    has = lambda x: F.coalesce(F.contains(mime, F.lit(x)), F.lit(False))
    some = {"css": "css", "js": "js", "mjs": "js", "json": "api"} | dict.fromkeys(IMAGES, "image") | dict.fromkeys(FONTS, "font")
    return (
        F.when(has("css"), "css").when(has("javascript"), "js").when(has("image"), "image").when(has("font"), "font").when(has("json"), "api")
        .otherwise(looked_up(urls.ext_path(url), some, "other"))
    )


def type_folder(kind: Column) -> Column:
    return looked_up(kind, FOLDER_BY_TYPE, "other")


def folder_by_extension(ext: Column) -> Column:
    return looked_up(ext, {"css": "css", "js": "js", "mjs": "js"} | dict.fromkeys(IMAGES, "img") | dict.fromkeys(FONTS, "fonts"), "other")


def url_folder(url: Column) -> Column:
    """Folder of an asset by the extension of its path."""
    return folder_by_extension(urls.ext_path(url))


def css_folder(url: Column) -> Column:
    """Guessed folder of an asset that a style sheet names; style sheets have their own."""
    return looked_up(urls.ext_path(url), {"css": "css"} | dict.fromkeys(FONTS, "fonts"), "img")


def mime_type(url: Column) -> Column:
    return looked_up(urls.ext_loose(url), MIME_BY_EXTENSION, "application/octet-stream")


def is_image(url: Column) -> Column:
    return asset_type(url, F.lit(None)) == "image"


def is_font(url: Column) -> Column:
    return asset_type(url, F.lit(None)) == "font"


def is_api_endpoint(url: Column) -> Column:
    return F.contains(url, F.lit("/api/")) | F.contains(url, F.lit("/v1/")) | F.contains(url, F.lit("/v2/"))
