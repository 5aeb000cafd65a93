"""Content hashes and local paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kinds, urls


def content_hash(content: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(content, 256), 1, length)


def _page(url: Column, endings: str, invalid: int, tidy: bool) -> Column:
    folder = lambda path: F.regexp_replace(path, "/$", "") if tidy else path
    page = lambda path: F.when(path == "", "index.html").when(path.rlike(endings), path).otherwise(F.concat(folder(path), F.lit("/index.html")))
    named = lambda u: urls.bound(F.substring(urls.pathname(u), 2, 1 << 20), page)
    return urls.bound(url, lambda u: F.when(urls.is_valid(u), named(u)).otherwise(F.concat(F.lit("pages/"), content_hash(u, invalid), F.lit(".html"))))


def page_path_browser(url: Column) -> Column:
    return _page(url, r"\.html$", 12, False)


def page_path_http(url: Column) -> Column:
    return _page(url, r"\.html?$", 16, False)


def page_path(url: Column) -> Column:
    """The canonical page path: folders once, .htm and .html as they are, a hash where there is no URL."""
    return _page(url, r"\.html?$", 12, True)


def asset_path(url: Column, kind: Column, digest: Column) -> Column:
    """By content: assets/<folder of the type>/<hash>[.<extension>]."""
    ext = urls.ext_path(url)
    return F.concat(F.lit("assets/"), kinds.type_folder(kind), F.lit("/"), digest, F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))


def asset_path_by_url(url: Column) -> Column:
    """By URL: assets/<folder of the extension>/<URL hash>[.<extension>]."""
    named = lambda u, ext: F.concat(F.lit("assets/"), kinds.folder_by_extension(ext), F.lit("/"), content_hash(u, 16), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return urls.bound(url, lambda u: F.when(urls.is_valid(u), urls.bound(urls.ext_path(u), lambda ext: named(u, ext))).otherwise(F.concat(F.lit("assets/other/"), content_hash(u, 16))))


def asset_filename(url: Column, digest: Column) -> Column:
    """<hash>.<extension>; without an extension .woff for what looks like a font."""
    ext = urls.ext_path(url)
    return F.when(ext != "", F.concat(digest, F.lit("."), ext)).when(F.contains(url, F.lit("font")) | F.contains(url, F.lit("woff")), F.concat(digest, F.lit(".woff"))).otherwise(digest)


def css_guess(url: Column) -> Column:
    """Where an asset that a style sheet names would be, seen from the style sheet."""
    return F.concat(F.lit("../assets/"), kinds.css_folder(url), F.lit("/"), urls.filename(url))


def from_root(path: Column) -> Column:
    return F.regexp_replace(path, "^/", "")


def from_script(path: Column) -> Column:
    """A path under assets/ as seen from assets/js/, any other as seen from a folder below the root."""
    bare = from_root(path)
    return F.when(bare.startswith("assets/"), F.concat(F.lit("../"), F.substring(bare, 8, 1 << 20))).otherwise(F.concat(F.lit("../"), bare))


def format_bytes(n: Column) -> Column:
    """Two decimals and the largest fitting unit up to GB."""
    step = F.least(F.lit(3), F.floor(F.log(F.greatest(n, F.lit(1))) / F.log(F.lit(1024.0)) + 1e-12)).cast("int")
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), step + 1)
    return F.when(n == 0, "0 B").otherwise(F.format_string("%.2f %s", n / F.pow(F.lit(1024.0), step), unit))
