"""Predicates over URLs, responses and assets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds, urls
from . import globs

# Fixed value: asset types whose bodies are kept.
CAPTURED_TYPES = ("css", "js", "image", "font", "api", "media")


def _any(url: Column, patterns: list[str], literal: bool = True) -> Column:
    """Whether any glob of a list matches; lists too long for a plan are tables (see substrings.matched)."""
    return url.rlike(globs.pattern(list(patterns), literal)) if patterns else F.lit(False)


def included(url: Column, include: list[str]) -> Column:
    return _any(url, include) if include else F.lit(True)


def excluded(url: Column, exclude: list[str]) -> Column:
    return _any(url, exclude)


def should_crawl(url: Column, base: Column, include: list[str] = (), exclude: list[str] = (), same_domain_only: bool = True) -> Column:
    """Valid, of the base's domain, included and not excluded; null counts as invalid."""
    scope = urls.same_domain(url, base) if same_domain_only else urls.is_valid(url)
    return F.coalesce(scope & included(url, list(include)) & ~excluded(url, list(exclude)), F.lit(False))


def within_depth(depth: Column, most: int) -> Column:
    return depth <= most


def succeeded(status: Column) -> Column:
    """A missing status counts as success."""
    return F.coalesce(status, F.lit(0)) < 400


def should_capture(url: Column, status: Column) -> Column:
    return succeeded(status) & ~url.rlike("^(data:|blob:|chrome-extension://|moz-extension://)")


def should_capture_body(kind: Column, status: Column) -> Column:
    return succeeded(status) & kind.isin(*CAPTURED_TYPES)


def of_types(kind: Column, types: list[str]) -> Column:
    return kind.isin(*types)


def is_non_http(url: Column) -> Column:
    return url.rlike("^(#|javascript:|mailto:|tel:|data:)")


def css_skips(url: Column) -> Column:
    return (url == "") | url.rlike("^(data:|about:|#)")


def data_attribute_is_url(value: Column) -> Column:
    return value.startswith("http") | value.startswith("/")


def exceeds_limit(size: Column, most: int) -> Column:
    return size > most


def is_route(path: Column) -> Column:
    return path.startswith("/") & ~path.startswith("//")


def unseen(rows: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key ``seen`` does not have."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def seen_already(rows: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_semi")


# -- content (fixed values: signatures and prefixes) --------------------------------------------------------------------------------------------------------
def _starts(body: Column, *prefixes: str) -> Column:
    return reduce(lambda a, b: a | b, [F.hex(F.substring(body, 1, len(p) // 2)) == p for p in prefixes])


def is_font_file(body: Column) -> Column:
    """wOFF, wOF2, TrueType, OTTO, true and ttcf signatures."""
    return (F.octet_length(body) >= 4) & _starts(body, "774F4646", "774F4632", "00010000", "4F54544F", "74727565", "74746366")


def is_image_file(body: Column) -> Column:
    """PNG, JPEG, GIF, WebP, ICO and CUR signatures, or SVG and XML markup in the first 100 bytes."""
    webp = _starts(body, "52494646") & (F.hex(F.substring(body, 9, 4)) == "57454250")
    head = F.hex(F.substring(body, 1, 100))
    at_byte = lambda text: head.rlike(f"^(..)*{text}")
    known = _starts(body, "89504E47", "FFD8FF", "474946383761", "474946383961", "00000100", "00000200") | webp
    return (F.octet_length(body) >= 8) & (known | at_byte("3C737667") | at_byte("3C3F786D6C"))


def is_valid_content(body: Column, mime: Column, url: Column) -> Column:
    """Whether a body can be what its MIME type and URL say: no HTML in place of other kinds, right magic bytes."""
    mime = F.coalesce(mime, F.lit(""))
    has = lambda *xs: reduce(lambda a, b: a | b, [F.contains(mime, F.lit(x)) for x in xs])
    html = _starts(F.substring(body, 1, 16), "3C21", "3C68746D6C", "3C48544D4C")
    ext = urls.ext_loose(url).isin("css", "js", *kinds.IMAGES, *kinds.FONTS)
    font = has("font") | url.rlike(r"(?i)\.(woff|woff2|ttf|otf|eot)($|[?#])")
    image = has("image/") | url.rlike(r"(?i)\.(png|jpg|jpeg|gif|webp|ico)($|[?#])")
    return (
        F.when(html & has("html"), True).when(html & (has("font", "css", "javascript", "image", "svg") | ext), False)
        .when(font, is_font_file(body)).when(image, is_image_file(body)).otherwise(True)
    )
