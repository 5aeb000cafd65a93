"""What pages, style sheets and scripts refer to. HTML is read as tokens (see markup)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from . import filters, markup
from .markup import attribute, attribute_pattern, raw_attribute  # noqa: F401

# What counts as a reference in style sheets and scripts.
CSS_URL = r"(?i)url\(['\"]?([^'\"()]+)['\"]?\)"
CSS_IMPORT_URL = r"(?i)@import\s+url\(['\"]?([^'\"()]+)['\"]?\)"
CSS_IMPORT = r"(?i)@import\s+(?:url\(['\"]?[^'\"()]+['\"]?\)|['\"][^'\"]+['\"])"
JS_IMPORT, JS_FETCH = r"import\([\"']([^\"']+)[\"']\)", r"fetch\([\"']([^\"']+)[\"']\)"
JS_TEMPLATE, JS_STRING = r"`((?:https?://[^$`]+)|(?:/[^$`]+))`", r"([\"'])(/[^\"'\s)}]+)\1"


def title(html: Column, closed: bool = False) -> Column:
    """The text of all titles; empty without any. With ``closed``, character references without a semicolon stay."""
    return text.decode_entities(F.array_join(markup.raw_texts(html, "title"), ""), closed=closed)


#: What a tag holds up to its end: a > within a quoted value does not end it.
IN_TAG = r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+"


def hrefs(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, url, base, pos, href) of every a[href], in order; ``base`` is what it is relative to."""
    found = pages.select(id_col, "url", markup.base_url(F.col("html"), F.col("url")).alias("base"), markup.tags(F.col("html"), "a").alias("tags"))
    each = found.select(id_col, "url", "base", F.posexplode("tags").alias("pos", "tag"))
    return each.select(id_col, "url", "base", "pos", attribute(F.col("tag"), "href").alias("href")).filter("href is not null")


def links(pages: DataFrame, include: list[str] = (), exclude: list[str] = (), same_domain_only: bool = True, id_col: str = "page_id") -> DataFrame:
    """(id, url, pos, link): resolved links that should be crawled, the first of equal ones on a page."""
    found = hrefs(pages, id_col).withColumn("link", urls.resolve(F.col("href"), F.col("base")))
    found = found.filter(filters.should_crawl(F.col("link"), F.col("url"), include, exclude, same_domain_only))
    return found.groupBy(id_col, "url", "link").agg(F.min("pos").alias("pos"))


def links_below(pages: DataFrame, base: str, id_col: str = "page_id") -> DataFrame:
    """(id, link): the distinct resolved links that start with ``base``."""
    found = hrefs(pages, id_col).withColumn("link", urls.resolve(F.col("href"), F.col("base")))
    return found.filter(F.col("link").startswith(base)).select(id_col, "link").distinct()


def page_assets(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, url, kind, grp, pos, ref, asset) of style sheets, scripts, images and icons, in that order of groups.

    A page is read once; ``pos`` counts the tags of one name.
    """
    found = pages.select(id_col, "url", markup.base_url(F.col("html"), F.col("url")).alias("_base"), markup.tags(F.col("html"), "link|script|img").alias("_all"))

    def group(grp: int, tag: str, attr: str, kind: str) -> Column:
        mine = F.filter("_all", lambda t: t.rlike(rf"(?i)^<{tag}\b"))
        return F.transform(mine, lambda t, i: F.struct(F.lit(kind).alias("kind"), F.lit(grp).alias("grp"), i.alias("pos"), F.lit(attr).alias("attr"), t.alias("tag")))

    groups = F.concat(group(0, "link", "href", "css"), group(1, "script", "src", "js"), group(2, "img", "src", "image"), group(3, "link", "href", "image"))
    each = found.select(id_col, "url", "_base", F.explode(groups).alias("t")).select(id_col, "url", "_base", "t.*")
    each = each.withColumn("ref", F.when(F.col("attr") == "href", attribute(F.col("tag"), "href")).otherwise(attribute(F.col("tag"), "src"))).filter("ref is not null and ref <> ''")
    rel = raw_attribute(F.col("tag"), "rel")
    each = each.filter(F.when(F.col("grp") == 0, rel == "stylesheet").when(F.col("grp") == 3, F.contains(rel, F.lit("icon"))).otherwise(True))
    return each.select(id_col, "url", "kind", "grp", "pos", "ref", urls.resolve(F.col("ref"), F.col("_base")).alias("asset")).filter("asset is not null")


def first_assets(assets: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Of equal assets of a page the first, by group and place."""
    first = F.min(F.struct("grp", "pos", "kind", "ref"))
    return assets.groupBy(id_col, "url", "asset").agg(first.alias("x")).select(id_col, "url", "asset", "x.kind", "x.grp", "x.pos", "x.ref")


def css_urls(css: Column) -> Column:
    """Distinct url() values, then those of @import, in order; no data: and about: ones."""
    imports = F.transform(F.regexp_extract_all(css, F.lit(CSS_IMPORT), F.lit(0)), lambda m: F.coalesce(F.nullif(F.regexp_extract(m, CSS_URL, 1), F.lit("")), F.regexp_extract(m, r"['\"]([^'\"]+)['\"]", 1)))
    both = F.concat(F.regexp_extract_all(css, F.lit(CSS_URL), F.lit(1)), imports)
    return F.array_distinct(F.filter(both, lambda u: (u != "") & ~u.rlike("^(data:|about:)")))


def js_urls(js: Column) -> Column:
    """Distinct values of imports, fetches, whole template literals and quoted rooted paths, in that order."""
    found = [F.regexp_extract_all(js, F.lit(p), F.lit(g)) for p, g in ((JS_IMPORT, 1), (JS_FETCH, 1), (JS_TEMPLATE, 1), (JS_STRING, 2))]
    return F.array_distinct(F.concat(*found))


def font_faces(css: Column, every_url: bool = True) -> Column:
    """url() values of @font-face rules; without ``every_url`` only the last one of each rule."""
    if not every_url:
        return F.regexp_extract_all(css, F.lit(r"(?i)@font-face\s*\{[^}]*src:\s*[^;}]*url\(['\"]?([^'\")\s]+)['\"]?\)"), F.lit(1))
    rules = F.regexp_extract_all(css, F.lit(r"(?i)@font-face\s*\{[^}]*\}"), F.lit(0))
    return F.flatten(F.transform(rules, lambda r: F.regexp_extract_all(r, F.lit(r"(?i)url\(['\"]?([^'\")\s]+)['\"]?\)"), F.lit(1))))


def direct_fonts(css: Column) -> Column:
    """Absolute font URLs anywhere in a style sheet."""
    found = F.regexp_extract_all(css, F.lit(r"(?i)url\(['\"]?([^'\")\s]+\.(?:woff2?|ttf|otf|eot))['\"]?\)"), F.lit(1))
    return F.filter(found, lambda u: u.rlike("^https?://"))


def font_urls(sheets: DataFrame, base: str | None = None, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(font): distinct font URLs of style sheets (url, body), resolved against their own URL, in the crawl's scope: the
    site of ``base``, or of each sheet."""
    home = F.col("url") if base is None else F.lit(base)
    named = sheets.select(home.alias("home"), "url", F.explode(font_faces(F.col("body"))).alias("ref")).filter(~F.col("ref").startswith("data:"))
    named = named.select("home", urls.resolve(F.col("ref"), F.col("url")).alias("font"))
    direct = sheets.select(home.alias("home"), F.explode(direct_fonts(F.col("body"))).alias("font"))
    return named.unionByName(direct).filter(filters.should_crawl(F.col("font"), F.col("home"), include, exclude)).select("font").distinct()


def routes(html: Column, scripts: Column) -> Column:
    """Distinct rooted paths of route tables in scripts (an array), then of href attributes."""
    found = F.array_union(F.regexp_extract_all(F.array_join(scripts, " "), F.lit(r"path:\s*[\"']([^\"']+)[\"']"), F.lit(1)), F.regexp_extract_all(html, F.lit(r"href=[\"']([^\"']+)[\"']"), F.lit(1)))
    return F.filter(F.array_distinct(found), filters.is_route)


def api_endpoints(scripts: Column) -> Column:
    """Distinct first arguments of fetch calls, then of axios calls."""
    js = F.array_join(scripts, " ")
    return F.array_union(F.regexp_extract_all(js, F.lit(r"fetch\([\"']([^\"']+)[\"']"), F.lit(1)), F.regexp_extract_all(js, F.lit(r"axios\.(?:get|post|put|delete|patch)\([\"']([^\"']+)[\"']"), F.lit(1)))


def links_and_routes(links: DataFrame, navigations: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, link): distinct links of pages (id, link) united with the URLs of their navigation events (id, url)."""
    return links.select(id_col, "link").unionByName(navigations.select(id_col, F.col("url").alias("link"))).filter("link is not null").distinct()


def page_rows(pages: DataFrame, closed: bool = False) -> DataFrame:
    """Pages as records: parsed URL, title, status and final URL, sizes and counts of links. ``pages``: page_id, url, html and, if
    captured, status (0 where it is missing) and final_url (else the URL itself); without such a column the status is 200.
    ``closed`` is that of ``title``."""
    url = urls.parse_page_url(F.col("url"), F.col("url"), F.lit(0), F.lit(None).cast("string"))
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    final = F.col("final_url") if "final_url" in pages.columns else F.col("url")
    return pages.select(
        "page_id", url.alias("parsed"), title(F.col("html"), closed).alias("title"), F.coalesce(status.cast("int"), F.lit(0)).alias("status"), F.coalesce(final, "url").alias("final_url"), F.length("html").cast("long").alias("chars"), F.size(markup.tags(F.col("html"), "a")).cast("long").alias("anchors")
    )
