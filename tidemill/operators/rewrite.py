"""Rewriting of URLs in HTML, CSS and JavaScript by lookups.

A body is split at its tokens; only the tokens' keys are exploded and joined with the URL maps, and the pieces are put
together again in order, so bodies themselves meet one shuffle (by id) and maps are joined however their size wants.
Each pass is a plan over (id, body); order matters where patterns overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text, urls
from ..plans.lineage import cut
from . import filters, markup, substrings
from .extract import IN_TAG
from .markup import attribute, attribute_pattern, raw_attribute

#: Where tags are none: comments, and elements other than scripts and frames whose content is text.
SKIPPED = (markup.COMMENT, markup.raw_element("style|textarea|title|xmp|noembed|noframes"))
SCRIPT = rf"script\b{IN_TAG}>.*?</script>"
# Attributes in which pages keep URLs for scripts.
DATA_ATTRIBUTES = ("data-bg", "data-background", "data-src", "data-href", "data-url", "data-image")
#: Chunks and media that a framework asks for at run time come from the mirror's folders.
WEBPACK = (
    "<script>(function(){var dirs={'/_next/static/chunks/':'./assets/js/','/_next/static/media/':'./assets/fonts/'};"
    "if(typeof __webpack_require__!=='undefined'){__webpack_require__.p='./assets/js/';}"
    "if(typeof window==='undefined'||!window.fetch){return;}var ask=window.fetch;"
    "window.fetch=function(){var a=Array.prototype.slice.call(arguments);if(typeof a[0]==='string'){for(var d in dirs){a[0]=a[0].split(d).join(dirs[d]);}}return ask.apply(window,a);};})();</script>"
)


# -- lookups --------------------------------------------------------------------------------------------------------
def look_up(rows: DataFrame, key: str, table: DataFrame, out: str = "path") -> DataFrame:
    """``rows`` with ``out``: the local path of a key, null if the map (url, local_path) lacks it."""
    return rows.join(table.select(F.col("url").alias("_k"), F.col("local_path").alias(out)), F.col(key) == F.col("_k"), "left").drop("_k")


def look_up_www(rows: DataFrame, key: str, table: DataFrame, out: str = "path") -> DataFrame:
    """The same, and if it lacks the key, that of the host with or without www."""
    rows = look_up(rows, key, table, "_a").withColumn("_w", urls.www_alternate(F.col(key)))
    return look_up(rows, "_w", table, "_b").withColumn(out, F.coalesce("_a", "_b")).drop("_a", "_b", "_w")


def contains_lookup(files: DataFrame, origins: DataFrame) -> DataFrame:
    """(name, url): the first origin URL (by ord) whose path holds the stem of a style sheet's file name anywhere; null
    without one, and for names of other files. Found by the index of grams, not by a scan of all pairs."""
    stems = files.filter(F.col("name").endswith(".css")).select("name", F.replace("name", F.lit(".css"), F.lit("")).alias("stem")).filter("stem <> ''").distinct()
    held = substrings.containing(origins.select(F.col("local_path").alias("text")), stems.select(F.col("stem").alias("needle")))
    first = origins.groupBy(F.col("local_path").alias("text")).agg(F.min(F.struct("ord", "url")).alias("x"))
    found = held.join(first, "text").groupBy(F.col("needle").alias("stem")).agg(F.min("x").alias("x"))
    return files.join(stems.join(found, "stem"), "name", "left").select("name", F.col("x.url").alias("url"))


# -- the engine -----------------------------------------------------------------------------------------------------
def rewrite(df: DataFrame, pattern: str, replaced: Callable[[DataFrame], DataFrame], id_col: str = "id", body_col: str = "body") -> DataFrame:
    """``df`` with each match of ``pattern`` in the body replaced.

    ``replaced`` takes (id, pos, token, and the other columns of ``df``) and returns (id, pos, out); a null out keeps
    the token. Bodies without a match, and null ones, stay as they are. Rows may repeat an id: what is replaced belongs to
    the id, the body and the other columns together.
    """
    rest = [c for c in df.columns if c not in (id_col, body_col)]
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(body_col, *rest).alias("of"))
    tokens = df.select(key.alias("id"), *rest, F.posexplode(F.regexp_extract_all(body_col, F.lit(pattern), F.lit(0))).alias("pos", "token"))
    out = replaced(tokens).select("id", "pos", F.col("out"))
    whole = out.groupBy("id").agg(F.map_from_entries(F.collect_set(F.when(F.col("out").isNotNull(), F.struct("pos", "out")))).alias("_r"))  # tokens of one body
    both = df.join(whole.withColumnRenamed("id", "_id"), key == F.col("_id"), "left")
    parts, kept = F.split(body_col, pattern, -1), F.regexp_extract_all(body_col, F.lit(pattern), F.lit(0))
    piece = lambda x, i: F.concat(x, F.coalesce(F.try_element_at("_r", i), F.get(kept, i), F.lit("")))
    body = F.when(F.col("_r").isNull(), F.col(body_col)).otherwise(F.array_join(F.transform(parts, piece), ""))
    return both.withColumn("_new", body).select(*[F.col("_new").alias(c) if c == body_col else F.col(c) for c in df.columns])


def _with_attribute(tag: Column, name: str | Column, value: Column) -> Column:
    """A tag with another value of an attribute; the quotes stay, a value without gets double ones."""
    if isinstance(name, str):
        group = lambda i: F.regexp_extract(tag, attribute_pattern(name), i)
    else:
        before, after = attribute_pattern("\0").split("\0")[0], attribute_pattern("\0").split("\0")[1:]
        whole = F.concat(F.lit(before), *(x for part in after for x in (name, F.lit(part))))
        group = lambda i: F.call_function("regexp_extract", tag, whole, F.lit(i))
    old = group(2)
    quote = F.when(old.startswith("'"), "'").otherwise('"')
    return F.concat(group(1), quote, F.replace(value, F.lit("&"), F.lit("&amp;")), quote, group(3))


def html_attributes(df: DataFrame, tag: str, attr: str, kind: str, table: DataFrame, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rewrite one attribute of tags. ``df``: id, url (the page's), body.

    kind: 'page' looks pages up, 'asset' assets with the www fallback, 'refresh' the page in a meta refresh, 'data' like
    'asset' where the value looks like a URL. What the map lacks stays. Comments are skipped, scripts' bodies as well.
    """
    token = F.col("token")

    def replaced(tokens: DataFrame) -> DataFrame:
        tokens, value = tokens.withColumn("_value", attribute(token, attr)), F.col("_value")
        ref = F.regexp_extract(value, r"(?i)\d+;\s*url=(.+)", 1) if kind == "refresh" else value
        ok = ~token.startswith("<!--") & (ref != "") & ~filters.is_non_http(ref) & (where(token) if where else F.lit(True))
        if kind == "data":
            ok = ok & filters.data_attribute_is_url(ref)
        rows = tokens.withColumn("_ref", F.when(ok, ref)).withColumn("_key", urls.resolve(F.col("_ref"), F.col("url")))
        rows = (look_up if kind in ("page", "refresh") else look_up_www)(rows, "_key", table)
        path = paths.from_root(F.col("path"))
        new = F.concat(F.regexp_extract(value, r"(?i)(\d+);\s*url=", 1), F.lit("; url="), path) if kind == "refresh" else path
        return rows.withColumn("out", F.when(F.col("path").isNotNull(), _with_attribute(token, attr, new)))

    skipped = SKIPPED if "script" in tag.split("|") else (*SKIPPED, markup.raw_element("script"))
    return rewrite(df, markup.one_of(*skipped, rf"(?:{tag})\b{IN_TAG}>"), replaced)


def srcset_value(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(id, out) for (id, url, srcset): each URL by the asset map, with its first descriptor, joined by a comma."""
    each = rows.select("id", "url", F.posexplode(F.split("srcset", ",", -1)).alias("k", "part")).withColumn("part", F.split(F.trim("part"), r"\s+", -1))
    each = each.select("id", "k", F.get("part", F.lit(0)).alias("ref"), F.get("part", F.lit(1)).alias("mark"), "url").withColumn("_key", urls.resolve(F.col("ref"), F.col("url")))
    each = look_up_www(each, "_key", table)
    out = F.concat_ws(" ", F.coalesce(paths.from_root(F.col("path")), F.col("ref")), F.nullif("mark", F.lit("")))
    return each.withColumn("o", out).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o"))), lambda x: x["o"]), ", ").alias("out"))


def html_srcset(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rewrite every srcset attribute, once."""

    def replaced(tokens: DataFrame) -> DataFrame:
        value = attribute(F.col("token"), "srcset")
        rows = tokens.withColumn("srcset", F.when(~F.col("token").startswith("<!--"), value)).withColumn("_t", F.struct("id", "pos"))
        done = srcset_value(rows.filter("srcset <> ''").select(F.col("_t").alias("id"), "url", "srcset"), table).withColumnRenamed("out", "_set").withColumnRenamed("id", "_t2")
        both = rows.join(done, F.col("_t") == F.col("_t2"), "left")
        return both.withColumn("out", F.when(F.col("_set").isNotNull(), _with_attribute(F.col("token"), "srcset", F.col("_set"))))

    return rewrite(df, markup.one_of(*SKIPPED, rf"[a-z][a-z0-9]*\b(?=[^>]*\ssrcset\s*=){IN_TAG}>"), replaced)


def html_imports(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rewrite import("…") and import('…') in scripts without src; the quotes stay."""
    inner = r"import\([\"'][^\"']+[\"']\)"

    def replaced(tokens: DataFrame) -> DataFrame:
        inline = ~F.col("token").startswith("<!--") & raw_attribute(F.regexp_extract("token", rf"(?is)^(<script\b{IN_TAG}>)", 1), "src").isNull()
        scripts = tokens.filter(inline).select(F.struct("id", "pos").alias("id"), "url", F.col("token").alias("body"))

        def one(found: DataFrame) -> DataFrame:
            ref = F.regexp_extract("token", r"import\([\"']([^\"']+)[\"']\)", 1)
            rows = look_up_www(found.withColumn("_key", urls.resolve(F.when(~filters.is_non_http(ref), ref), F.col("url"))), "_key", table)
            quote = F.substring("token", 8, 1)
            return rows.withColumn("out", F.when(F.col("path").isNotNull(), F.concat(F.lit("import("), quote, paths.from_root(F.col("path")), quote, F.lit(")"))))

        return rewrite(scripts, inner, one).select("id.id", "id.pos", F.col("body").alias("out"))

    return rewrite(df, markup.one_of(*SKIPPED, SCRIPT), replaced)


def html_styles(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rewrite style attributes as style sheets of the page's own URL."""

    def replaced(tokens: DataFrame) -> DataFrame:
        value = attribute(F.col("token"), "style")
        rows = tokens.withColumn("_v", F.when(~F.col("token").startswith("<!--"), value)).filter("_v <> ''")
        done = css(rows.select(F.struct("id", "pos", "token").alias("id"), "url", F.col("_v").alias("body")), table, mapped="root", unmapped="keep")
        return done.select("id.id", "id.pos", _with_attribute(F.col("id.token"), "style", F.col("body")).alias("out"))

    return rewrite(df, markup.one_of(*SKIPPED, rf"[a-z][a-z0-9]*\b(?=[^>]*\sstyle\s*=){IN_TAG}>"), replaced)


def html_inject(body: Column, webpack: bool = True, base: bool = True) -> Column:
    """The override script at the head's end, and a base tag at its start unless the page has one."""
    out = F.regexp_replace(body, r"(?i)</head>", WEBPACK + "</head>") if webpack else body
    return F.when(~body.rlike(r"(?i)<base\b"), F.regexp_replace(out, r"(?i)(<head\b[^>]*>)", '$1<base href="./">')).otherwise(out) if base else out


def _rel(tag: Column) -> Column:
    return raw_attribute(tag, "rel").isin("stylesheet", "preload", "modulepreload", "prefetch")


def _media(tag: Column) -> Column:
    return F.coalesce(raw_attribute(tag, "property"), F.lit("")).isin("og:image", "og:video", "og:audio") | F.coalesce(raw_attribute(tag, "name"), F.lit("")).isin("twitter:image", "twitter:player")


#: Tag, attribute, kind of its reference (as in html_attributes) and condition.
SPECS: list[tuple[str, str, str, Callable[[Column], Column] | None]] = [
    ("a", "href", "page", None), ("img", "src", "asset", None), ("script", "src", "asset", None), ("link", "href", "asset", _rel), ("iframe|frame", "src", "page", None),
    ("meta", "content", "refresh", lambda t: raw_attribute(t, "http-equiv") == "refresh"), ("meta", "content", "asset", _media), *(("[a-z]+", name, "data", None) for name in DATA_ATTRIBUTES),
]


def html_references(df: DataFrame, pages: DataFrame, assets: DataFrame) -> DataFrame:
    """All attributes of SPECS in one pass: a tag's references are looked up together, then put in one after the other."""
    both = pages.select(F.lit("page").alias("_m"), F.col("url").alias("_k"), "local_path").unionByName(assets.select(F.lit("asset").alias("_m"), F.col("url").alias("_k"), "local_path"))

    def replaced(tokens: DataFrame) -> DataFrame:
        opened = F.regexp_extract("token", rf"(?s)^(<{IN_TAG}>)", 1)
        found = []
        for k, (tag, attr, kind, where) in enumerate(SPECS):
            value = raw_attribute(F.col("_open"), attr)
            ref = F.regexp_extract(value, r"(?i)\d+;\s*url=(.+)", 1) if kind == "refresh" else value
            ok = F.col("_open").rlike(rf"(?is)^<(?:{tag})\b") & (where(F.col("_open")) if where else F.lit(True)) & (filters.data_attribute_is_url(ref) if kind == "data" else F.lit(True))
            lead = F.concat(F.regexp_extract(value, r"(?i)(\d+);\s*url=", 1), F.lit("; url=")) if kind == "refresh" else F.lit("")
            found.append(F.struct(F.lit(k).alias("k"), F.lit(attr).alias("attr"), F.lit("page" if kind in ("page", "refresh") else "asset").alias("m"), F.when(ok, ref).alias("ref"), lead.alias("lead")))
        rows = tokens.filter(~F.col("token").startswith("<!--")).withColumn("_open", opened)
        rows = rows.withColumn("_f", F.filter(F.array(*found), lambda x: (x["ref"] != "")))
        each = rows.select("id", "pos", "url", F.explode("_f").alias("f")).withColumn("f", F.col("f").withField("ref", text.decode_entities(F.col("f.ref"), in_attribute=True))).filter(~filters.is_non_http(F.col("f.ref")))
        each = each.select("id", "pos", "f.*", urls.resolve(F.col("f.ref"), F.col("url")).alias("_key"))
        each = each.withColumn("_www", F.when(F.col("m") == "asset", urls.www_alternate(F.col("_key"))))
        one, two = (both.select(F.col("_m").alias(f"_m{s}"), F.col("_k").alias(f"_k{s}"), F.col("local_path").alias(f"_p{s}")) for s in "12")
        each = each.join(one, (F.col("m") == F.col("_m1")) & (F.col("_key") == F.col("_k1")), "left").join(two, (F.col("m") == F.col("_m2")) & (F.col("_www") == F.col("_k2")), "left")
        new = F.concat("lead", paths.from_root(F.coalesce("_p1", "_p2")))
        each = each.select("id", "pos", "k", "attr", new.alias("new")).filter("new is not null")
        each = each.groupBy("id", "pos").agg(F.array_sort(F.collect_list(F.struct("k", "attr", "new"))).alias("_c"))
        put = lambda tag, c: _with_attribute(tag, c["attr"], c["new"])
        return rows.select("id", "pos", "token").join(each, ["id", "pos"]).withColumn("out", F.aggregate("_c", F.col("token"), put))

    return rewrite(df, markup.one_of(*SKIPPED, SCRIPT, rf"[a-z][a-z0-9]*\b{IN_TAG}>"), replaced)


def html(df: DataFrame, pages: DataFrame, assets: DataFrame, inject: bool = True) -> DataFrame:
    """All rewrites of pages (id, url, body), in order. Maps are whole before the first page is rewritten, so links to
    any captured page are found. Each pass reads its input twice, so passes are cut from each other."""
    df = cut(html_references(df, pages, assets))
    df = cut(html_imports(df, assets))
    df = cut(html_styles(df, assets))
    df = html_srcset(df, assets)
    return df.withColumn("body", html_inject(F.col("body"))) if inject else df


def html_meta(df: DataFrame, pages: DataFrame, assets: DataFrame) -> DataFrame:
    """Meta refresh by pages, og: and twitter: media by assets."""
    df = html_attributes(df, "meta", "content", "refresh", pages, lambda t: raw_attribute(t, "http-equiv") == "refresh")
    return html_attributes(cut(df), "meta", "content", "asset", assets, _media)


def html_saved(df: DataFrame) -> DataFrame:
    """Pages (id, url, body) as a plain HTTP mirror stores them, without any map: style sheets, scripts, images and icons
    get the path of their URL, every link the path of its page, whether or not that was captured."""

    def replaced(tokens: DataFrame) -> DataFrame:
        tag = F.col("token")
        rel = F.coalesce(raw_attribute(tag, "rel"), F.lit(""))
        attr = F.when(tag.rlike(r"(?i)^<(a|link)\b"), "href").when(tag.rlike(r"(?i)^<(script|img)\b"), "src")
        ok = ~tag.rlike(r"(?i)^<link\b") | (rel == "stylesheet") | F.contains(rel, F.lit("icon"))
        ref = text.decode_entities(F.when(attr == "href", raw_attribute(tag, "href")).when(attr == "src", raw_attribute(tag, "src")), in_attribute=True)
        rows = tokens.withColumn("_ref", F.when(ok & (ref != ""), ref)).withColumn("_attr", attr).withColumn("_key", urls.resolve(F.col("_ref"), F.col("url"))).filter("_key is not null")
        path = F.when(tag.rlike(r"(?i)^<a\b"), paths.page_path_http(F.col("_key"))).otherwise(paths.asset_path_by_url(F.col("_key")))
        put = lambda p: F.when(F.col("_attr") == "href", _with_attribute(tag, "href", p)).otherwise(_with_attribute(tag, "src", p))
        return rows.withColumn("out", urls.bound(path, put))

    return rewrite(df, markup.one_of(*SKIPPED, rf"(?:a|link|script|img)\b{IN_TAG}>"), replaced)


# -- style sheets ---------------------------------------------------------------------------------------------------
def css(df: DataFrame, table: DataFrame, mapped: str = "sheet", unmapped: str = "guess") -> DataFrame:
    """Rewrite url() and @import of style sheets (id, url, body), each once; the quotes stay.

    References resolve against the sheet's own URL. ``mapped``: paths as seen from the sheet's folder below assets/
    ('sheet') or from the root ('root'). ``unmapped``: a guessed local path ('guess') or as they are ('keep').
    """
    url_token = r"url\(['\"]?[^'\"()]+['\"]?\)"
    pattern = rf"(?i)@import\s+(?:{url_token}|['\"][^'\"]+['\"])\s*;?|{url_token}"

    def replaced(tokens: DataFrame) -> DataFrame:
        token = F.col("token")
        in_url = F.regexp_extract(token, r"(?i)url\(['\"]?([^'\"()]+)['\"]?\)", 1)
        ref = F.when(in_url != "", in_url).otherwise(F.regexp_extract(token, r"['\"]([^'\"]+)['\"]", 1))
        rows = look_up(tokens.withColumn("_ref", F.when(~filters.css_skips(ref), ref)).withColumn("_key", urls.resolve(F.col("_ref"), F.col("url"))), "_key", table)
        here = paths.from_root(F.col("path"))
        here = F.regexp_replace(here, "^assets/", "../") if mapped == "sheet" else here
        guess = F.when(F.col("_ref").isNotNull(), paths.css_guess(F.col("_ref"))) if unmapped == "guess" else F.lit(None).cast("string")
        quote = F.when(F.contains(token, F.lit('"')), '"').when(F.contains(token, F.lit("'")), "'").otherwise("")
        new = F.coalesce(here, guess)
        call = F.when(in_url != "", F.concat(F.lit("url("), quote, new, quote, F.lit(")"))).otherwise(F.concat(quote, new, quote))
        return rows.withColumn("out", F.when(token.rlike("(?i)^@import"), F.concat(F.lit("@import "), call, F.lit(";"))).otherwise(call))

    return rewrite(df, pattern, replaced)


def css_fonts(df: DataFrame, fonts: DataFrame) -> DataFrame:
    """Fonts that were downloaded, as seen from the sheet's folder; everything else stays."""
    return css(df, fonts, mapped="sheet", unmapped="keep")


# -- scripts (fixed values: the patterns of framework paths, calls and literals in the passes below) ------------------
def _script_pass(df: DataFrame, table: DataFrame, pattern: str, group: int, out: Callable[[Column, Column, Column], Column], guard: bool, only_mapped: bool = False, resolved: bool = False) -> DataFrame:
    """One pass over scripts (id, url, base, body). ``out`` makes the new token of (token, reference, new reference)."""

    def replaced(tokens: DataFrame) -> DataFrame:
        token, ref = F.col("token"), F.regexp_extract("token", pattern, group)
        home = F.col("url") if resolved else F.col("base")
        rows = tokens.withColumn("_ref", ref).withColumn("_key", F.coalesce(urls.resolve(F.col("_ref"), F.when(F.col("_ref").startswith("/"), F.col("base")).otherwise(home)), F.col("_ref")))
        rows = look_up_www(rows, "_key", table)
        inside = urls.same_origin(F.col("_key"), F.col("base"))
        plain = F.when(inside, urls.pathname(F.col("_key"))).otherwise(F.col("_ref"))
        new = F.coalesce(paths.from_script(F.col("path")), F.lit(None).cast("string") if only_mapped else plain)
        return rows.withColumn("out", F.when(inside, out(token, F.col("_ref"), new)) if guard else out(token, F.col("_ref"), new))

    return rewrite(df, pattern, replaced)


def js_next(df: DataFrame, table: DataFrame) -> DataFrame:
    """Framework data and static paths in quotes; relative ones resolve against the script's own URL."""
    quoted = lambda t, r, n: F.concat(F.substring(t, 1, 1), n, F.substring(t, 1, 1))
    df = _script_pass(df, table, r"([\"'`])(/_next/data/[^\"'`]+\.json)\1", 2, quoted, False)
    df = _script_pass(df, table, r"([\"'`])(/_next/static/[^\"'`]+)\1", 2, quoted, False)
    return _script_pass(df, table, r"([\"'`])(\.\./(?:chunks|media|css|static)/[^\"'`]+)\1", 2, quoted, False, resolved=True)


def js_calls(df: DataFrame, table: DataFrame) -> DataFrame:
    """Imports, fetches and opens of the site's own URLs; the first two get double quotes."""
    df = _script_pass(df, table, r"import\([\"']([^\"']+)[\"']\)", 1, lambda t, r, n: F.concat(F.lit('import("'), n, F.lit('")')), False)
    df = _script_pass(df, table, r"fetch\([\"']([^\"']+)[\"']\)", 1, lambda t, r, n: F.concat(F.lit('fetch("'), n, F.lit('")')), True)
    return _script_pass(df, table, r"\.open\([\"'](?:GET|POST|PUT|DELETE|PATCH)[\"'],\s*[\"']([^\"']+)[\"']\)", 1, lambda t, r, n: F.replace(t, r, n), True)


def js_strings(df: DataFrame, table: DataFrame) -> DataFrame:
    """Whole template literals of the site, then quoted rooted paths that the map has."""
    df = _script_pass(df, table, r"`((?:https?://[^$`]+)|(?:/[^$`]+))`", 1, lambda t, r, n: F.concat(F.lit("`"), n, F.lit("`")), True)
    return _script_pass(df, table, r"([\"'])(/[^\"'\s)}]+)\1", 2, lambda t, r, n: F.concat(F.substring(t, 1, 1), n, F.substring(t, 1, 1)), False, only_mapped=True)


def js(df: DataFrame, table: DataFrame) -> DataFrame:
    """All rewrites of scripts (id, url, base, body), in order: the more special patterns first."""
    return js_strings(cut(js_calls(cut(js_next(df, table)), table)), table)
