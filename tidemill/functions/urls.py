"""URL functions as Column expressions. A string that is no absolute URL counts as invalid, never as an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, (user info,) host, port with colon, path, query with ?, fragment with #
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#.*)?$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and stands in the plan once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, URL, i)


def is_valid(url: Column) -> Column:
    """Whether ``url`` is absolute and has a host; null counts as invalid."""
    return F.coalesce(part(url, 2) != "", F.lit(False))


def protocol(url: Column) -> Column:
    return F.lower(part(url, 1))


def hostname(url: Column) -> Column:
    return F.lower(part(url, 2))


def _given_port(url: Column) -> Column:
    """The port as a URL keeps it: empty where it is the scheme's own."""
    port = F.substring(part(url, 3), 2, 9)
    own = F.when(protocol(url) == "https", "443").when(protocol(url) == "http", "80").otherwise("")
    return F.when(port == own, "").otherwise(port)


def port(url: Column) -> Column:
    return F.when(_given_port(url) != "", _given_port(url)).when(protocol(url) == "https", "443").otherwise("80")


def host(url: Column) -> Column:
    """Host name and, where it is not the scheme's own, port."""
    return F.concat(hostname(url), F.when(_given_port(url) != "", F.concat(F.lit(":"), _given_port(url))).otherwise(""))


def origin(url: Column) -> Column:
    return F.concat(protocol(url), F.lit("://"), host(url))


def pathname(url: Column) -> Column:
    return F.when(part(url, 4) == "", "/").otherwise(part(url, 4))


def search(url: Column) -> Column:
    return F.when(part(url, 5) == "?", "").otherwise(part(url, 5))


def fragment(url: Column) -> Column:
    return F.when(part(url, 6) == "#", "").otherwise(part(url, 6))


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"/$", "")


def crawl_normalize(url: Column) -> Column:
    """Origin, path without one slash at its end, and query."""
    path = _trimmed(pathname(url))
    return F.concat(origin(url), F.when(path == "", "/").otherwise(path), search(url))


def frontier_key(url: Column) -> Column:
    """Lower-cased, up to query or fragment, without one slash at its end."""
    return F.lower(_trimmed(clean(url)))


def clean(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#][\s\S]*$", "")


def asset_normalize(url: Column) -> Column:
    """One slash, then :80, then :443 go, each only at the very end."""
    return F.regexp_replace(F.regexp_replace(_trimmed(url), r":80$", ""), r":443$", "")


def named_normalize(url: Column) -> Column:
    """Start-up normalisation: https, no fragment, no slash at the end."""
    bare = F.regexp_replace(url, r"#[\s\S]*$", "")
    return _trimmed(F.regexp_replace(bare, r"(?i)^http://", "https://"))


def filename(url: Column) -> Column:
    last = F.regexp_replace(F.element_at(F.split(url, "/", -1), -1), r"[?#][\s\S]*$", "")
    return F.when(last == "", "file").otherwise(last)


def www_alternate(url: Column) -> Column:
    """The same URL with or without www.; an invalid one unchanged."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*", "")
    other = F.when(hostname(url).startswith("www."), F.substring(hostname(url), 5, 1 << 20)).otherwise(F.concat(F.lit("www."), hostname(url)))
    return F.when(is_valid(url), F.concat(protocol(url), F.lit("://"), other, rest)).otherwise(url)


def percent_encoded(path: Column) -> Column:
    """Non-ASCII characters, controls, space and \" < > ` { } as UTF-8 percent codes."""
    code = lambda c: F.when(c.rlike(r"^[\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7a\x7c\x7e]?$"), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")))
    each = lambda p: F.when(p.rlike(r"^[\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7a\x7c\x7e]*$"), p).otherwise(F.array_join(F.transform(F.split(p, "", -1), code), ""))
    return bound(path, each)


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved; one that ends in such a segment ends in a slash."""
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    def resolved(p: Column) -> Column:
        parts = F.slice(F.split(p, "/", -1), 2, 1 << 20)
        joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
        return F.concat(F.lit("/"), bound(joined, lambda j: F.concat(j, F.when((j != "") & p.rlike(r"/\.\.?$"), "/").otherwise(""))))

    return bound(path, lambda p: F.when(F.contains(p, F.lit("/.")), resolved(p)).otherwise(p))


#: The parts of an absolute URL, user info included, in one pass; a separator that URLs cannot hold stands between them.
_PARTS = URL.replace("(?:[^/?#@]*@)?", "([^/?#@]*@)?")


def _parts(url: Column) -> Column:
    """[scheme, user info, host, port, path, query, fragment]; of an invalid URL one part."""
    return F.split(F.regexp_replace(url, _PARTS, "\x01".join(f"${i}" for i in range(1, 8))), "\x01", -1)


def _valid(p: Column) -> Column:
    return F.coalesce((F.size(p) == 7) & (F.get(p, F.lit(2)) != ""), F.lit(False))


def _origin(p: Column) -> Column:
    own = (p[0].rlike("(?i)^https$") & (p[3] == ":443")) | (p[0].rlike("(?i)^http$") & (p[3] == ":80")) | (p[3] == ":")
    return F.concat(F.lower(p[0]), F.lit("://"), p[1], F.lower(p[2]), F.when(own, "").otherwise(p[3]))


def _path(p: Column) -> Column:
    return F.when(p[4] == "", "/").otherwise(p[4])


def resolve(ref: Column, base: Column) -> Column:
    """``ref`` as seen from ``base``: absolute, scheme-relative, rooted, query, fragment and relative forms.

    Paths lose their dot segments and get percent codes; hosts are lower-cased and the scheme's own port goes; user info
    of a reference stays; a backslash before the query counts as a slash. Host names of other alphabets are not
    transcribed. Null where neither ref nor base is a URL, or ref has another scheme (mailto:, data: and so on).
    """
    tidy = lambda x: percent_encoded(_without_dots(x))
    whole = lambda p: F.concat(_origin(p), tidy(_path(p)), percent_encoded(F.concat(p[5], p[6])))
    before, after = (lambda r: F.regexp_extract(r, r"^([^?#]*)", 1)), (lambda r: F.regexp_replace(r, r"^[^?#]*", ""))

    def seen(x: Column) -> Column:
        r, own, b = x["r"], x["own"], x["b"]
        site = F.concat(F.lower(b[0]), F.lit("://"), F.lower(b[2]), F.regexp_replace(_origin(b), r"^.*?(:[0-9]+)?$", "$1"))
        inherit = F.concat(_path(b), F.when(b[5] == "?", "").otherwise(b[5]))
        return (
            F.when(_valid(own), whole(own))
            .when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | ~_valid(b), None)
            .when(r.startswith("//"), bound(_parts(F.concat(F.lower(b[0]), F.lit(":"), r)), lambda p: F.when(_valid(p), whole(p))))
            .when(r == "", F.concat(site, inherit))
            .when(r.startswith("#"), F.concat(site, inherit, r))
            .when(r.startswith("?"), F.concat(site, _path(b), r))
            .when(r.startswith("/"), F.concat(site, tidy(before(r)), percent_encoded(after(r))))
            .otherwise(F.concat(site, tidy(F.concat(F.regexp_replace(_path(b), r"[^/]*$", ""), before(r))), percent_encoded(after(r))))
        )

    slashed = bound(F.trim(ref), lambda r: F.when(F.contains(r, F.lit("\\")), F.concat(F.translate(before(r), "\\", "/"), after(r))).otherwise(r))
    return bound(slashed, lambda r: bound(F.struct(r.alias("r"), _parts(r).alias("own"), _parts(base).alias("b")), seen))


def make_absolute(ref: Column, base: Column) -> Column:
    return F.when(ref.rlike(r"^https?://"), ref).when(ref.startswith("//"), F.concat(protocol(base), F.lit(":"), ref)).otherwise(resolve(ref, clean(base)))


def parse_page_url(url: Column, base: Column, depth: Column, parent: Column) -> Column:
    """The PAGE_URL struct of a reference; scheme-relative references keep their own host."""
    absolute = F.when(url.rlike(r"^https?://"), url).when(url.startswith("/") & ~url.startswith("//"), F.concat(origin(base), url)).otherwise(resolve(url, base))
    fields = {"original": absolute, "normalized": crawl_normalize(absolute), "protocol": protocol(absolute), "hostname": hostname(absolute), "port": port(absolute),
              "pathname": pathname(absolute), "search": search(absolute), "hash": fragment(absolute), "depth": depth, "parent_url": parent}
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def same_origin(a: Column, b: Column) -> Column:
    return F.coalesce(is_valid(a) & is_valid(b) & (origin(a) == origin(b)), F.lit(False))


def same_domain(a: Column, b: Column) -> Column:
    """Equal host names, whatever the port; subdomains differ; invalid URLs have no domain."""
    return F.coalesce(is_valid(a) & is_valid(b) & (hostname(a) == hostname(b)), F.lit(False))


# -- extensions -----------------------------------------------------------------------------------------------------
def ext_loose(url: Column) -> Column:
    """What follows the last dot of the URL up to its query, whatever it is."""
    return F.lower(F.element_at(F.split(clean(url), r"\.", -1), -1))


def ext_alpha(url: Column) -> Column:
    """The loose extension, if it is one to six letters."""
    return F.when(F.size(F.split(clean(url), r"\.", -1)) < 2, "").otherwise(F.when(ext_loose(url).rlike("^[a-z]{1,6}$"), ext_loose(url)).otherwise(""))


def ext_path(url: Column) -> Column:
    """The extension of the last segment of the path; empty without a dot there."""
    name = bound(url, lambda u: F.element_at(F.split(F.when(is_valid(u), pathname(u)).otherwise(clean(u)), "/", -1), -1))
    return bound(name, lambda n: F.when(F.instr(n, ".") > 0, F.lower(F.element_at(F.split(n, r"\.", -1), -1))).otherwise(""))
