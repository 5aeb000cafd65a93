"""Inputs of the registered queries: small rows for Spark and as VALUES for SQL, and what they are for every page."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URLS = [
    (1, "https://A.com/X/?q=1#t"), (2, "https://a.com/x/?q=1#t"), (3, "http://a.com:80/"), (4, "http://a.com:80/x"), (5, "https://www.a.com/x.JS?v=2"), (6, "https://a.com"),
    (7, "not a url"), (8, "https://cdn.a.com:8443/fonts/f.woff2#iefix"), (9, "http://a.com/a.htm"), (10, "http://a.com/a/"), (11, "http://a.com/api/v1/items.json"), (12, "https://a.com/logo"),
    (13, "https://a.com/css/a.css?v=1"), (14, "/relative/img.png"), (15, ""), (16, None), (17, "http://a.com/v2/x.mp4"), (18, "http://a.com/b.html?x#y"),
]
REFS = [
    (1, "b.html", "https://a.com/x/y.html?q#f"), (2, "/b c/é", "https://a.com/x/y"), (3, "//c.com/a.js", "https://a.com/"), (4, "../up/./z", "https://a.com/p/q/r"), (5, "?n=1", "https://a.com/p/q?m#f"),
    (6, "#top", "https://a.com/p?m"), (7, "mailto:x@y.z", "https://a.com/"), (8, "HTTPS://B.com:443/k", "https://a.com/"), (9, "", "https://a.com/p?m#f"), (10, "x", "nothing"), (11, None, "https://a.com/"), (12, "../../..", "https://a.com/p/q/"),
    (13, "dir/", "https://a.com"), (14, "http://c.com:8080/a?b=é#ü", "https://a.com/"),
]
TYPES = [
    (1, "x.js", "application/javascript", 200), (2, "x", "application/ld+json", 200), (3, "a.woff2", None, 200), (4, "a.css?v=1", None, 404), (5, "/f", "application/font-woff", 200), (6, "a.bmp", "image/bmp", 500), (7, "p.pdf", "application/pdf", 200),
    (8, "https://a.com/x", None, None), (9, "v.webm", "video/webm", 200), (10, "data:image/png;base64,AA", "image/png", 200), (11, "a.mjs", "", 200), (12, "blob:x", "text/html; charset=utf-8", 200), (13, "s.svg", "text/css", 301),
]
CONTENTS = [
    (1, "774F4632AABB", "font/woff2", "a.woff2"), (2, "3C21646F63747970652068746D6C3E", "text/css", "a.css"), (3, "424D000000000000", "image/bmp", "a.bmp"), (4, "89504E470D0A1A0A", "image/png", "a"), (5, "FFD8FFE000104A46", "", "a.jpg?x"), (6, "0001000000", "font/ttf", "f"),
    (7, "3C68746D6C3E", "text/html", "i"), (8, "3C68746D6C3E", "application/octet-stream", "a.js"), (9, "3C68746D6C3E", "application/octet-stream", "a.bin"), (10, "52494646AAAAAAAA57454250", "image/webp", "w"), (11, "00000100", "image/x-icon", "i.ico"), (12, "2020203C73766720", "image/svg+xml", "s"),
    (13, "474946383961AAAA", None, "g.gif"), (14, "", "text/plain", "t"), (15, "4F54544F", "", "x.otf#a"), (16, "474946383861AAAA", "image/gif", "g"),
]
ROBOTS = [
    ("a.com", "User-agent: *\nDisallow: /p\nAllow: /p/ok\n# note\nDisallow:\n"), ("b.com", "User-agent: other\nDisallow: /x\n\nUser-agent: *\nDisallow: /*.pdf$\r\nDisallow: /Tmp"), ("c.com", "User-agent: *\nDisallow: /"), ("d.com", "Sitemap: http://d.com/s\nno colon here"),
    ("f.com", "User-agent: *\nDisallow: /a[b\nDisallow: /c(d)*.e$\nDisallow: /x_y+"),
]
PATHS = [("a.com", "/p/x"), ("a.com", "/p/ok"), ("a.com", "/q"), ("b.com", "/a.pdf"), ("b.com", "/a.pdfx"), ("b.com", "/tmp/1"), ("b.com", "/x"), ("c.com", "/any"), ("d.com", "/any"), ("e.com", "/any"), ("f.com", "/a[bc"), ("f.com", "/ab"), ("f.com", "/c(d)/1.e"), ("f.com", "/c(d)/1.e?"), ("f.com", "/cd/1.e"), ("f.com", "/x_y+z"), ("f.com", "/xzyy")]
CSS = [
    (1, "https://s.com/css/a.css", "@import \"x.css\"; p{background:url(a.png)} q{background:url(a.png)}"), (2, "https://s.com/css/b.css", "a{b:url('/img/c.gif')} @import url(d.css) ; e{f:url(\"data:image/png;base64,AA\")} g{h:url(#i)}"),
    (3, "https://s.com/css/c.css", "@font-face{src:url(a.woff2),url(b.woff)} @font-face{src: url('https://s.com/f/c.ttf')} i{j:url(https://o.com/z.otf)}"), (4, "https://s.com/d.css", "no references"), (5, "https://s.com/e.css", ""), (6, "https://s.com/f.css", None),
]
JS = [
    (1, "https://s.com/_next/static/chunks/m.js", "import('/a.js'); fetch(\"/api/x\", {}); axios.post('/v1/y'); fetch('https://s.com/api/z')"), (2, "https://s.com/m.js", "x.open(\"GET\", \"/api/x\"); y=\"/_next/static/media/f.woff2\"; z=`/t/a.png`; w='/plain/one'; path: \"/route\", path: 'rel'"),
    (3, "https://s.com/_next/static/a/m.js", "k=\"../media/f.woff2\"; d='/_next/data/b1/p.json'; o=`https://o.com/q`; import(\"https://o.com/m.js\")"), (4, "https://s.com/n.js", "nothing"), (5, "https://s.com/o.js", None),
]
ASSETS = [
    ("https://s.com/css/a.png", "assets/img/h1.png"), ("https://s.com/img/c.gif", "assets/img/h2.gif"), ("https://s.com/css/d.css", "assets/css/h3.css"), ("https://www.s.com/a.js", "assets/js/h4.js"), ("https://s.com/_next/static/media/f.woff2", "assets/fonts/h5.woff2"),
    ("https://s.com/plain/one", "assets/other/h6"), ("https://s.com/api/x", "assets/api/h7.json"), ("https://s.com/css/b.woff", "assets/fonts/h8.woff"),
]
SRCSETS = [(1, "https://s.com/", "css/a.png 1x, b.png 2x"), (2, "https://s.com/", "/img/c.gif"), (3, "https://s.com/", "https://s.com/css/a.png  640w  x,, /q 2x")]
COOKIES = [(1, "a=1; b=x=y; =z;"), (2, ""), (3, "flag"), (4, " s = t ")]
SIZES = [(1, 0), (2, 1), (3, 1023), (4, 1024), (5, 1536), (6, 1048576), (7, 1073741824), (8, 5 * 1024**4), (9, 123456789)]
QUEUE = [("u1", 0, None, 5, 0), ("u2", 1, "u1", 5, 1), ("u3", 1, "u1", 7, 3), ("u4", 2, "u2", 0, 2), ("u5", 0, None, 5, 4)]
ADDS = [("u1", "h1", 10, 1), ("u2", "h1", 10, 2), ("u3", "h2", 5, 3), ("u1", "h9", 1, 4)]
STORED = [("https://s.com/1", "h1", "p1", 1, 10), ("https://s.com/2", "h1", "p2", 2, 10), ("https://s.com/3", None, "p3", 3, 0), ("https://s.com/4", None, "p4", 4, 0), ("https://s.com/5", "h2", "p5", 5, 7)]
RESPONSES = [(1, 1, "https://s.com/a", 200, 5), (2, 1, "https://s.com/a", 304, 9), (3, 2, "https://s.com/a", 200, 7), (4, 2, "https://s.com/b", 404, 1)]
SPA = [(1, "pushState", "/a"), (2, "popstate", "/b"), (3, "pushState", "/a"), (4, "click", "/c")]
FILES = [("index.html",), ("a/index.html",), ("css/x.css",)]
ASKED = [("/",), ("/a/index.html?x=1",), ("/missing",), ("/a/",), ("/css/x.css",)]
HTML = [
    (1, "https://s.com/", '<html><head><meta http-equiv="refresh" content="5; url=/two"><meta property="og:image" content="/img/c.gif"><link rel="stylesheet" href="/css/d.css"></head><body><a href="/two#x">t</a><a href="/two">u</a><!-- <a href="/two"> --><img src="css/a.png"><script src="/a.js"></script><script>import("/a.js")</script></body></html>'),
    (2, "https://s.com/two", "<html><head><base href='/'></head><body><a href='mailto:a@b'>m</a><div data-bg='/img/c.gif' style=\"background:url('css/a.png')\"></div><img srcset=\"css/a.png 1x, no.png 2x\"><iframe src='/'></iframe></body></html>"),
    (3, "https://s.com/three", "plain text"),
    (4, "https://s.com/four", '<a title="x > y" href=/two>t</a><img alt=a src=css/a.png>'),
]
PAGE_MAP = [("https://s.com/", "index.html"), ("https://s.com/two", "two/index.html")]


def sql(rows: list[tuple]) -> str:
    """The rows as VALUES."""
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: Every page with a host of its own.
PAGES = "(SELECT page_id, 'p' || page_id || '.' || lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages)"


def on_pages(pages: DataFrame, rows: list[tuple], schema: str, host: str = "s.com") -> DataFrame:
    """The rows for every page: ids are page_id * 100 + id, and ``host`` in any text is the page's own host."""
    names = [f.split() for f in schema.split(", ")]
    each = F.from_json(F.lit(json.dumps([dict(zip((n for n, _ in names), r)) for r in rows])), f"array<struct<{schema}>>")
    own = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("."), F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1)))
    every = pages.select("page_id", own.alias("_own"), F.explode(each).alias("r"))
    value = {"int": lambda n: F.col(f"r.{n}"), "string": lambda n: F.replace(F.col(f"r.{n}"), F.lit(host), F.col("_own"))}
    return every.select(*((F.col("page_id") * 100 + F.col("r.id") if n == "id" else value[kind](n)).alias(n) for n, kind in names))


def on_pages_sql(rows: list[tuple], names: str, host: str = "s.com") -> str:
    """The same in SQL."""
    cols = names.split(", ")
    text = [any(isinstance(r[i], str) for r in rows) for i in range(len(cols))]
    each = ("page_id * 100 + id AS id" if n == "id" else f"replace({n}, '{host}', host) AS {n}" if t else n for n, t in zip(cols, text))
    return f"(SELECT {', '.join(each)} FROM {PAGES}, {sql(rows)} t({names}))"


def augmented(pages: DataFrame) -> DataFrame:
    """Pages with a style sheet, a script, an icon and an image, whose names repeat over pages."""
    page = F.col("page_id")
    extra = F.concat(
        F.lit('<link rel="stylesheet" href="/css/s'), (page % 7).cast("string"), F.lit('.css"><script src="/js/a'), (page % 5).cast("string"), F.lit('.js"></script><link rel="shortcut icon" href="/i'),
        (page % 3).cast("string"), F.lit('.ico"><img src="img/p'), (page % 4).cast("string"), F.lit('.png"><img src="/css/s'), (page % 7).cast("string"), F.lit('.css"></head>'),
    )
    return pages.withColumn("html", F.replace("html", F.lit("</head>"), extra))


AUGMENTED = """(SELECT page_id, url, replace(html, '</head>', '<link rel="stylesheet" href="/css/s' || (page_id % 7) || '.css"><script src="/js/a' || (page_id % 5) || '.js"></script><link rel="shortcut icon" href="/i'
 || (page_id % 3) || '.ico"><img src="img/p' || (page_id % 4) || '.png"><img src="/css/s' || (page_id % 7) || '.css"></head>') AS html FROM pages)"""
