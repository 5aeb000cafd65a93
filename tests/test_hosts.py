import random

import pytest

from tidemill.functions import hosts

# the standard's examples and what follows from its steps
KNOWN = {
    "EXAMPLE.COM": "example.com", "example%2Ecom": "example.com", "faß.example": "xn--fa-hia.example", "0": "0.0.0.0", "0xffffffff": "255.255.255.255", "%30": "0.0.0.0", "256": "0.0.1.0", "127.1": "127.0.0.1", "0x7f.1": "127.0.0.1",
    "192.0x00A80001": "192.168.0.1", "0300.168.0.1.": "192.168.0.1", "1.2.3.256": None, "256.1.1.1": None, "1.2.3.4.5": None, "09": None, "4294967296": None, "1.2.3.08": None, "a.09": None, "a.0x": None, "1.2.3.a": "1.2.3.a",
    "münchen.de": "xn--mnchen-3ya.de", "МОСКВА.рф": "xn--80adxhks.xn--p1ai", "例え。テスト": "xn--r8jz45g.xn--zckzah", "ＧＯ.com": "go.com", "a­b.com": "ab.com", "xn--mnchen-3ya.de": "xn--mnchen-3ya.de", "xn--.com": None, "xn--abc-.com": None,
    "a b": None, "a<b": None, "a%00b": None, "%ff": None, "": None, "[::1]": "[::1]", "[0:0::1]": "[::1]", "[1:0:0:2:0:0:0:3]": "[1:0:0:2::3]", "[0:1:0:1:0:1:0:1]": "[0:1:0:1:0:1:0:1]", "[1:2:0:4:5:6:7:8]": "[1:2:0:4:5:6:7:8]",
    "[::127.0.0.1]": "[::7f00:1]", "[::ffff:1.2.3.4]": "[::ffff:102:304]", "[2001:DB8::]": "[2001:db8::]", "[::]": "[::]", "[::1%25eth]": None, "[:1]": None, "[1::2::3]": None, "[::1": None, "a_b.com": "a_b.com", "a..b": "a..b", "x.": "x.",
}


def test_known_hosts(spark):
    rows = spark.createDataFrame([(h,) for h in [*KNOWN, None]], "host string")
    got = {r.host: r.out for r in hosts.with_host(rows, "host", "out").collect()}
    assert got == KNOWN | {None: None}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_standard_library(spark, seed):
    r = random.Random(seed)
    names = [".".join("".join(r.choice("abcéñüжш中文") for _ in range(r.randint(1, 8))) for _ in range(3)) for _ in range(200)]
    rows = spark.createDataFrame([(n,) for n in names], "host string")
    for row in hosts.with_host(rows, "host", "out").collect():
        assert row.out == row.host.encode("idna").decode()


def test_urls(spark):
    urls = {"HTTP://user@MÜNCHEN.de:80/ä?q#f": "http://user@xn--mnchen-3ya.de/ä?q#f", "https://[::0001]:444": "https://[::1]:444", "https://2130706433:443/x": "https://127.0.0.1/x", "http://a.com:": "http://a.com", "http://a b/": None, "mailto:x": None, "": None}
    rows = spark.createDataFrame([(u,) for u in [*urls, None]], "url string")
    assert {r.url: r.out for r in hosts.with_canonical_url(rows, "url", "out").collect()} == urls | {None: None}


def test_every_row_stays(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = hosts.with_canonical_url(pages, "url", "out")
    assert out.count() == pages.count() and out.columns == [*pages.columns, "out"]
