"""Host names as URLs hold them: names of other alphabets in Punycode, numbers as IPv4, and IPv6 in its shortest form.

Nearly all hosts are plain names, for which lower case is all; expressions tell those apart. Only the distinct others go
through the parser, in Arrow batches, and come back by a join.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls

# Characters that no host may hold, and those that are not there at all.
FORBIDDEN = set("\x00\t\n\r #/:<>?@[\\]^|%\x7f") | {chr(i) for i in range(0x20)}
IGNORED = dict.fromkeys([0xAD, 0x200B, 0x2060, 0xFEFF, 0x180B, 0x180C, 0x180D, *range(0xFE00, 0xFE10)])
DOTS = {0x3002: ".", 0xFF0E: ".", 0xFF61: "."}
#: Hosts that lower case makes right: no number at the end, no Punycode to check, nothing but letters, digits, . - and _.
PLAIN = r"(?i)^(?!.*(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$)[a-z0-9._-]+$"


def _number(part: str) -> int | None:
    """A part of an IPv4 address: decimal, octal after 0, hexadecimal after 0x."""
    base = 16 if part[:2] in ("0x", "0X") else 8 if len(part) > 1 and part[0] == "0" else 10
    digits = part[2:] if base == 16 else part[1:] if base == 8 else part
    if not re.fullmatch({16: "[0-9a-fA-F]*", 8: "[0-7]*", 10: "[0-9]+"}[base], digits):
        return None
    return int(digits, base) if digits else 0


def ipv4(host: str) -> str | None:
    """Dotted decimals of one to four numbers, the last of which fills the rest; None if that is no address."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    numbers = [_number(p) if p else None for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def ipv6(text: str) -> str | None:
    """The eight pieces in lower case without leading zeros, the first longest run of zeros as ::."""
    from ipaddress import AddressValueError, IPv6Address

    if "%" in text:
        return None
    try:
        value = int(IPv6Address(text))
    except AddressValueError:
        return None
    pieces = [value >> 16 * (7 - i) & 0xFFFF for i in range(8)]
    runs = [(sum(1 for _ in re.match("0*", "".join("0" if p == 0 else "1" for p in pieces[i:]))[0]), -i) for i in range(8)]
    size, at = max(runs)
    if size < 2:
        return ":".join(f"{p:x}" for p in pieces)
    return ":".join(f"{p:x}" for p in pieces[:-at]) + "::" + ":".join(f"{p:x}" for p in pieces[-at + size :])


def _label(label: str) -> str:
    return label if label.isascii() else "xn--" + label.encode("punycode").decode()


def canonical(host: str | None) -> str | None:
    """The host as a URL holds it; None if it is none."""
    if not host:
        return None
    if host[0] == "[":
        found = ipv6(host[1:-1]) if host[-1] == "]" else None
        return found and f"[{found}]"
    try:
        text = unquote_to_bytes(host).decode()
    except UnicodeDecodeError:
        return None
    text = text.translate(IGNORED).translate(DOTS)
    # compatible characters and case; ß and the final sigma are letters of their own
    text = unicodedata.normalize("NFKC", text.lower()).lower()
    if not text or FORBIDDEN & set(text):
        return None
    try:
        labels = [_label(x) for x in text.split(".")]
        for x in labels:
            if x.startswith("xn--"):
                if not x[4:] or x[4:].encode().decode("punycode").isascii():
                    return None
    except UnicodeError:
        return None
    last = labels[-2] if labels[-1] == "" and len(labels) > 1 else labels[-1]
    if re.fullmatch("[0-9]+|0x[0-9a-f]*", last):
        return ipv4(".".join(labels))
    return ".".join(labels)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([canonical(h) for h in batch.column(0).to_pylist()], pa.string())], names=["_odd", "_host"])


def with_host(rows: DataFrame, host: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the canonical form of the column ``host``; null for what is no host. Rows with a plain host are
    neither joined nor shuffled."""
    plain = F.coalesce(F.col(host).rlike(PLAIN) & ~F.lower(host).rlike(r"(^|\.)xn--"), F.lit(True))
    easy = rows.filter(plain).withColumn(out, F.nullif(F.lower(host), F.lit("")))
    odd = rows.filter(~plain)
    found = odd.select(F.col(host).alias("_odd")).distinct().mapInArrow(_parsed, "_odd string, _host string")
    hard = odd.join(found, F.col(host) == F.col("_odd"), "left").withColumn(out, F.col("_host")).drop("_odd", "_host")
    return easy.unionByName(hard)


#: scheme, user info, host with its brackets, port, the rest
_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(:[0-9]*)?([\s\S]*)$"


def with_canonical_url(rows: DataFrame, url: str, out: str) -> DataFrame:
    """``rows`` with ``out``: ``url`` with its host in canonical form, and without its scheme's own port; null if it has none."""

    def part(i: int) -> Column:
        return F.regexp_extract(url, _SPLIT, i)

    found = with_host(rows.withColumn("_name", F.nullif(part(3), F.lit(""))), "_name", "_given")
    scheme = F.lower(part(1))
    own = F.when(scheme == "https", ":443").when(scheme == "http", ":80").otherwise(":")
    port = F.when(part(4).isin(":") | (part(4) == own), "").otherwise(part(4))
    whole = F.concat(scheme, F.lit("://"), part(2), F.col("_given"), port, part(5))
    return found.withColumn(out, F.when(urls.bound(F.col("_given"), lambda h: h.isNotNull()), whole)).drop("_name", "_given")
