"""Entities, cookies, numbers and times."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _named() -> tuple[dict[str, str], list[str]]:
    """The named references of HTML by name, and the old names that need no semicolon, longest first."""
    from html.entities import html5

    return {name[:-1]: chars for name, chars in html5.items() if name.endswith(";")}, sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _character(code: Column) -> Column:
    """The character of a numeric reference: 128 to 159 are those of windows-1252, what is none becomes U+FFFD."""
    old = F.array(*(F.lit(bytes([i]).decode("cp1252", "ignore") or chr(i)) for i in range(128, 160)))
    wrong = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(wrong, "\ufffd").when(code.between(128, 159), F.get(old, (code - 128).cast("int"))).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_entities(x: Column, in_attribute: bool = False, closed: bool = False) -> Column:
    """Named and numeric character references as characters, each once; what is none stays as it is.

    Numbers and the old names need no semicolon; in attributes such a name counts only if neither = nor a letter or digit
    follows. With ``closed`` all need one, so a reference that is cut off stays. Only text with an ampersand is taken apart.
    """
    named, old = _named()
    names, old_names = (F.from_json(F.lit(json.dumps(m)), "map<string,string>") for m in (named, {n: named[n] for n in old}))
    bare = rf"^({'|'.join(old)})" + (r"(?![=A-Za-z0-9])" if in_attribute else "")

    def numbered(p: Column) -> Column:
        found = F.regexp_extract(p, r"^(#[0-9]+|#[xX][0-9A-Fa-f]+)" + (";" if closed else ""), 1)
        digits = F.when(found.rlike("^#[xX]"), F.conv(F.substr(found, F.lit(3)), 16, 10)).otherwise(F.substr(found, F.lit(2)))
        code = F.coalesce(digits.try_cast("long"), F.lit(1 << 40))
        rest = F.regexp_replace(p, r"^#(?:[xX][0-9A-Fa-f]+|[0-9]+);?", "")
        return F.when(found == "", F.concat(F.lit("&"), p)).otherwise(F.concat(_character(F.least(code, F.lit(0x110000))), rest))

    def worded(p: Column) -> Column:
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]{0,31});", 1)
        common = F.when(name == "amp", "&").when(name == "lt", "<").when(name == "gt", ">").when(name == "quot", '"')
        char = F.when(name != "", F.coalesce(common, F.try_element_at(names, name)))
        if closed:
            return F.when(char.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(char, F.substr(p, F.length(name) + 2)))
        short = F.regexp_extract(p, bare, 1)
        loose = F.when(short == "", F.concat(F.lit("&"), p)).otherwise(F.concat(F.try_element_at(old_names, short), F.substr(p, F.length(short) + 1)))
        return F.when(char.isNull(), loose).otherwise(F.concat(char, F.substr(p, F.length(name) + 2)))

    def after(p: Column) -> Column:
        return F.when(p.startswith("#"), numbered(p)).when(p.rlike("^[A-Za-z]"), worded(p)).otherwise(F.concat(F.lit("&"), p))

    def whole(parts: Column) -> Column:
        return F.when(F.size(parts) < 2, parts[0]).otherwise(F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1 << 20), after), "")))

    return F.get(F.transform(F.array(F.split(x, "&", -1)), whole), F.lit(0))  # so that x stands in the plan once


def cookies(raw: Column) -> Column:
    """``a=1; b=x=y`` as an array of (name, value): split at the first =, trimmed; empty names are dropped."""
    pair = lambda p: F.struct(F.trim(F.regexp_extract(p, "^([^=]*)", 1)).alias("name"), F.trim(F.regexp_replace(p, "^[^=]*=?", "")).alias("value"))
    return F.filter(F.transform(F.split(raw, ";", -1), lambda p: pair(F.trim(p))), lambda c: c["name"] != "")


def parse_int(x: Column) -> Column:
    """The integer that a string starts with, else null."""
    return F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("long")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
