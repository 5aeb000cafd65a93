"""HTML as a sequence of tokens, by one pattern that is applied from left to right.

A match of TOKEN is a comment, a declaration, an element whose content is text up to its own end tag, or a tag. As each
match takes up where the last one ended, the pattern acts as the tokeniser's states do: what stands in a comment, in a style
sheet, a script, a title or a text field, or in a quoted value is never taken for a tag, and what is left open reaches to
the end of the text. Unlike a parser in Python this stays in Spark's generated code, without a copy of every page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text, urls

#: Elements whose content holds no tags.
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"
# What may follow a <. All patterns begin with that one character, which is what a search looks for first.
COMMENT = r"!--(?:-?>|[\s\S]*?(?:--!?>|\z))"
_DECLARATION = r"(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\z)"
#: Attributes: a value in quotes that are never closed reaches to the end.
_VALUE = r"(?:\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z)|[^\s\"'>][^\s>]*+|)"
INSIDE = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+"
_TAG = rf"/?[a-zA-Z][^\s/>]*+{INSIDE}(?:>|\z)"


def one_of(*bodies: str) -> str:
    """A pattern of what follows a <, in order of precedence."""
    return f"(?is)<(?:{'|'.join(bodies)})"


def raw_element(names: str) -> str:
    """Elements whose content is text, up to their end tag."""
    return "|".join(rf"{n}(?=[\s/>]){INSIDE}>(?:[\s\S]*?(?=</{n}(?:[\s/>]|\z))|[\s\S]*+)" for n in names.split("|"))


TOKEN = one_of(COMMENT, _DECLARATION, raw_element(RAW), _TAG)


def tokens(html: Column) -> Column:
    """Comments, declarations, raw elements (with their content) and tags, in order."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def _named(html: Column, name: str) -> Column:
    return F.filter(tokens(html), lambda t: t.rlike(rf"(?i)^<(?:{name})(?=[\s/>])"))


def tags(html: Column, name: str) -> Column:
    """The start tags of elements of that name (alternatives by |), in order."""
    if not set(name.split("|")) & set(RAW.split("|")):
        # only what is asked for is taken out of the page; the rest is stepped over
        wanted = rf"((?:{name})(?=[\s/>]){INSIDE})>"
        found = F.regexp_extract_all(html, F.lit(one_of(COMMENT, _DECLARATION, raw_element(RAW), wanted, _TAG)), F.lit(1))
        return F.transform(F.filter(found, lambda t: t != ""), lambda t: F.concat(F.lit("<"), t, F.lit(">")))
    opened = F.transform(_named(html, name), lambda t: F.regexp_extract(t, rf"^<[^\s/>]++{INSIDE}>", 0))
    return F.filter(opened, lambda t: t != "")


def raw_texts(html: Column, name: str) -> Column:
    """What stands in raw elements of that name, in order; entities stay as they are."""
    return F.transform(_named(html, name), lambda t: F.regexp_replace(t, rf"^<[^\s/>]++{INSIDE}>", ""))


#: A tag by one of its attributes: (before the value, the value with its quotes if any, after it). Attributes before it are stepped over
#: whole, so a name within another one's value is none.
def attribute_pattern(name: str) -> str:
    value = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)"
    return rf"(?is)^(<[^\s>/]*+(?:[\s/\"'=]++|(?!{name}\s*=)[^\s\"'>/=][^\s>/=]*+(?:\s*+=\s*+{value})?+)*+{name}\s*+=\s*+)({value})(.*)$"


def raw_attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute as it stands, quoted or not; null without one, or where it has no value."""
    bare = lambda raw: F.when(raw.startswith('"') | raw.startswith("'"), F.substr(raw, F.lit(2), F.length(raw) - 2)).when(raw != "", raw)
    return F.get(F.transform(F.array(F.regexp_extract(tag, attribute_pattern(name), 2)), bare), F.lit(0))  # so that the tag stands in the plan once


def attribute(tag: Column, name: str) -> Column:
    """The decoded value."""
    return text.decode_entities(raw_attribute(tag, name), in_attribute=True)


def base_url(html: Column, url: Column) -> Column:
    """What references of a page are relative to: its first base tag with a reference, else its URL."""
    named = F.filter(F.transform(tags(html, "base"), lambda t: attribute(t, "href")), lambda h: h.isNotNull())
    return F.when(html.rlike(r"(?i)<base[\s/]"), F.coalesce(urls.resolve(F.get(named, F.lit(0)), url), url)).otherwise(url)
