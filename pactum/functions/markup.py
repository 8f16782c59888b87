"""Text of markup as Spark expressions whose time grows with the length of the text alone."""

from __future__ import annotations

import codecs
import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = 0x10FFFF
_REPLACED = "�"


def _with(col: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``col``, whose expression stands only once in it however often ``f`` uses its value."""
    return F.get(F.transform(F.array(col), f), F.lit(0))


def without_elements(col: Column, tag: str) -> Column:
    """``col`` with each ``tag`` element, up to the first end tag after its start tag, replaced by a blank.

    The text is cut at end tags, and in each part but the last everything from the first start tag on goes.  A part
    is searched once, as the atomic group holds on to the first start tag: no end tag is looked for again and again.
    A start tag that no end tag follows stays.
    """
    return _cut_out(col, rf"(?i)</{tag}\s*>", rf"(?is)^(?>(.*?)<{tag}\b)[^>]*>.*$", f"</{tag}>")


def without_comments(col: Column) -> Column:
    """``col`` with each comment replaced by a blank; one without an end stays."""
    return _cut_out(col, "-->", r"(?is)^(?>(.*?)<!--).*$", "-->")


def _cut_out(col: Column, end: str, start: str, kept: str) -> Column:
    def joined(parts: Column) -> Column:
        def part(s: Column, at: Column) -> Column:
            return F.when(at == F.size(parts) - 1, s).when(s.rlike(start), F.regexp_replace(s, start, "$1 ")).otherwise(F.concat(s, F.lit(kept)))

        return F.array_join(F.transform(parts, part), "")

    return _with(F.split(col, end), joined)


def replace_tags(col: Column, name: str, by: str) -> Column:
    """``col`` with the tags whose inside begins with the pattern ``name`` replaced; behind the last > nothing can be one."""

    def replaced(parts: Column) -> Column:
        head = F.substring(parts["all"], F.lit(1), F.length(parts["all"]) - F.length(parts["tail"]))
        return F.concat(F.regexp_replace(head, rf"(?is)<{name}[^>]*>", by), parts["tail"])

    return _with(_with(col, lambda x: F.struct(x.alias("all"), F.substring_index(x, ">", -1).alias("tail"))), replaced)


def unescaped(col: Column) -> Column:
    """``col`` with the character references of HTML 5 decoded, as Python's ``html.unescape`` does.

    Named ones may lack their semicolon where HTML allows it (the longest such name wins).  Numbers of no character
    become the replacement character or nothing, and 128 to 159 are read as Windows-1252.
    """

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda x, at: F.when(at == 0, x).otherwise(_reference(x))), "")

    return _with(F.split(col, "&"), joined)


def _table(names: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _reference(piece: Column) -> Column:
    """A reference without its &, and the text behind it."""
    closed = {k: v for k, v in html5.items() if k.endswith(";")}
    open_ = {k: v for k, v in html5.items() if not k.endswith(";")}
    names, open_names = _table(closed), _table(open_)

    def decoded(pattern: str, value: Column) -> Column:
        return F.concat(value, F.substring(piece, F.length(F.regexp_extract(piece, pattern, 0)) + 1, F.length(piece)))

    def number(pattern: str, base: int, digits: int) -> Column:
        figures = F.regexp_extract(piece, pattern, 1)
        n = F.when(F.length(figures) > digits, F.lit(_END + 1)).otherwise(F.conv(F.concat(F.lit("0"), figures), base, 10).cast("int"))
        return decoded(pattern, _character(n))

    name, short = r"^[^\t\n\f <&#;]{1,32};", rf"^(?:{'|'.join(sorted(open_, key=len, reverse=True))})"
    named = F.coalesce(decoded(name, F.try_element_at(names, F.regexp_extract(piece, name, 0))), decoded(short, F.try_element_at(open_names, F.regexp_extract(piece, short, 0))))
    decimal, hexadecimal = "^#0*([0-9]*);?", "^#[xX]0*([0-9a-fA-F]*);?"
    return F.when(piece.rlike("^#[0-9]"), number(decimal, 10, 7)).when(piece.rlike("^#[xX][0-9a-fA-F]"), number(hexadecimal, 16, 6)).otherwise(F.coalesce(named, F.concat(F.lit("&"), piece)))


def _windows(n: int) -> str:
    try:
        return codecs.decode(bytes([n]), "cp1252")
    except UnicodeDecodeError:
        return chr(n)


def _character(n: Column) -> Column:
    """The character of a number in a reference; empty for those that HTML gives no character."""
    old = F.array(*[F.lit(_windows(k)) for k in range(128, 160)])
    silent = n.between(1, 8) | n.between(14, 31) | n.isin(11, 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > _END), F.lit(_REPLACED))
        .when(n.between(128, 159), F.get(old, n - 128))
        .when(silent, F.lit(""))
        .otherwise(wide)
    )
