"""Plain text of HTML in Spark's own expressions: entities, tags, blanks."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content is no text, and elements whose end parts words.
SILENT = "script|style"
PARTING = "p|li|h[1-6]|td|th|br|div"
#: The inside of a tag: quoted values may hold its end.
_INSIDE = r"""(?:[^'">]++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+"""
#: Names that count without a semicolon, the longest first, and what those with one stand for; from the standard's own table.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
#: A map is searched from its beginning, so the short names, which are the usual ones, come first.
_NAMED = json.dumps({n: html5[n] for n in sorted(html5, key=len)})
#: Numbers from 128 to 159 are read as the Windows characters of those places.
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))


def _character(number: Column) -> Column:
    """The character of a code point; a blank mark for surrogates and what lies beyond the last, nothing for controls and non-characters."""
    n = F.coalesce(number, F.lit(0x110000))
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�")
        .when(n.between(128, 159), F.substring(F.lit(_WINDOWS), (n - 127).cast("int"), F.lit(1)))
        .when((n < 32) & ~n.isin(9, 10, 12, 13) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE), "")
        .otherwise(plain)
    )


def _decoded(piece: Column, bare_names: bool) -> Column:
    """What follows an ampersand, with its reference read; the ampersand stays where there is none."""
    number = F.regexp_extract(piece, r"^#([0-9]+|[xX][0-9a-fA-F]+);?", 1)
    digits = F.regexp_replace(number, "^[xX]?0*(?=.)", "")
    # More digits than a code point has count as beyond the last.
    value = F.when(F.lower(F.substring(number, 1, 1)) == "x", F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
    of_number = _character(F.when(F.length(digits) <= 7, value.cast("bigint")))
    name = F.regexp_extract(piece, r"^[A-Za-z][A-Za-z0-9]{0,31};", 0)
    bare = F.regexp_extract(piece, f"^(?:{_BARE})", 0) if bare_names else F.lit("")
    table = F.from_json(F.lit(_NAMED), "map<string,string>")
    whole = F.when(name != "", F.try_element_at(table, name))
    rest = lambda n: F.substring(piece, n + 1, F.length(piece))
    return (
        F.when(number != "", F.concat(of_number, rest(F.length(F.regexp_extract(piece, r"^#[0-9a-fA-FxX]*;?", 0)))))
        .when(whole.isNotNull(), F.concat(whole, rest(F.length(name))))
        .when(bare != "", F.concat(F.try_element_at(table, bare), rest(F.length(bare))))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescape(text: Column, bare_names: bool = True) -> Column:
    """Character references read once: by number, by name, and with ``bare_names`` the old names also without a semicolon."""
    pieces = F.transform(F.split(text, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(_decoded(p, bare_names)))
    return F.array_join(pieces, "")


def html_text(raw: Column, bare_names: bool = True) -> Column:
    """Entities read, then tags taken away; runs of blanks become one. Null and empty give an empty text.

    The ends of blocks, and blocks that end themselves, part words. Scripts and styles are no text;
    neither are comments, declarations, and a tag that is cut off at the end. The text left between
    tags has its references read once more, as it may come from an escaped document. Without ``bare_names`` a
    name that has lost its semicolon, as where a text was cut, stays text.
    """
    text = unescape(F.coalesce(raw, F.lit("")), bare_names)
    text = F.regexp_replace(text, r"(?s)<!--.*?(?:--!?>|\z)", "")
    text = F.regexp_replace(text, rf"(?is)<({SILENT})(?=[\s/>]){_INSIDE}(?<!/)>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\z)|\z)", "")
    text = F.regexp_replace(text, rf"(?i)</(?:{PARTING})(?=[\s/>])[^>]*>|<(?:{PARTING})(?=[\s/>]){_INSIDE}(?<=/)>", " ")
    text = F.regexp_replace(text, rf"</[A-Za-z][^>]*(?:>|\z)|<[!?/][^>]*(?:>|\z)|<[A-Za-z]{_INSIDE}(?:>|\z)", "")
    return F.regexp_replace(F.regexp_replace(unescape(text, bare_names), r"(?U)\s+", " "), "^ | $", "")


def bodies_text(bodies: Column) -> Column:
    """Plain texts of an array of HTML bodies, those that are not empty, joined by blanks; null gives an empty text."""
    texts = F.transform(F.coalesce(bodies, F.array().cast("array<string>")), lambda body: html_text(body))
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")
