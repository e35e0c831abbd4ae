"""HTML in built-in expressions: a tag scanner and character references.

``tags`` reads a page once, left to right: comments are passed over, a script or style element is one token
with its content, every other start tag is a token.  A ``>`` inside a quoted attribute does not end a
tag, and what looks like a tag inside a comment or script is none.  ``attribute`` reads one attribute of a
tag: double, single or no quotes, any case, the first of equal names, references decoded.

Every repetition is possessive or ends at a fixed text, so a page is read in one go; only a tag whose quote is never
closed is looked for again from the next tag on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INSIDE = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
TOKEN = (r"(?is)<!--.*?(?:-->|\z)|<script\b" + _INSIDE + r".*?(?:</script\s*+>|\z)|<style\b" + _INSIDE + r".*?(?:</style\s*+>|\z)|<[a-z]" + _INSIDE)
HEAD = r"(?is)^<[a-z]" + _INSIDE
NAME = r"^<([A-Za-z][A-Za-z0-9:-]*)"
END_OF_RAW = r"(?i)</(script|style)\s*>$"
ATTRIBUTE = r"""[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+"""
VALUE = r"""(?s)^[^=]*=\s*(?:"(.*)"|'(.*)'|(.*))$"""

# HTML's names of U+00A0 to U+00FF, in order of code point, and of other characters.
LATIN_1 = """nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute micro
para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute
Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times Oslash Ugrave Uacute Ucirc Uuml Yacute
THORN szlig agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml eth ntilde
ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml""".split()
OTHER = {"quot": '"', "amp": "&", "apos": "'", "lt": "<", "gt": ">", "OElig": "Œ", "oelig": "œ", "Scaron": "Š", "scaron": "š",
         "ensp": " ", "emsp": " ", "thinsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
         "sbquo": "‚", "ldquo": "“", "rdquo": "”", "bdquo": "„", "dagger": "†", "bull": "•", "hellip": "…",
         "permil": "‰", "lsaquo": "‹", "rsaquo": "›", "euro": "€", "trade": "™", "larr": "←", "rarr": "→"}
# A no-break space separates words like any other, so it is decoded to a plain one.
REFERENCES = {name: " " if name == "nbsp" else chr(0xA0 + i) for i, name in enumerate(LATIN_1)} | OTHER
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for numbers that are none."""
    fine = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    read = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code == 0xA0, F.lit(" ")).when(fine, read).otherwise(F.lit("�"))


def unescape(c) -> Column:
    """Character references decoded once: numbers in both notations and the names above; others stay as they are."""
    text = _c(c)
    names = F.create_map(*(F.lit(x) for pair in REFERENCES.items() for x in pair))

    def part(p: Column, i: Column) -> Column:
        ref = F.regexp_extract(p, REFERENCE, 1)
        rest = F.substring(p, F.length(ref) + 2, F.length(p))
        number = F.when(F.substring(ref, 1, 2).isin("#x", "#X"), F.conv(F.substring(ref, 3, 6), 16, 10)).otherwise(F.substring(ref, 2, 7)).cast("int")
        decoded = F.when(F.startswith(ref, F.lit("#")), _character(number)).otherwise(F.element_at(names, ref))
        return (F.when(i == 0, p).when(ref == "", F.concat(F.lit("&"), p))
                .otherwise(F.coalesce(F.concat(decoded, rest), F.concat(F.lit("&"), p))))

    return F.array_join(F.transform(F.split(text, "&"), part), "")


def tags(html) -> Column:
    """array<struct<name, head, content>> of a page's start tags in order: name in lower case, the tag itself,
    and the content of a script or style element (else empty)."""
    tokens = F.filter(F.regexp_extract_all(_c(html), F.lit(TOKEN), F.lit(0)), lambda t: ~F.startswith(t, F.lit("<!--")))

    def tag(t: Column) -> Column:
        head = F.regexp_extract(t, HEAD, 0)
        return F.struct(F.lower(F.regexp_extract(t, NAME, 1)).alias("name"), head.alias("head"),
                        F.regexp_replace(F.substring(t, F.length(head) + 1, F.length(t)), END_OF_RAW, "").alias("content"))

    return F.transform(tokens, tag)


def attribute(head, name: str) -> Column:
    """An attribute of a start tag, decoded; empty where it has no value, NULL without one."""
    inner = F.regexp_replace(_c(head), NAME + "|>$", "")
    given = F.filter(F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name)
    first = F.get(given, F.lit(0))
    return unescape(F.concat(*(F.regexp_extract(first, VALUE, k) for k in (1, 2, 3))))
