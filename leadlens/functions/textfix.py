"""Repair text that was decoded with the wrong code page.

``├`` and ``┼`` are code page 437/850 readings of UTF-8 lead bytes; ``Ã``/``Â`` are Latin-1
readings.  The charset is chosen by the trigger character, never by trial across all charsets
(trying cp850 on a Latin-1 case turns 'fÃ¼r' into 'fǬr').

Built-in functions only: a run of the code page's upper half is translated to the Latin-1
characters of the same bytes, encoded to those bytes, and read as UTF-8 where that is valid.  Each
run is repaired by itself, so a genuine dash or euro sign elsewhere in the text blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trigger characters and the code pages tried for them, in order.
BOX_TRIGGERS = "├┼"
LATIN1_TRIGGERS = "ÃÂ"
BOX_CODECS = ["cp437", "cp850"]
LATIN1_CODECS = ["latin-1"]
LATIN1_HIGH = "".join(map(chr, range(0x80, 0x100)))


def upper_half(codec: str) -> str:
    """The characters of a code page's bytes 0x80 to 0xFF, in order."""
    return bytes(range(0x80, 0x100)).decode(codec)


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


def _repair_runs(c: Column, codec: str) -> Column:
    """Each run of the code page's upper half as UTF-8, where its bytes are UTF-8."""
    high = upper_half(codec)
    inside = _class(high)
    pieces = F.regexp_extract_all(c, F.lit(f"(?s)([{inside}]+|[^{inside}]+)"), 1)

    def one(p: Column) -> Column:
        raw = F.encode(F.translate(p, high, LATIN1_HIGH), "ISO-8859-1")
        ok = p.rlike(f"^[{inside}]") & F.is_valid_utf8(raw.cast("string"))
        return F.when(ok, raw.cast("string")).otherwise(p)

    return F.array_join(F.transform(pieces, one), "")


def repair_text(c) -> Column:
    """Repaired text; text without a trigger character stays as it is.

    A text with several kinds of triggers is repaired for each kind; a run that is no UTF-8 in the
    first code page is tried in the next.
    """
    out = F.col(c) if isinstance(c, str) else c
    for triggers, codecs in ((BOX_TRIGGERS, BOX_CODECS), (LATIN1_TRIGGERS, LATIN1_CODECS)):
        for codec in codecs:
            out = _stage(out, triggers, codec)
    return out


def _stage(text: Column, triggers: str, codec: str) -> Column:
    """One code page.  The text so far enters as a lambda's variable, so that it is worked out once
    though the stage names it three times."""
    fixed = F.transform(F.array(text), lambda t: F.when(t.rlike(f"[{triggers}]"), _repair_runs(t, codec)).otherwise(t))
    return F.get(fixed, F.lit(0))
