"""Generators of attacked texts, as column expressions: for recovery tests and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and their Cyrillic look-alikes; invisible characters in turn; marks for zalgo.
LATIN, LOOKALIKE = "aceopxysij", "асеорхуѕіј"
INVISIBLES = "\u200B\u200C\u200D\uFEFF\u2060"
ZALGO = "\u0316\u0300\u0315"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def homoglyph(c) -> Column:
    return F.translate(_col(c), LATIN, LOOKALIKE)


def invisible(c) -> Column:
    """An invisible character after each character, five kinds in turn: whole fives by one pattern, the rest one by one."""
    text, n = _col(c), len(INVISIBLES)
    whole = (F.floor(F.length(text) / n) * n).cast("int")
    fives = F.regexp_replace(F.substring(text, F.lit(1), whole), "(?s)" + "(.)" * n, "".join(f"${k + 1}{x}" for k, x in enumerate(INVISIBLES)))
    rest = F.split(F.substring(text, whole + 1, F.length(text)), "")
    tail = F.array_join(F.transform(rest, lambda x, i: F.when(x == "", x).otherwise(F.concat(x, F.substring(F.lit(INVISIBLES), i + 1, F.lit(1))))), "")
    return F.concat(fives, tail)


def bidi(c) -> Column:
    text = _col(c)
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.lit("\u202E"), F.substring(text, F.lit(1), half), F.lit("\u200F"), F.substring(text, half + 1, F.length(text)), F.lit("\u202C"))


def zalgo(c) -> Column:
    return F.regexp_replace(_col(c), r"(\p{L})", f"$1{ZALGO}")


def combined(c) -> Column:
    return bidi(invisible(homoglyph(c)))


ATTACKS = {"homoglyph": homoglyph, "invisible": invisible, "bidi": bidi, "zalgo": zalgo, "combined": combined}
