"""Character sets and ranges that fix the meaning of the scalar functions."""

from __future__ import annotations

from bisect import bisect_right

# White space that collapses, and letters that render blank and count as white space.
FOLD_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000"
BLANK_LETTERS = "\u115F\u1160\u2800\u3164\uFFA0"
# Zero-width characters, bidirectional and deprecated format controls.
ZERO_WIDTH = "\u180E\u200B\u200C\u200D\u2060\u2061\u2062\u2063\u2064\uFEFF"
BIDI = "\u00AD\u061C\u200E\u200F\u202A\u202B\u202C\u202D\u202E\u2066\u2067\u2068\u2069\u206A\u206B\u206C\u206D\u206E\u206F\uFFF9\uFFFA\uFFFB"
# Regions whose flags are written with tag characters.
FLAG_REGIONS = ("gbeng", "gbsct", "gbwls")
GRAPHEME_JOINER = "\u034F"

# Script ranges, first to last code point; what is in none is Common.
_RANGES = """
0041-005A Latin|0061-007A Latin|00C0-02AF Latin|0300-036F Inherited|0370-03FF Greek|0400-052F Cyrillic|0530-058F Armenian|0590-05FF Hebrew|0600-06FF Arabic|0700-074F Syriac
0750-077F Arabic|0780-07BF Thaana|07C0-07FF NKo|0860-086F Syriac|08A0-08FF Arabic|0900-097F Devanagari|0980-09FF Bengali|0A00-0A7F Gurmukhi|0A80-0AFF Gujarati|0B00-0B7F Oriya
0B80-0BFF Tamil|0C00-0C7F Telugu|0C80-0CFF Kannada|0D00-0D7F Malayalam|0D80-0DFF Sinhala|0E00-0E7F Thai|0E80-0EFF Lao|0F00-0FFF Tibetan|1000-109F Myanmar|10A0-10FF Georgian
1100-11FF Hangul|1200-139F Ethiopic|13A0-13FF Cherokee|1400-167F CanadianAboriginal|1680-169F Ogham|16A0-16FF Runic|1700-171F Tagalog|1720-173F Hanunoo|1740-175F Buhid|1760-177F Tagbanwa
1780-17FF Khmer|1800-18AF Mongolian|18B0-18FF CanadianAboriginal|1950-197F TaiLe|1980-19DF NewTaiLue|19E0-19FF Khmer|1A00-1A1F Buginese|1A20-1AAF TaiTham|1AB0-1AFF Inherited|1B00-1B7F Balinese
1B80-1BBF Sundanese|1BC0-1BFF Batak|1C50-1C7F OlChiki|1C90-1CBF Georgian|1D00-1DBF Latin|1DC0-1DFF Inherited|1E00-1EFF Latin|1F00-1FFF Greek|20D0-20FF Inherited|2C60-2C7F Latin
2C80-2CFF Coptic|2D00-2D2F Georgian|2D30-2D7F Tifinagh|2D80-2DDF Ethiopic|2DE0-2DFF Cyrillic|2E80-2EFF Han|2F00-2FDF Han|3040-309F Hiragana|30A0-30FF Katakana|3130-318F Hangul
31F0-31FF Katakana|3400-4DBF Han|4E00-9FFF Han|A4D0-A4FF Lisu|A500-A63F Vai|A640-A69F Cyrillic|A6A0-A6FF Bamum|A720-A7FF Latin|A8E0-A8FF Devanagari|A960-A97F Hangul
A980-A9DF Javanese|AA00-AA5F Cham|AA60-AA7F Myanmar|AAE0-AAFF MeeteiMayek|AB00-AB2F Ethiopic|AB30-AB6F Latin|AB70-ABBF Cherokee|ABC0-ABFF MeeteiMayek|AC00-D7FF Hangul|F900-FAFF Han
FB00-FB06 Latin|FB13-FB17 Armenian|FB1D-FB4F Hebrew|FB50-FDFF Arabic|FE20-FE2F Inherited|FE70-FEFF Arabic|FF65-FF9F Katakana|10000-100FF LinearB|10330-1034F Gothic|103A0-103DF OldPersian
12000-1247F Cuneiform|20000-2A6DF Han|2A700-2B73F Han|2B740-2B81F Han|2B820-2CEAF Han|2CEB0-2EBEF Han|30000-3134F Han
"""
SCRIPT_RANGES = tuple((int(a.split("-")[0], 16), int(a.split("-")[1], 16), name) for a, name in (x.split() for x in _RANGES.replace("\n", "|").split("|") if x))
_STARTS = [a for a, _, _ in SCRIPT_RANGES]
RTL = ("Hebrew", "Arabic", "Syriac", "Thaana", "NKo")
CJK = ("Han", "Hiragana", "Katakana", "Hangul", "Bopomofo")


def script_of(ch: str) -> str:
    cp = ord(ch)
    k = bisect_right(_STARTS, cp) - 1
    return SCRIPT_RANGES[k][2] if k >= 0 and cp <= SCRIPT_RANGES[k][1] else "Common"


def ranges_of(*scripts: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b, s in SCRIPT_RANGES if s in scripts]


def merged(points) -> list[tuple[int, int]]:
    """Code points as a sorted list of ranges."""
    out: list[list[int]] = []
    for p in sorted(points):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def java_class(ranges) -> str:
    """The inside of a character class for Java's regular expressions."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def _points(text: str) -> list[tuple[int, int]]:
    return merged({ord(c) for c in text})


SPACE_CLASS = java_class(_points(FOLD_SPACE + BLANK_LETTERS))
CONTROL_CLASS = java_class(merged({c for c in (*range(32), *range(127, 160)) if chr(c) not in FOLD_SPACE}))
ZERO_WIDTH_CLASS = java_class(_points(ZERO_WIDTH))
BIDI_CLASS = java_class(_points(BIDI))
SELECTOR_RANGES = [(0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]
NONCHARACTER_RANGES = [(0xFDD0, 0xFDEF), *((p << 16 | 0xFFFE, p << 16 | 0xFFFF) for p in range(17))]
PRIVATE_RANGES = [(0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)]
TAG_RANGE = (0xE0000, 0xE007F)
#: A flag written with tags, as a pattern that works in Java and Python once the class syntax is chosen.
FLAGS = tuple("\U0001F3F4" + "".join(chr(0xE0000 + ord(c)) for c in region) + "\U000E007F" for region in FLAG_REGIONS)
