"""Languages and scripts as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .charsets import RTL, SCRIPT_RANGES
from .tables import LANGUAGES, REVERSE
from .translit import LANG_CODES, SCRIPT_LANG

#: Version of the Unicode security data that the confusable tables are built from.
CONFUSABLES_VERSION = "16.0.0"
CONTEXT_LANGS = ("ar", "fa", "he")

# English names of languages.
_NAMES = (
    "am Amharic|ar Arabic|as Assamese|ban Balinese|bax Bamum|bg Bulgarian|bn Bengali|bo Tibetan|bug Buginese|ca Catalan|chr Cherokee|cjm Cham|cop Coptic|cs Czech|cy Welsh|da Danish|de German|dv Dhivehi|"
    "el Greek|en English|es Spanish|et Estonian|fa Persian|fi Finnish|fr French|ga Irish|gu Gujarati|he Hebrew|hi Hindi|hr Croatian|hu Hungarian|hy Armenian|is Icelandic|it Italian|iu Inuktitut|"
    "ja Japanese|ja-kunrei Japanese (Kunrei)|jv Javanese|ka Georgian|khb Lue|km Khmer|kn Kannada|ko Korean|lis Lisu|lo Lao|lt Lithuanian|lv Latvian|ml Malayalam|mn Mongolian|mni Manipuri|mr Marathi|"
    "mt Maltese|my Burmese|nb Norwegian Bokmål|ne Nepali|nl Dutch|nn Norwegian Nynorsk|no Norwegian|nod Northern Thai|nqo N'Ko|or Odia|pa Punjabi|pl Polish|pt Portuguese|ro Romanian|ru Russian|"
    "sa Sanskrit|sat Santali|si Sinhala|sk Slovak|sl Slovenian|sq Albanian|sr Serbian|su Sundanese|sv Swedish|syr Syriac|ta Tamil|tdd Tai Nüa|te Telugu|th Thai|tl Tagalog|tr Turkish|tzm Tamazight|"
    "uk Ukrainian|vai Vai|vi Vietnamese|zh Chinese"
)
LANG_NAMES = dict(x.split(" ", 1) for x in _NAMES.split("|"))
_BY_LANG = {lang: script for script, lang in reversed(SCRIPT_LANG.items())} | dict.fromkeys(("bg", "ru", "sr", "uk", "mn"), "Cyrillic") | dict.fromkeys(("ar", "fa"), "Arabic")
_BY_LANG |= {"as": "Bengali", "mr": "Devanagari", "ne": "Devanagari", "sa": "Devanagari", "iu": "CanadianAboriginal", "ja": "Hiragana", "ja-kunrei": "Hiragana"}


def list_langs() -> list[str]:
    return sorted(LANG_CODES)


def list_scripts() -> list[str]:
    return sorted({s for _, _, s in SCRIPT_RANGES if s != "Inherited"})


def list_context_langs() -> list[str]:
    return sorted(CONTEXT_LANGS)


def lang_info(code: str) -> dict:
    if code not in LANG_CODES:
        raise ValueError(f"unknown language {code!r}")
    return {"code": code, "name": LANG_NAMES.get(code, code), "script": _BY_LANG.get(code, "Latin"), "own_table": code in LANGUAGES, "reversible": code in REVERSE, "context": code in CONTEXT_LANGS}


def script_info(name: str) -> dict:
    ranges = [(a, b) for a, b, s in SCRIPT_RANGES if s == name]
    if not ranges:
        raise ValueError(f"unknown script {name!r}")
    return {"name": name, "default_lang": SCRIPT_LANG.get(name), "rtl": name in RTL, "n_ranges": len(ranges), "n_points": sum(b - a + 1 for a, b in ranges)}


def lang_meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(lang_info(c).values()) for c in list_langs()], "code string, name string, script string, own_table boolean, reversible boolean, context boolean")


def script_meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(script_info(s).values()) for s in list_scripts()], "name string, default_lang string, rtl boolean, n_ranges int, n_points int")
