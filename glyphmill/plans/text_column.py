"""A chainable wrapper around a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import native, udfs

_NATIVE = (
    "normalize fold_case casefold strip_accents remove_accents ascii_fold collapse_whitespace strip_control_chars strip_zero_width_chars strip_bidi strip_tags strip_variation_selectors "
    "strip_noncharacters strip_pua strip_invisible strip_zalgo escape_html strip_log_injection percent_encode grapheme_truncate strip_format"
).split()
_SCANNED = (
    "transliterate unidecode normalize_confusables canonicalize canonicalize_strict strip_obfuscation ml_normalize catalog_key search_key sort_key slugify sanitize_filename demojize apply_preset "
    "apply_pipeline security_clean normalize_user_input"
).split()
_ANSWERS = "is_ascii is_normalized is_zalgo has_bidi_conflict detect_scripts graphemes grapheme_len".split()
_SCANNED_ANSWERS = "is_confusable find_untranslatable find_unmapped_confusables analyze_hostname is_suspicious_hostname inspect_anomalies has_anomalies auto_lang terminal_width".split()


class TextCol:
    """``TextCol("text").strip_bidi().fold_case().value``: transforms chain, predicates and ``value`` end the chain."""

    def __init__(self, value: Column | str):
        self.value = F.col(value) if isinstance(value, str) else value

    def __repr__(self) -> str:
        return f"TextCol({self.value})"


def _chain(function):
    return lambda self, *args, **options: TextCol(function(self.value, *args, **options))


def _answer(function):
    return lambda self, *args, **options: function(self.value, *args, **options)


for _names, _module, _wrap in ((_NATIVE, native, _chain), (_SCANNED, udfs, _chain), (_ANSWERS, native, _answer), (_SCANNED_ANSWERS, udfs, _answer)):
    for _name in _names:
        setattr(TextCol, _name, _wrap(getattr(_module, _name)))
