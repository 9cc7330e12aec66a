"""All public names in one place: column functions, builders, metadata and constants."""

from __future__ import annotations

from enum import StrEnum

from .functions.errors import GlyphError, InvalidArgumentError, ResourceLimitError, UnsupportedError
from .functions.kernels import unmapped_confusables
from .functions.metadata import CONFUSABLES_VERSION, lang_info, lang_meta, list_context_langs, list_langs, list_scripts, script_info, script_meta
from .functions.native import (
    ascii_fold, casefold, collapse_whitespace, detect_scripts, display_clean, escape_html, fold_case, grapheme_len, grapheme_truncate, graphemes, has_bidi_conflict, is_ascii, is_normalized, is_zalgo,
    normalize, percent_encode, remove_accents, strip_accents, strip_bidi, strip_control_chars, strip_format, strip_invisible, strip_log_injection, strip_noncharacters, strip_pua, strip_tags,
    strip_variation_selectors, strip_zalgo, strip_zero_width_chars,
)
from .functions.registry import (
    CachedTransliterator, clear_replacements, dedup_batch, make_cached_transliterator, register_lang, register_replacements, registrations_sealed, remove_replacement, seal_registrations, set_emoji_provider,
)
from .functions.security import Lexicon
from .functions.translit import LANG_CODES, reverse_langs
from .functions.udfs import (
    Slugifier, analyze_hostname, apply_pipeline, apply_preset, auto_lang, canonicalize, canonicalize_strict, catalog_key, decode_to_utf8, demojize, detect_encoding, find_unmapped_confusables,
    find_untranslatable, grapheme_width, has_anomalies, inspect_anomalies, is_confusable, is_mixed_script, is_suspicious_hostname, ml_normalize, normalize_confusables, normalize_user_input, register,
    sanitize_filename, search_key, security_clean, slugify, slugify_compat, slugify_de, slugify_el, slugify_filename, slugify_ru, slugify_unicode, slugify_url, sort_key, strip_obfuscation,
    terminal_width, transliterate, transliterate_in_context, unidecode, unique_slugifier,
)
from .plans.presets import PRESETS, Pipeline, get_pipeline, list_profiles
from .plans.text_column import TextCol

grapheme_split = graphemes
inspect_auto_lang = auto_lang
Text, TextPipeline, UniqueSlugifier, Slugify, UniqueSlugify = TextCol, Pipeline, unique_slugifier, slugify_compat, unique_slugifier


class NF(StrEnum):
    C = "NFC"
    D = "NFD"
    KC = "NFKC"
    KD = "NFKD"


class Component(StrEnum):
    PATH = "path"
    SEGMENT = "segment"
    QUERY = "query"
    FORM = "form"


Script = StrEnum("Script", {s.upper(): s for s in list_scripts()})
LANG_META = {c: lang_info(c) for c in list_langs()}
SCRIPT_META = {s: script_info(s) for s in list_scripts()}
globals().update({f"LANG_{c.upper().replace('-', '_')}": c for c in LANG_CODES})

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("StrEnum", "annotations")]
