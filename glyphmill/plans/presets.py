"""Fixed-order presets and configurable pipelines.

A preset is a list of steps; the list is both what runs and what ``explain`` shows. Steps run as one
scanner, so a preset crosses from the JVM to Python once.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions import charsets as S
from ..functions import kernels as K
from ..functions.charsets import script_of
from ..functions.tables import Tables, fold_case, map_chars
from ..functions.translit import Romanizer

ROUNDS = 8
Steps = tuple[tuple[str, object], ...]

#: Steps of each preset in order: (step, parameter).
PRESETS: dict[str, Steps] = {
    "canonicalize": (("normalize", "NFKC"), ("strip_bidi", None), ("strip_invisible", "comparison"), ("strip_control", None), ("strip_zero_width", None), ("collapse_whitespace", None),
                     ("strip_zalgo", 2), ("normalize", "NFC"), ("confusables_fixed_point", "latin")),
    "canonicalize_strict": (("normalize", "NFKC"), ("strip_bidi", None), ("strip_zero_width", None), ("strip_control", None), ("strip_invisible", "comparison"), ("strip_zalgo", 2),
                            ("confusables_fixed_point", "latin"), ("collapse_whitespace", None), ("normalize", "NFC")),
    "strip_obfuscation": (("normalize", "NFKC"), ("strip_zalgo", 0), ("strip_bidi", None), ("strip_zero_width", None), ("demojize", None), ("strip_invisible", "comparison"), ("confusables", "latin"),
                          ("strip_accents", None), ("strip_control", None), ("collapse_whitespace", None)),
    "ml_normalize": (("normalize", "NFKC"), ("demojize", "cldr"), ("transliterate_if_lang", "ignore"), ("strip_accents", None), ("demojize", "cldr"), ("fold_case", None), ("strip_control", None),
                     ("strip_zero_width", None), ("collapse_whitespace", None)),
    "catalog_key": (("normalize", "NFKC"), ("strip_bidi", None), ("fold_case", None), ("catalog_fixed_point", None), ("fold_case", None), ("strip_control", None), ("strip_zero_width", None),
                    ("collapse_whitespace", None)),
    "search_key": (("normalize", "NFKC"), ("strip_bidi", None), ("fold_case", None), ("transliterate", "preserve"), ("strip_accents", None), ("fold_case", None), ("strip_control", None),
                   ("strip_zero_width", None), ("collapse_whitespace", None)),
    "sort_key": (("normalize", "NFKC"), ("strip_bidi", None), ("fold_case", None), ("transliterate_non_latin", "preserve"), ("fold_case", None), ("strip_control", None), ("strip_zero_width", None),
                 ("collapse_whitespace", None), ("normalize", "NFC")),
}
#: Older names.
ALIASES = {"security_clean": "canonicalize", "normalize_user_input": "canonicalize_strict"}


@dataclass
class Runner:
    """Runs steps on a string, with a preset's options."""

    tables: Tables
    lang: str | None = None
    strict_iso9: bool = False
    gost7034: bool = False
    emoji_style: str = "cldr"
    fold: bool = True
    _romanizers: dict = field(default_factory=dict)

    def _romanize(self, errors: str) -> Romanizer:
        if errors not in self._romanizers:
            self._romanizers[errors] = Romanizer(self.tables, self.lang, errors, strict_iso9=self.strict_iso9, gost7034=self.gost7034)
        return self._romanizers[errors]

    def _non_latin(self, s: str, errors: str) -> str:
        """Runs of letters of other scripts romanised; Latin letters and their marks stay."""
        if all(script_of(c) in ("Latin", "Common", "Inherited") for c in set(s)):
            return s
        runs: list[tuple[bool, str]] = []
        for ch in s:
            script = script_of(ch)
            other = runs[-1][0] if runs and script == "Inherited" else script not in ("Latin", "Common", "Inherited")
            if runs and runs[-1][0] == other:
                runs[-1] = other, runs[-1][1] + ch
            else:
                runs.append((other, ch))
        return "".join(self._romanize(errors)(part) if other else part for other, part in runs)

    def _catalog(self, s: str) -> str:
        table = self.tables.confusables("latin")
        for _ in range(ROUNDS):
            new = K.strip_accents(map_chars(self._romanize("preserve")(s), table))
            if new == s:
                break
            s = new
        return s

    def step(self, name: str, parameter, s: str) -> str:
        match name:
            case "normalize":
                return s if s.isascii() else unicodedata.normalize(parameter, s)
            case "strip_bidi":
                return K.strip_bidi(s)
            case "strip_invisible":
                return K.strip_invisible(s)
            case "strip_control":
                return K.strip_control(s)
            case "strip_zero_width":
                return K.strip_zero_width(s)
            case "collapse_whitespace":
                return K.collapse_whitespace(s)
            case "strip_zalgo":
                return K.strip_zalgo(s, parameter)
            case "strip_accents":
                return K.strip_accents(s)
            case "fold_case":
                return fold_case(s) if self.fold else s
            case "confusables":
                return map_chars(s, self.tables.confusables(parameter))
            case "confusables_fixed_point":
                table = self.tables.confusables(parameter)
                for _ in range(ROUNDS):
                    new = K.nfc(map_chars(s, table))
                    if new == s:
                        break
                    s = new
                return s
            case "demojize":
                return K.demojize(s, regions=self.tables.regions) if parameter is None or self.emoji_style == "cldr" else s
            case "transliterate":
                return self._romanize(parameter)(s)
            case "transliterate_if_lang":
                return self._romanize(parameter)(s) if self.lang else s
            case "transliterate_non_latin":
                return self._non_latin(s, parameter)
            case "catalog_fixed_point":
                return self._catalog(s)
        raise ValueError(f"unknown step {name!r}")

    def run(self, steps: Steps, s: str) -> str:
        seen, of = set(s), s
        for name, parameter in steps:
            if of is not s:
                seen, of = set(s), s
            if name in IDLE and not any(map(IDLE[name], seen)):
                continue
            s = self.step(name, parameter, s)
        return s


def _in_ranges(*ranges):
    """A cached test of single characters."""
    return lru_cache(maxsize=8192)(lambda c: any(a <= ord(c) <= b for a, b in ranges))


_one_of = lambda chars: frozenset(chars).__contains__
#: Steps that do nothing to a text without such a character: tested on the distinct characters of the text.
IDLE = {
    "strip_bidi": _one_of(S.BIDI), "strip_zero_width": _one_of(S.ZERO_WIDTH), "strip_control": _in_ranges((0, 8), (0x0E, 0x1B), (0x7F, 0x84), (0x86, 0x9F)),
    "strip_invisible": _in_ranges((ord(S.GRAPHEME_JOINER),) * 2, S.TAG_RANGE, *S.SELECTOR_RANGES, *S.NONCHARACTER_RANGES, *S.PRIVATE_RANGES),
}


def preset(name: str, tables: Tables, **options):
    """A preset as a function on ``str``."""
    name = ALIASES.get(name, name)
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(PRESETS)}")
    if "emoji" in options:
        options["emoji_style"] = options.pop("emoji")
    if options.get("emoji_style", "cldr") not in ("cldr", "none"):
        raise ValueError("emoji_style must be cldr or none")
    if "fold_case" in options:
        options["fold"] = options.pop("fold_case")
    runner = Runner(tables, **options)
    steps = PRESETS[name]
    return lambda s: runner.run(steps, s)


#: The order in which a pipeline's steps always run.
ORDER = ("normalize", "strip_zalgo", "strip_bidi", "demojize", "strip_accents", "transliterate", "confusables", "fold_case", "strip_control", "strip_zero_width", "collapse_whitespace")


class Pipeline:
    """Steps chosen by keyword, run in ``ORDER`` whatever the order of the keywords.

    ``strip_control`` and ``strip_zero_width`` follow ``collapse_whitespace`` unless given.
    """

    def __init__(self, normalize: str | None = None, transliterate: bool = False, lang: str | None = None, strict_iso9: bool = False, gost7034: bool = False, confusables: str | None = None,
                 strip_accents: bool = False, fold_case: bool = False, collapse_whitespace: bool = False, strip_control: bool | None = None, strip_zero_width: bool | None = None, demojize: bool = False,
                 strip_bidi: bool = False, strip_zalgo: int | bool | None = None):
        if normalize not in (None, "NFC", "NFD", "NFKC", "NFKD"):
            raise ValueError(f"unknown normalization form {normalize!r}")
        if strict_iso9 and gost7034:
            raise ValueError("strict_iso9 and gost7034 exclude each other")
        marks = 2 if strip_zalgo is True else None if strip_zalgo is False else strip_zalgo
        chosen = {
            "normalize": normalize, "strip_zalgo": marks, "strip_bidi": strip_bidi or None, "demojize": demojize or None, "strip_accents": strip_accents or None,
            "transliterate": "ignore" if transliterate or lang or strict_iso9 or gost7034 else None, "confusables": "latin" if confusables is True else confusables or None, "fold_case": fold_case or None,
            "strip_control": (collapse_whitespace if strip_control is None else strip_control) or None,
            "strip_zero_width": (collapse_whitespace if strip_zero_width is None else strip_zero_width) or None, "collapse_whitespace": collapse_whitespace or None,
        }
        self.steps: Steps = tuple((name, None if chosen[name] is True else chosen[name]) for name in ORDER if chosen[name] is not None)
        self.lang, self.strict_iso9, self.gost7034 = lang, strict_iso9, gost7034

    def kernel(self, tables: Tables):
        runner = Runner(tables, lang=self.lang, strict_iso9=self.strict_iso9, gost7034=self.gost7034)
        return lambda s: runner.run(self.steps, s)

    def explain(self) -> str:
        return " -> ".join(name if parameter is None else f"{name}({parameter})" for name, parameter in self.steps) or "(nothing)"

    def __repr__(self) -> str:
        return f"Pipeline[{self.explain()}]"


# Named profiles.
_COMMON = {"normalize": "NFKC", "collapse_whitespace": True}
PROFILES = {
    "library_catalog_key_eu": _COMMON | {"transliterate": True, "confusables": "latin", "strip_accents": True, "fold_case": True},
    "llm_guardrail": _COMMON | {"strip_zalgo": 0, "strip_bidi": True, "strip_zero_width": True, "strip_control": True, "demojize": True, "confusables": "latin", "strip_accents": True, "fold_case": True},
    "ml_corpus_normalize": _COMMON | {"demojize": True, "strip_accents": True, "fold_case": True},
    "normalize_web_input": _COMMON | {"confusables": "latin"},
    "rag_ingest": _COMMON | {"strip_bidi": True, "strip_control": True, "strip_zero_width": True, "transliterate": True, "strip_accents": True},
    "scholarly_cyrillic_iso9": _COMMON | {"transliterate": True, "strict_iso9": True, "fold_case": True},
    "search_index": _COMMON | {"transliterate": True, "strip_accents": True, "fold_case": True},
}


def list_profiles() -> list[str]:
    return sorted(PROFILES)


def get_pipeline(profile: str) -> Pipeline:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; there are {', '.join(list_profiles())}")
    return Pipeline(**PROFILES[profile])


