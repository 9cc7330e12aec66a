"""Romanisation: a scanner over one string, and the way back to native letters."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from . import charsets as S
from .errors import InvalidArgumentError, ResourceLimitError
from .tables import ALIASES, REVERSE, Tables, compose, hangul, map_chars

ERRORS = ("replace", "ignore", "preserve", "strict")
# Languages that are accepted; those without a table of their own use the default.
LANG_CODES = tuple(
    "am ar as ban bax bg bn bo bug ca chr cjm cop cs cy da de dv el en es et fa fi fr ga gu he hi hr hu hy is it iu ja ja-kunrei jv ka khb km kn ko lis lo lt lv ml mn mni mr mt my nb ne nl nn no nod nqo or pa pl pt ro ru sa sat si sk sl sq sr su sv syr ta tdd te th tl tr tzm uk vai vi zh".split()
)
# Consonants, dependent vowels and viramas of scripts whose consonants carry a vowel.
_INDIC = """
0D9A-0DC6 C|0DCF-0DDF V|0DF2-0DF3 V|0DCA X|0F40-0F69 C|0F90-0FBC C|0F71-0F7D V|0F84 X|1000-1021 C|102B-1035 V|103B-103E V|1039-103A X
1780-17A2 C|17B6-17C5 V|17D2 X|1B13-1B33 C|1B35-1B43 V|1B44 X|A990-A9B2 C|A9B4-A9BC V|A9C0 X|1B8A-1BA0 C|1BA1-1BA9 V|1BAB X
1A20-1A54 C|1A55-1A5E V|1A61-1A72 V|1A60 X|AA00-AA28 C|AA29-AA36 V|AA4D X|1BC0-1BE3 C|1BE7-1BEE V|1BF2-1BF3 X|1A00-1A16 C|1A17-1A1B V
1703-1711 C|171F C|1712-1713 V|1714 X|1723-1731 C|1732-1733 V|1734 X|1743-1751 C|1752 V|1753 X|1763-1770 C|1772 V|1773 X|ABC0-ABE2 C|ABE3-ABEA V|ABED X
"""


def _roles() -> dict[str, str]:
    out = {}
    for block in range(0x0900, 0x0D80, 0x80):  # the core blocks share one layout
        for low, high, role in ((0x15, 0x39, "C"), (0x58, 0x5F, "C"), (0x3E, 0x4C, "V"), (0x4D, 0x4D, "X")):
            out |= {chr(block + k): role for k in range(low, high + 1)}
    for item in _INDIC.replace("\n", "|").split("|"):
        if item:
            span, role = item.split(" ")
            low, _, high = span.partition("-")
            out |= {chr(c): role for c in range(int(low, 16), int(high or low, 16) + 1)}
    return out


ROLES = _roles()


def _class(ch: str) -> str:
    """I ideograph, H Hangul, K kana, L Latin letter or digit, N Indic, O other."""
    cp = ord(ch)
    if cp < 0x80:
        return "L" if ch.isalnum() else "O"
    if 0x4E00 <= cp <= 0x9FFF or 0x3400 <= cp <= 0x4DBF or 0xF900 <= cp <= 0xFAFF:
        return "I"
    if 0xAC00 <= cp <= 0xD7A3 or 0x3131 <= cp <= 0x3163:
        return "H"
    if 0x3040 <= cp <= 0x30FF or 0x31F0 <= cp <= 0x31FF:
        return "K"
    if ch in ROLES:
        return "N"
    return "L" if S.script_of(ch) == "Latin" else "O"


@lru_cache(maxsize=8192)
def _simple(ch: str) -> bool:
    """Neither spaced nor joined by the scanner."""
    return _class(ch) in "LO"


class Untranslatable(ValueError):
    def __init__(self, ch: str, byte_offset: int):
        super().__init__(f"no romanisation of {ch!r} (U+{ord(ch):04X}) at byte {byte_offset}")
        self.ch, self.byte_offset = ch, byte_offset


@dataclass(frozen=True)
class Context:
    """Registered languages and replacements: immutable, each change makes a new one."""

    languages: dict[str, dict[int, str]] = field(default_factory=dict)
    replacements: dict[str, str] = field(default_factory=dict)
    sealed: bool = False

    MAX_LANGUAGES, MAX_REPLACEMENTS, MAX_OUTPUT = 100, 10_000, 10 << 20

    def _open(self) -> None:
        if self.sealed:
            raise RuntimeError("registrations are sealed")

    def register_lang(self, code: str, mapping: dict[str, str]) -> Context:
        self._open()
        if any(len(k) != 1 for k in mapping):
            raise InvalidArgumentError("keys must be single characters")
        new = self.languages | {code: {ord(k): v for k, v in mapping.items()}}
        if len(new) > self.MAX_LANGUAGES:
            raise ResourceLimitError(f"no more than {self.MAX_LANGUAGES} languages can be registered")
        return Context(new, self.replacements)

    def register_replacements(self, mapping: dict[str, str]) -> Context:
        self._open()
        if "" in mapping:
            raise InvalidArgumentError("a replacement needs a key")
        new = self.replacements | mapping
        if len(new) > self.MAX_REPLACEMENTS:
            raise ResourceLimitError(f"no more than {self.MAX_REPLACEMENTS} replacements can be registered")
        return Context(self.languages, new)

    def remove_replacement(self, key: str) -> Context:
        self._open()
        return Context(self.languages, {k: v for k, v in self.replacements.items() if k != key})

    def clear_replacements(self) -> Context:
        self._open()
        return Context(self.languages, {})

    def seal(self) -> Context:
        return Context(self.languages, self.replacements, True)

    def replace(self, s: str) -> str:
        """Leftmost-longest replacement of the registered keys."""
        if not self.replacements:
            return s
        keys = re.compile("|".join(map(re.escape, sorted(self.replacements, key=len, reverse=True))))
        out = keys.sub(lambda m: self.replacements[m[0]], s)
        if len(out.encode()) > self.MAX_OUTPUT:
            raise ResourceLimitError("replacement output is larger than 10 MiB")
        return out


def check_lang(lang: str | None, context: Context | None = None) -> None:
    if lang is None or lang == "auto" or lang in LANG_CODES or (context and lang in context.languages):
        return
    near = closest_match(lang, LANG_CODES)
    raise InvalidArgumentError(f"unknown language {lang!r}" + (f"; did you mean {near!r}?" if near else ""))


def closest_match(word: str, choices) -> str | None:
    """The choice within two edits of a word, nearest first."""

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    best = min(((edits(word, c), c) for c in choices), default=(3, None))
    return best[1] if best[0] <= 2 else None


class Romanizer:
    """``transliterate`` with its options fixed and its tables merged once."""

    def __init__(self, tables: Tables, lang: str | None = None, errors: str = "replace", replace_with: str = "[?]", strict_iso9: bool = False, gost7034: bool = False, tones: bool = False, context: Context | None = None):
        if errors not in ERRORS:
            raise InvalidArgumentError(f"errors must be one of {', '.join(ERRORS)}; got {errors!r}")
        if strict_iso9 and gost7034:
            raise InvalidArgumentError("strict_iso9 and gost7034 exclude each other")
        check_lang(lang, context)
        self.tables, self.lang, self.errors, self.replace_with, self.tones = tables, lang, errors, replace_with, tones
        self.strict_iso9, self.gost7034 = strict_iso9, gost7034
        self.context = context or Context()
        # Only registered languages map ASCII.
        self._maps_ascii = any(k < 0x80 for k in self.context.languages.get(lang, ()))
        self._merged: dict[str | None, dict[int, str]] = {}

    def _table(self, lang: str | None) -> dict[int, str]:
        if lang not in self._merged:
            t = self.tables
            over: dict[int, str] = {}
            if self.strict_iso9 or self.gost7034:
                over = t.iso9 if self.strict_iso9 else t.gost
            elif lang:
                over = t.languages.get(ALIASES.get(lang, lang)) or self.context.languages.get(lang, {})
            self._merged[lang] = t.default | (t.toned if self.tones else {}) | over
        return self._merged[lang]

    def _one(self, table: dict[int, str], ch: str) -> str | None:
        cp = ord(ch)
        if cp in table:
            return table[cp]
        if 0xAC00 <= cp <= 0xD7A3:
            return hangul(ch)
        plain = unicodedata.normalize("NFKC", ch)
        if plain != ch:
            parts = [p if p.isascii() else self._one(table, p) if p != ch else None for p in plain]
            if all(p is not None for p in parts):
                return "".join(parts)
        return None

    def scan(self, s: str, unknown) -> str:
        """Romanise; ``unknown(ch, index)`` gives what stands for a character without a romanisation."""
        lang = resolve_auto_lang(s) if self.lang == "auto" else self.lang
        table, out, before, last = self._table(lang), [], "", ""
        if all(c < "\x80" or (_simple(c) and table.get(ord(c))) for c in set(s)):
            return map_chars(s, table)  # no character depends on those beside it
        for i, ch in enumerate(s):
            now = _class(ch)
            spaced = last.isalnum() and (
                (now in "IH" and before in "IKHLON" and before) or (now == "K" and before in "IHLON" and before) or (now == "L" and ch < "\x80" and before in "IH" and before)
            )
            if ch < "\x80":
                value = table.get(ord(ch), ch)
            else:
                value = self._one(table, ch)
                role = ROLES.get(ch)
                if role in ("V", "X") and before == "N" and self._consonant and out and out[-1].endswith("a"):
                    out[-1] = out[-1][:-1]
                if value is None and role == "X":
                    value = ""
                if value is None:
                    value = unknown(ch, i)
                elif value == "" and self.errors == "preserve" and role != "X":
                    value = ch
            if spaced and value:
                out.append(" ")
            if value:
                out.append(value)
                last = value[-1]
            self._consonant = ROLES.get(ch) == "C"
            before = "O" if value == ch and ch > "\x7f" else now  # what stays as it is sets nothing apart
        return "".join(out)

    _consonant = False

    def __call__(self, s: str) -> str:
        s = self.context.replace(s)
        if s.isascii() and not self._maps_ascii:
            return s
        s = compose(s, self.tables.default)

        def unknown(ch: str, i: int) -> str:
            if self.errors == "strict":
                raise Untranslatable(ch, len(s[:i].encode()))
            return {"replace": self.replace_with, "ignore": "", "preserve": ch}[self.errors]

        return self.scan(s, unknown)

    def untranslatable(self, s: str) -> list[tuple[str, int]]:
        """(character, byte offset) of all characters without a romanisation."""
        found: list[tuple[str, int]] = []
        if not s.isascii():
            self.scan(s, lambda ch, i: found.append((ch, len(s[:i].encode()))) or "")
        return found


def reverse_langs() -> list[str]:
    return sorted(REVERSE)


class Reverser:
    """ASCII back to native letters: longest key first, a key in capitals gives a capital, the rest stays."""

    def __init__(self, lang: str):
        if lang not in REVERSE:
            raise InvalidArgumentError(f"target must be one of {', '.join(reverse_langs())}; got {lang!r}")
        self.keys = {}
        for pair in REVERSE[lang].split(" "):
            k = max(i for i, c in enumerate(pair) if c.isascii()) + 1
            self.keys[pair[:k]] = pair[k:]
        for key, native in list(self.keys.items()):
            if len(key) > 1:
                self.keys.setdefault(key.upper(), native.upper())
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.keys, key=len, reverse=True))))

    def __call__(self, s: str) -> str:
        return self.pattern.sub(lambda m: self.keys[m[0]], s)


# Languages by script, and letters that tell languages of one script apart.
SCRIPT_LANG = dict(
    x.split("=") for x in (
        "Thai=th Lao=lo Myanmar=my Khmer=km Georgian=ka Armenian=hy Tibetan=bo Ethiopic=am Bengali=bn Tamil=ta Telugu=te Kannada=kn Malayalam=ml Gujarati=gu Gurmukhi=pa Oriya=or Sinhala=si Hangul=ko "
        "Hebrew=he Arabic=ar Thaana=dv Javanese=jv Mongolian=mn Devanagari=hi Cyrillic=ru Han=zh Hiragana=ja Katakana=ja Greek=el Balinese=ban Bamum=bax Buginese=bug Cherokee=chr Cham=cjm Coptic=cop "
        "Lisu=lis MeeteiMayek=mni NKo=nqo NewTaiLue=khb OlChiki=sat Sundanese=su Syriac=syr TaiLe=tdd TaiTham=nod Tagalog=tl Tifinagh=tzm Vai=vai"
    ).split(" ")
)
TELLING = {
    "Cyrillic": {"uk": "ґҐїЇєЄіІ", "sr": "ђЂћЋљЉњЊџЏјЈ", "mn": "өӨүҮ"},
    "Arabic": {"fa": "پچژگ"},
    "Latin": {"vi": "ơƠưƯ", "tr": "İı", "de": "ßẞ"},
}
SCAN_LIMIT = 2000


def inspect_auto_lang(s: str) -> dict:
    """{script, lang, reason, discriminators} of what ``lang="auto"`` makes of a text."""
    script = None
    if any(S.script_of(c) not in ("Common", "Inherited", "Latin") for c in set(s)):
        script = next(x for x in map(S.script_of, s) if x not in ("Common", "Inherited", "Latin"))
    answer = {"script": script, "lang": None, "reason": "no_detection", "discriminators": []}
    if script is None and s.isascii():
        return answer
    among = TELLING.get(script or "Latin", {})
    told = {ch: lang for lang, letters in among.items() for ch in letters}
    hit = next((ch for ch in s[:SCAN_LIMIT] if ch in told), None)
    if hit:
        return answer | {"lang": told[hit], "reason": "discriminator" if script else "latin_discriminator", "discriminators": [hit]}
    if script is None:
        return answer
    return answer | {"lang": SCRIPT_LANG.get(script), "reason": "script_default" if among else "unambiguous_script"}


def resolve_auto_lang(s: str) -> str | None:
    return inspect_auto_lang(s)["lang"]
