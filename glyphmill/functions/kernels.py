"""Scanners over one string that the JVM's built-in functions cannot express.

Plain functions on ``str``: equal in batch, streaming and SQL, and testable without Spark. The step
functions mirror ``native`` so that a pipeline with one scanner in it crosses to Python once.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

from . import charsets as S
from .errors import InvalidArgumentError, ResourceLimitError, UnsupportedError
from .tables import CONTRACTIONS, Tables, compose, map_chars

MARKS = regex.compile(r"\p{M}+")
_is_mark = lru_cache(maxsize=4096)(lambda c: unicodedata.category(c)[0] == "M")
_span = lambda ranges: "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)
_ANY_SPACE = re.escape(S.FOLD_SPACE + S.BLANK_LETTERS)
# Only what changes: a run that begins with another space than U+0020, or is longer than one.
_SPACE = re.compile(f"[{re.escape((S.FOLD_SPACE + S.BLANK_LETTERS).replace(' ', ''))}][{_ANY_SPACE}]*| [{_ANY_SPACE}]+")
_CONTROL = re.compile("[" + _span(S.merged({c for c in (*range(32), *range(127, 160)) if chr(c) not in S.FOLD_SPACE})) + "]+")
_ZERO, _BIDI = frozenset(S.ZERO_WIDTH), frozenset(S.BIDI)
_TAGS = re.compile(f"({'|'.join(S.FLAGS)})|[{_span([S.TAG_RANGE])}]")
_NONCHARACTERS = re.compile(f"[{S.GRAPHEME_JOINER}{_span(S.NONCHARACTER_RANGES)}]+")
_HIDDEN = re.compile(f"[{_span(S.SELECTOR_RANGES + S.PRIVATE_RANGES)}]+")
_SELECTORS = re.compile(f"[{_span([(0xFE00, 0xFE0D), (0xE0100, 0xE01EF)])}]+")


def nfc(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFC", s)


def nfkc(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFKC", s)


def strip_accents(s: str) -> str:
    if s.isascii():
        return s
    apart = unicodedata.normalize("NFD", s)
    for c in filter(_is_mark, set(apart)):
        apart = apart.replace(c, "")
    return unicodedata.normalize("NFC", apart)


def _without(s: str, chars: frozenset[str]) -> str:
    for c in chars.intersection(s):
        s = s.replace(c, "")
    return s


def strip_bidi(s: str) -> str:
    return s if s.isascii() else _without(s, _BIDI)


def strip_zero_width(s: str) -> str:
    return s if s.isascii() else _without(s, _ZERO)


def strip_control(s: str) -> str:
    return _CONTROL.sub("", s)


def collapse_whitespace(s: str) -> str:
    return _SPACE.sub(" ", s).strip(" ")


def strip_invisible(s: str) -> str:
    """The comparison policy: tags, joiner, noncharacters, private use and selectors off."""
    return s if s.isascii() else _HIDDEN.sub("", _NONCHARACTERS.sub("", _TAGS.sub(lambda m: m[1] or "", s)))


@lru_cache(maxsize=8192)
def _marks_of(c: str) -> int:
    return sum(map(_is_mark, unicodedata.normalize("NFD", c)))


def strip_zalgo(s: str, max_marks: int = 2) -> str:
    if s.isascii():
        return s
    if max_marks == 0:
        return strip_accents(s)
    if unicodedata.is_normalized("NFC", s) and all(_marks_of(c) <= max_marks and not _is_mark(c) for c in set(s)):
        return s
    return unicodedata.normalize("NFC", MARKS.sub(lambda m: m[0][:max_marks], unicodedata.normalize("NFD", s)))


def is_zalgo(s: str, threshold: int = 3) -> bool:
    return not s.isascii() and any(len(m) > threshold for m in MARKS.findall(unicodedata.normalize("NFD", s)))


# Confusables


def fold_confusables(s: str, table: dict[int, str], rounds: int = 8) -> str:
    """Compose, map, and again until nothing changes."""
    for _ in range(rounds):
        new = map_chars(compose(s, table), table)
        if new == s:
            break
        s = new
    return s


def is_confusable(s: str, table: dict[int, str]) -> bool:
    return any(ord(c) in table for c in compose(s, table))


def unmapped_confusables(tables: Tables, target: str = "latin") -> list[str]:
    return [chr(c) for c in sorted(tables.upstream - tables.confusables(target).keys())]


def find_unmapped(s: str, missing: frozenset[int]) -> list[tuple[str, int]]:
    found, at = [], 0
    for c in s:
        if ord(c) in missing:
            found.append((c, at))
        at += len(c.encode())
    return found


_CONTRACTION = re.compile("|".join(sorted(CONTRACTIONS, key=len, reverse=True)))


def contract(s: str) -> str:
    return _CONTRACTION.sub(lambda m: CONTRACTIONS[m[0]], s)


# Scripts


def detect_scripts(s: str) -> list[str]:
    return [x for x in dict.fromkeys(map(S.script_of, s)) if x not in ("Common", "Inherited")]


def has_bidi_conflict(s: str) -> bool:
    scripts = {S.script_of(c) for c in s if not c.isnumeric()} - {"Common", "Inherited"}
    return bool(scripts & set(S.RTL)) and bool(scripts - set(S.RTL))


# Emoji. Names that differ from the lower-cased Unicode name.
EMOJI_NAMES = {
    "\U0001F44D": "thumbs up", "\U0001F44E": "thumbs down", "❤": "red heart", "☕": "hot beverage", "\U0001F602": "face with tears of joy", "\U0001F680": "rocket", "\U0001F4A9": "pile of poo",
    "☀": "sun", "☁": "cloud", "☂": "umbrella", "☎": "telephone", "✔": "check mark", "✖": "multiply", "\U0001F389": "party popper", "\U0001F4AF": "hundred points",
    "\U0001F355": "pizza", "\U0001F30D": "globe showing Europe-Africa", "\U0001F30E": "globe showing Americas", "\U0001F30F": "globe showing Asia-Australia", "✅": "check mark button", "❌": "cross mark",
}
SKIN = {"\U0001F3FB": "light skin tone", "\U0001F3FC": "medium-light skin tone", "\U0001F3FD": "medium skin tone", "\U0001F3FE": "medium-dark skin tone", "\U0001F3FF": "dark skin tone"}
# Names of families and pairs by their members.
_EMOJI_MODIFIER = re.compile("[\u200D\uFE0E\uFE0F\U0001F3FB-\U0001F3FF\U000E0020-\U000E007F⃣]*")
MAX_SEQUENCE = 9


def _is_emoji(cp: int) -> bool:
    return 0x2600 <= cp <= 0x27BF or 0x2B50 <= cp <= 0x2B55 or 0xFE00 <= cp <= 0xFE0F or 0x1F000 <= cp <= 0x1FAFF or 0x1FC00 <= cp <= 0x1FFFF or 0xE0020 <= cp <= 0xE007F


@lru_cache(maxsize=8192)
def _emoji_like(c: str) -> bool:
    """Whether a character can make ``demojize`` do anything."""
    return not c.isascii() and (c in "\u200D\uFE0E\uFE0F\u20E3" or _is_emoji(ord(c)) or emoji_name(c) is not None)


@lru_cache(maxsize=8192)
def emoji_name(ch: str) -> str | None:
    if ch in EMOJI_NAMES:
        return EMOJI_NAMES[ch]
    if not regex.fullmatch(r"\p{Emoji}", ch) or ch.isascii():
        return None
    name = unicodedata.name(ch, "").lower()
    return name.removeprefix("emoji modifier ").replace("heavy ", "").strip() or None


def _sequence(s: str, i: int, regions: dict[str, str] | None = None) -> tuple[str, int] | None:
    """(name, length) of an emoji sequence at a place: flags, keycaps, skin tones and joined emoji."""
    ch = s[i]
    if "\U0001F1E6" <= ch <= "\U0001F1FF" and i + 1 < len(s) and "\U0001F1E6" <= s[i + 1] <= "\U0001F1FF":
        code = "".join(chr(ord(c) - 0x1F1E6 + 65) for c in s[i : i + 2])
        return "flag: " + (regions or {}).get(code, code), 2
    if ch in "0123456789#*":
        m = re.compile("\uFE0F?⃣").match(s, i + 1)
        return (f"keycap: {ch}", 1 + len(m[0])) if m else None
    for flag, name in zip(S.FLAGS, ("England", "Scotland", "Wales"), strict=True):
        if s.startswith(flag, i):
            return f"flag: {name}", len(flag)
    if ch.isascii() or emoji_name(ch) is None:
        return None
    parts, tones, k = [emoji_name(ch)], [], i + 1
    while k < len(s) and k - i < MAX_SEQUENCE:
        if s[k] in SKIN:
            tones.append(SKIN[s[k]])
            k += 1
        elif s[k] in "\uFE0E\uFE0F":
            k += 1
        elif s[k] == "\u200D" and k + 1 < len(s) and emoji_name(s[k + 1]) and not s[k + 1].isascii():
            parts.append(emoji_name(s[k + 1]))
            k += 2
        else:
            break
    if len(parts) == 1 and not tones:
        return parts[0], k - i
    return ", ".join(parts) + (": " + ", ".join(tones) if tones else ""), k - i


def demojize(s: str, strip_modifiers: bool = False, errors: str = "ignore", replace_with: str = "[?]", provider=None, regions: dict[str, str] | None = None) -> str:
    """Emoji become their names, set apart by spaces; unknown ones are dropped, replaced, kept or refused.

    ``provider(list of code points)`` may name a sequence itself; what it raises or returns that is
    no string falls back to the built-in names. ``regions`` names the countries of flags (else: their codes).
    """
    if errors not in ("ignore", "replace", "preserve", "strict"):
        raise InvalidArgumentError(f"unknown errors mode {errors!r}")
    if s.isascii() or (provider is None and not any(map(_emoji_like, set(s)))):
        return s
    seen = set(s)
    telling = "".join(sorted(c for c in seen if not c.isascii() and (provider or _emoji_like(c))))
    place = _places(telling, "\u20E3" in seen)
    out: list[str] = []
    i, after_emoji = 0, False
    while i < len(s):
        m = place.search(s, i)
        if m is None or m.start() > i:  # what is no emoji is copied whole
            plain = s[i : m.start()] if m else s[i:]
            if after_emoji and plain[0].isalnum():
                out.append(" ")
            out.append(plain)
            after_emoji, i = False, i + len(plain)
            continue
        ch = s[i]
        if ch in "\u200D\uFE0E\uFE0F":
            i += 1
            continue
        if hit := _provided(s, i, provider) or _sequence(s, i, regions):
            name, n = hit
            if out and not out[-1][-1:].isspace():
                out.append(" ")
            out.append(name.split(": ")[0] if strip_modifiers else name)
            i, after_emoji = _EMOJI_MODIFIER.match(s, i + n).end(), True
        elif _is_emoji(ord(ch)):
            if errors == "strict":
                raise InvalidArgumentError(f"no name of emoji U+{ord(ch):04X}")
            if errors != "ignore":
                out.append(replace_with if errors == "replace" else ch)
            i, after_emoji = _EMOJI_MODIFIER.match(s, i + 1).end(), False
        else:
            if after_emoji and ch.isalnum():
                out.append(" ")
            out.append(ch)
            i, after_emoji = i + 1, False
    return "".join(out)


@lru_cache(maxsize=1024)
def _places(chars: str, keycaps: bool) -> re.Pattern:
    """Where an emoji may begin: at one of the characters, or at a keycap."""
    parts = ([f"[{re.escape(chars)}]"] if chars else []) + (["[0-9#*](?=\uFE0F?\u20E3)"] if keycaps else [])
    return re.compile("|".join(parts) or r"(?!)")


def _provided(s: str, i: int, provider) -> tuple[str, int] | None:
    """What a provider makes of the longest window at a place; a failure is no answer."""
    if provider is None or s[i].isascii():
        return None
    for n in range(min(MAX_SEQUENCE, len(s) - i), 0, -1):
        try:
            name = provider([ord(c) for c in s[i : i + n]])
        except Exception:  # noqa: BLE001
            continue
        if isinstance(name, str):
            return name, n
    return None


# Width. East Asian width of Unicode 15.1, by rule.


@lru_cache(maxsize=8192)
def _width_class(ch: str) -> str:
    """Z zero, W wide, A ambiguous, N one."""
    cp, cat = ord(ch), unicodedata.category(ch)
    if cat in ("Cc", "Mn", "Me") or (cat == "Cf" and cp != 0xAD) or cp == 0xAD or 0x1160 <= cp <= 0x11FF or 0xD7B0 <= cp <= 0xD7FB or cat in ("Zl", "Zp"):
        return "Z"
    return {"W": "W", "F": "W", "A": "A"}.get(unicodedata.east_asian_width(ch), "N")


_PRESENTED = regex.compile(r"\p{Emoji_Presentation}")


def grapheme_width(cluster: str, ambiguous_wide: bool = False) -> int:
    if not cluster:
        return 0
    base, rest = cluster[0], cluster[1:]
    kind = _width_class(base)
    plain = {"Z": 0, "W": 2, "A": 1 + ambiguous_wide, "N": 1}[kind]
    emoji = not base.isascii() and (bool(_PRESENTED.match(base)) or "\U0001F1E6" <= base <= "\U0001F1FF")
    if kind == "Z" and not emoji:
        return 0
    if "\uFE0E" in rest:
        return 1 if emoji else plain
    if "\uFE0F" in rest or emoji or ("⃣" in rest and base in "0123456789#*"):
        return 2
    return plain


_CLUSTER = regex.compile(r"\X")
#: Ranges whose characters are a cluster each, whatever is beside them (but for CR LF, both of no width).
_ALONE = ((0x00, 0xAC), (0xAE, 0x2FF), (0x370, 0x482), (0x48A, 0x58F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF))


@lru_cache(maxsize=8192)
def _stands_alone(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in _ALONE) and not _PRESENTED.match(c)



def graphemes(s: str) -> list[str]:
    return _CLUSTER.findall(s)


def terminal_width(s: str, ambiguous_wide: bool = False) -> int:
    seen = set(s)
    if all(map(_stands_alone, seen)):
        return len(s) + sum(s.count(c) * (grapheme_width(c, ambiguous_wide) - 1) for c in seen if not " " <= c <= "~")
    return sum(grapheme_width(c, ambiguous_wide) for c in graphemes(s))


# Slugs and file names


def _cut_bytes(s: str, n: int) -> str:
    return s.encode()[:n].decode(errors="ignore")


_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_ENTITY = re.compile(r"&(?:#([0-9]{1,10});?|#[xX]([0-9A-Fa-f]{1,10});?|(amp|lt|gt|quot|apos|nbsp);)")


def decode_entities(s: str, decimal: bool = True, hexadecimal: bool = True) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            return _NAMED[m[3]]
        if (m[1] and not decimal) or (m[2] and not hexadecimal):
            return m[0]
        cp = int(m[1]) if m[1] else int(m[2], 16)
        if cp > 0x10FFFF or 0xD800 <= cp < 0xE000 or unicodedata.category(chr(cp)) == "Cc":
            return ""
        return chr(cp)

    return _ENTITY.sub(one, s)


class Slugger:
    """``slugify`` with fixed options. ``romanize``: a function for texts that are not kept as they are."""

    MAX_PATTERN_BYTES = 512

    def __init__(self, romanize, separator: str = "-", lowercase: bool = True, max_length: int = 0, word_boundary: bool = False, save_order: bool = False, stopwords=(), regex_pattern: str | None = None,
                 replacements=(), allow_unicode: bool = False, entities: bool = True, decimal: bool = True, hexadecimal: bool = True, default: str | None = None, safe_chars: str = ""):
        if regex_pattern and len(regex_pattern.encode()) > self.MAX_PATTERN_BYTES:
            raise ResourceLimitError(f"regex_pattern is longer than {self.MAX_PATTERN_BYTES} bytes")
        if max_length < 0:
            raise InvalidArgumentError("max_length must be at least 0")
        self.romanize, self.separator, self.lowercase, self.max_length = romanize, separator, lowercase, max_length
        self.word_boundary, self.save_order, self.stopwords = word_boundary, save_order, frozenset(stopwords)
        self.pattern = re.compile(regex_pattern) if regex_pattern else None
        self.replacements = dict(reversed(list(replacements)))  # of equal keys the first counts
        self.keys = re.compile("|".join(re.escape(k) for k, _ in replacements if k)) if any(k for k, _ in replacements) else None
        self.allow_unicode, self.entities, self.decimal, self.hexadecimal = allow_unicode, entities, decimal, hexadecimal
        self.default, self.safe = default, frozenset(safe_chars)
        self.words = re.compile(f"[0-9A-Za-z{re.escape(''.join(c for c in safe_chars if c.isascii()))}]+")

    def _keeps(self, ch: str) -> bool:
        return ch.isalnum() or (self.allow_unicode and not ch.isascii() and not ch.isspace()) or ch in self.safe

    def _slug(self, s: str) -> str:
        if not s:
            return ""
        if self.keys:
            s = self.keys.sub(lambda m: self.replacements[m[0]], s)
        if self.entities:
            s = decode_entities(s, self.decimal, self.hexadecimal)
        s = nfc(s) if self.allow_unicode else self.romanize(s)
        if self.lowercase:
            s = s.lower()
        if self.pattern:
            s = self.pattern.sub("", s)
        if s.isascii():
            parts = self.words.findall(s)
        else:
            parts = [w for w in "".join(c if self._keeps(c) else "\0" for c in s).split("\0") if w]
        if self.stopwords:
            if self.save_order:
                while parts and parts[0] in self.stopwords:
                    parts.pop(0)
                while parts and parts[-1] in self.stopwords:
                    parts.pop()
            else:
                parts = [w for w in parts if w not in self.stopwords]
        slug = self.separator.join(parts)
        if self.max_length and len(slug.encode()) > self.max_length:
            slug = _cut_bytes(slug, self.max_length)
            if self.word_boundary and self.separator and self.separator in slug:
                slug = slug.rpartition(self.separator)[0]
            elif self.separator:
                slug = slug.removesuffix(self.separator)
        return slug

    def __call__(self, s: str) -> str:
        slug = self._slug(s)
        return slug if slug or not self.default else self._slug(self.default)


class UniqueSlugger:
    """Slugs in order of the calls, each made unique by ``-1``, ``-2`` and so on; ``check(slug)`` true means taken elsewhere."""

    MAX_ATTEMPTS = 10_000

    def __init__(self, slug: Slugger, check=None):
        self.slug, self.check = slug, check
        self.reset()

    def reset(self) -> None:
        self.seen: set[str] = set()
        self.next: dict[str, int] = {}

    def _taken(self, candidate: str) -> bool:
        return candidate in self.seen or bool(self.check and self.check(candidate))

    def __call__(self, s: str) -> str:
        base = self.slug(s)
        candidate = base
        first = self.next.get(base, 1)
        for n in range(first, first + self.MAX_ATTEMPTS):
            if not self._taken(candidate):
                break
            suffix = f"{self.slug.separator}{n}"
            room = self.slug.max_length
            stem = _cut_bytes(base, room - len(suffix)) if room and len((base + suffix).encode()) > room else base
            candidate = stem + suffix
            self.next[base] = n
        else:
            raise ResourceLimitError(f"no free slug for {base!r} after {self.MAX_ATTEMPTS} attempts")
        self.seen.add(candidate)
        return candidate


PLATFORMS = {"universal": '/\\:*?"<>|\0', "windows": '/\\:*?"<>|\0', "posix": "/\0"}
_ILLEGAL = {k: re.compile(rf"[\s\x00-\x1f\x7f-\x9f{re.escape(v)}]+") for k, v in PLATFORMS.items()}
# Device names that Windows reserves.
RESERVED = frozenset("CON PRN AUX NUL COM0 COM1 COM2 COM3 COM4 COM5 COM6 COM7 COM8 COM9 LPT0 LPT1 LPT2 LPT3 LPT4 LPT5 LPT6 LPT7 LPT8 LPT9 CLOCK$ KEYBD$ SCREEN$".split())


def sanitize_filename(s: str, romanize, separator: str = "_", max_length: int = 255, platform: str = "universal", preserve_extension: bool = True, default: str = "_") -> str:
    """A name that is safe on the platform: no reserved device name, no trailing dots, ``default`` where nothing is left; a fixed point."""
    if platform not in PLATFORMS:
        raise InvalidArgumentError(f"platform must be one of {', '.join(PLATFORMS)}; got {platform!r}")
    illegal = _ILLEGAL[platform]
    dots = lambda x: re.sub(r"\.{2,}", ".", x)
    name = dots(romanize(dots(nfc(s)))).rstrip(". ")
    at = name.rfind(".") if preserve_extension else -1
    stem, ext = (name[:at], name[at:]) if at > 0 else (name, "")
    stem = separator.join(p for p in illegal.split(stem) if p)
    while separator and stem.endswith(separator):
        stem = stem.removesuffix(separator)
    stem = stem.strip(". ")
    if ext:
        ext = "." + illegal.sub("", ext[1:])

    def limited(name: str) -> str:
        if not max_length or len(name.encode()) <= max_length:
            return name
        room = max_length - len(ext.encode())
        return _cut_bytes(name, room) + ext if ext and room > 0 else _cut_bytes(name, max_length)

    guarded = platform != "posix"
    out = limited(("_" if guarded and stem.upper() in RESERVED else "") + stem + ext)
    if guarded and out.split(".")[0].upper() in RESERVED:
        out = limited("_" + out)
    return out.strip(". ") or default


# Bytes

CONFIDENCE = 0.95


def detect_encoding(data: bytes) -> tuple[str, float]:
    """A guess at the encoding: byte order mark, ASCII and valid UTF-8 are certain in kind, the rest is a heuristic."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if data.startswith(mark):
            return name, CONFIDENCE
    try:
        data.decode("utf-8")
        return "UTF-8", CONFIDENCE
    except UnicodeDecodeError:
        pass
    best = ("windows-1252", -1.0)
    for name, codec, letters in (("Shift_JIS", "cp932", r"[\p{Hiragana}\p{Katakana}\p{Han}]"), ("EUC-JP", "euc_jp", r"[\p{Hiragana}\p{Katakana}\p{Han}]"), ("EUC-KR", "cp949", r"\p{Hangul}"), ("GBK", "gbk", r"\p{Han}"), ("Big5", "big5", r"\p{Han}"), ("windows-1251", "cp1251", r"[а-яА-ЯёЁ]"), ("KOI8-R", "koi8_r", r"[а-яё]"), ("windows-1253", "cp1253", r"[α-ωΑ-Ωά-ώ]"), ("windows-1252", "cp1252", r"[à-öø-ÿÀ-Ö ]")):
        try:
            text = data.decode(codec)
        except (UnicodeDecodeError, LookupError):
            continue
        odd = [c for c in text if not c.isascii()]
        share = len(regex.findall(letters, "".join(odd))) / max(1, len(odd))
        lower = sum(c.islower() for c in odd) / max(1, len(odd))
        value = share + 0.2 * lower
        if value > best[1] + 1e-9:
            best = (name, value)
    return best[0], CONFIDENCE


_LABELS = {"latin1": "cp1252", "iso-8859-1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "shift_jis": "cp932", "sjis": "cp932", "euc-kr": "cp949", "gb2312": "gb18030", "gbk": "gb18030"}


def decode_to_utf8(data: bytes, encoding: str | None = None, min_confidence: float = 0.0, strict: bool = False) -> tuple[str, bool]:
    """(text, had errors) of bytes in a WHATWG-labelled or detected encoding; a byte order mark wins."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            data, encoding = data[len(mark) :], codec
            break
    if encoding is None:
        encoding, confidence = detect_encoding(data)
        if confidence < min_confidence:
            raise InvalidArgumentError(f"detected {encoding} with confidence {confidence}, less than {min_confidence}")
    label = encoding.strip().lower()
    try:
        text = data.decode(_LABELS.get(label, label), "strict")
        return text, False
    except UnicodeDecodeError:
        if strict:
            raise InvalidArgumentError(f"bytes are not valid {encoding}") from None
        return data.decode(_LABELS.get(label, label), "replace"), True
    except LookupError:
        raise UnsupportedError(f"unknown encoding {encoding!r}") from None


def scrub_surrogates(s: str) -> str:
    """Pairs of surrogates become characters, single ones U+FFFD: for strings that come in from Python."""
    return s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


