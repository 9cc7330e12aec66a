"""Host names and anomalies: signals about a string, not verdicts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from . import kernels as K
from .charsets import CJK
from .tables import Tables

try:
    import idna
except ImportError:  # punycode without the checks of UTS 46
    idna = None


def _decode_label(label: str) -> str | None:
    """The Unicode form of an ``xn--`` label, null if it has none."""
    try:
        if idna is not None:
            return idna.decode(label, uts46=True)
        out = label[4:].encode("ascii").decode("punycode")
        return out if not out.isascii() else None
    except (UnicodeError, ValueError):
        return None


_IPV6 = re.compile(r"\[[0-9A-Fa-f:.%]*\]")


def analyze_hostname(host: str, tables: Tables, contractions: bool = False) -> dict:
    """What a host name's labels look like. ``suspicious``: a label mixes scripts, has a character confusable with a
    Latin one or does not decode, or the name mixes directions. ``whole_script_confusable`` and ``cross_label_script``
    are signals only and never set it."""
    latin = tables.confusables("latin")
    host = K.nfkc(host)
    answer = {
        "suspicious": False, "scripts": [], "mixed_script": False, "has_confusables": False, "bidi_conflict": False, "cross_label_script": False, "label_scripts": [],
        "whole_script_confusable": False, "label_whole_script_confusable": [], "canonical": host,
    }
    if _IPV6.fullmatch(host) and host.count(":") <= 7 and host.count("%") <= 1:
        return answer
    labels, failed = [], False
    for label in host.split("."):
        if label[:4].lower() == "xn--":
            decoded = _decode_label(label)
            failed |= decoded is None
            label = K.nfkc(decoded) if decoded is not None else label
        labels.append(label)
    scripts = [K.detect_scripts(x) for x in labels]
    whole = []
    for label, own in zip(labels, scripts, strict=True):
        skeleton = K.fold_confusables(label, latin)
        whole.append(len(own) == 1 and own != ["Latin"] and K.detect_scripts(skeleton) == ["Latin"])
    decoded = ".".join(labels)
    among = list(dict.fromkeys(s for own in scripts for s in own))
    mixed = any(len(own) > 1 for own in scripts)
    confusable = any(K.is_confusable(x, latin) for x in labels)
    conflict = K.has_bidi_conflict(decoded)
    canonical = K.fold_confusables(decoded, latin)
    if contractions:
        canonical = ".".join(map(K.contract, canonical.split(".")))
    return answer | {
        "suspicious": mixed or confusable or conflict or failed, "scripts": among, "mixed_script": mixed, "has_confusables": confusable, "bidi_conflict": conflict,
        "cross_label_script": len(among) > 1, "label_scripts": scripts, "whole_script_confusable": any(whole), "label_whole_script_confusable": whole, "canonical": canonical,
    }


# Fixed values of the anomaly rules.
INVISIBLE = "\u200B\u200C\u200D\u2060\u2061\u2062\u2063\uFEFF"
JOINERS = "\u200C\u200D"
OVERRIDES, ISOLATES = "\u202D\u202E", "\u2066\u2067\u2068\u2069"
WRAPPING = "\".,;:?!()[]{}<>«»“”‘’`—…' \t"
UNITS = frozenset("kω mω gω µf nf pf µm µs µg µa µv å ω °c °f".split())
LEET = str.maketrans("01!234@5$697+8|", "oiizeaassggttbl")
MAX_MARKS, MAX_LEET = 3, 64
SEPARATORS = "._-"
_ORDINAL = re.compile(r"[0-9]+(?:st|nd|rd|th|am|pm)", re.I)
_NUMBERED = re.compile(r"[A-Za-z]+[0-9@$|]+")
_SPLITS = re.compile("[._-]+")
_LEET_SIGN = re.compile(r"[0-9@$|!+]")


def _letters(s: str) -> list[str]:
    return [c for c in s if c.isalpha()]


def _near(word: str, lexicon: frozenset[str]) -> str | None:
    """A lexicon word one deletion, insertion or substitution away, deletions first, then by place and letter."""
    for i in range(len(word)):
        if (w := word[:i] + word[i + 1 :]) in lexicon:
            return w
    for i in range(len(word) + 1):
        for c in "abcdefghijklmnopqrstuvwxyz":
            if (w := word[:i] + c + word[i:]) in lexicon:
                return w
            if i < len(word) and (w := word[:i] + c + word[i + 1 :]) in lexicon:
                return w
    return None


def _invisible(token: str) -> str | None:
    for i, c in enumerate(token):
        if c in INVISIBLE:
            counts = (lambda s: any(x.isalpha() and x.isascii() for x in s)) if c in JOINERS else (lambda s: any(x.isalpha() for x in s))
            sides = counts(token[:i]), counts(token[i + 1 :])
            if all(sides) if c in JOINERS else any(sides):
                return f"U+{ord(c):04X}"
    return None


def _bidi(token: str) -> str | None:
    hit = next((c for c in token if c in OVERRIDES), None)
    if hit is None:
        letters = _letters(token)
        if 2 * sum(c.isascii() for c in letters) >= len(letters):
            hit = next((c for c in token if c in ISOLATES), None)
    return hit and f"U+{ord(hit):04X}"


def _leet(core: str, lexicon: frozenset[str]) -> str | None:
    if len(core) > MAX_LEET or not _LEET_SIGN.search(core) or _ORDINAL.fullmatch(core):
        return None
    decoded = "".join(c.lower() if c.isalpha() else c.translate(LEET) for c in core if c not in "'’")
    if not all(c.isalpha() for c in decoded):
        return None
    base = "".join(c.lower() for c in core if c.isalpha() and c.isascii())
    if len(base) < 2 or len(decoded) < 3 or decoded == base or (len(base) >= 4 and base in lexicon and _NUMBERED.fullmatch(core)):
        return None
    if decoded in lexicon:
        return decoded
    return _near(decoded, lexicon) if len(decoded) >= 6 else None


def _segmented(core: str, lexicon: frozenset[str]) -> str | None:
    runs = len(_SPLITS.findall(core))
    letters = _letters(core)
    if runs < 2 or 5 * runs < 3 * (len(letters) - 1) or any(len(p) > 1 and _letters(p) for p in _SPLITS.split(core)):
        return None
    word = "".join(letters).lower()
    return word if len(word) >= 4 and word in lexicon else None


def _classify(token: str, lexicon: frozenset[str]) -> tuple[str, str] | None:
    """(kind, detail) of a token's first anomaly."""
    core = token.strip(WRAPPING)
    if not token.isascii():
        if detail := _invisible(token):
            return "invisible", detail
        if detail := _bidi(token):
            return "bidi", detail
        if K.is_zalgo(token, MAX_MARKS):
            return "zalgo", "stacked combining marks"
        if len(core) >= 2 and core.lower() not in UNITS:
            scripts = K.detect_scripts(core)
            if K.has_bidi_conflict(core):
                return "bidi_mixed", " and ".join(scripts)
            if "Latin" in scripts and any(s != "Latin" and s not in CJK for s in scripts):
                return "mixed_script", " and ".join(scripts)
    if len(core) < 2:
        return None
    if word := _leet(core, lexicon):
        return "leet", word
    if any(c in SEPARATORS for c in core) and (word := _segmented(core, lexicon)):
        return "segmentation", word
    return None


@lru_cache(maxsize=8192)
def _plain(c: str) -> bool:
    """A Latin letter that no rule for characters outside ASCII looks at."""
    return c.isalpha() and K.detect_scripts(c) == ["Latin"] and K._marks_of(c) <= 1


@lru_cache(maxsize=1024)
def _telling(odd: str) -> re.Pattern:
    """What a token must hold to be anomalous: an odd character, a leet sign, or two separators."""
    return re.compile(f"[0-9@$|+{re.escape(odd)}]|.!.|[._-].*[._-]")


_TOKEN = re.compile(r"\S+")
REASONS = {
    "invisible": '"{token}" contains an invisible character ({detail})',
    "bidi": '"{token}" contains a bidirectional control character ({detail})',
    "zalgo": '"{token}" is overloaded with combining marks (zalgo)',
    "mixed_script": '"{token}" mixes {detail}',
    "bidi_mixed": '"{token}" mixes left-to-right and right-to-left letters ({detail}), which can visually reorder',
    "leet": '"{token}" decodes to the word "{detail}"',
    "segmentation": '"{token}" splits the word "{detail}"',
}


@dataclass(frozen=True)
class Lexicon:
    """Words, lower-cased, that leet and segmentation decode to."""

    words: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def of(cls, words) -> Lexicon:
        return cls(frozenset(w.lower() for w in words))


def inspect_anomalies(s: str, lexicon: Lexicon) -> dict:
    """{anomalous, kinds, findings, reason}; a finding has a token, its span in UTF-8 bytes, kind and detail."""
    findings = []
    telling = _telling("".join(sorted(c for c in set(s) if not c.isascii() and not _plain(c) and not c.isspace())))
    for m in _TOKEN.finditer(s):
        if telling.search(m[0]) and (hit := _classify(m[0], lexicon.words)):
            start = len(s[: m.start()].encode())
            findings.append({"kind": hit[0], "token": m[0], "start": start, "end": start + len(m[0].encode()), "detail": hit[1]})
    reason = REASONS[findings[0]["kind"]].format(**findings[0]) if findings else None
    return {"anomalous": bool(findings), "kinds": list(dict.fromkeys(f["kind"] for f in findings)), "findings": findings, "reason": reason}


def has_anomalies(s: str, lexicon: Lexicon) -> bool:
    return inspect_anomalies(s, lexicon)["anomalous"]


