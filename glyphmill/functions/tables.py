"""Mapping tables, built by rule from the Unicode data in ICU (which Spark ships) and from short fixed lists.

``load(spark)`` builds them once per driver; the result is a plain object that closures carry to
Python workers. Exactness against published tables differs and is stated per table in ``EXACTNESS``.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

EXACTNESS = {
    "confusables": "by rule from ICU's data of UTS 39 (Unicode 16); rows that later versions or supplements add are missing",
    "pinyin": "ICU Han-Latin",
    "translit_default": "fixed lists for Cyrillic, Greek, Latin letters that do not decompose and Hangul; else ICU, else by character names: approximate",
    "emoji": "by rule from Unicode character names, with fixed values for common short names: approximate",
    "case_folding": "str.casefold with the additions of Unicode 16",
    "width": "Unicode 15.1 East Asian width",
}

# Hangul romanisation, initials, medials and finals in code order.
HANGUL_INITIAL = "g kk n d tt r m b pp s ss - j jj ch k t p h".replace("-", "").split(" ")
HANGUL_MEDIAL = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
HANGUL_FINAL = "- g kk gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j ch k t p h".replace("-", "").split(" ")
# Compatibility jamo from U+3131, consonants then vowels.
COMPAT_JAMO = "g kk gs n nj nh d tt r lg lm lb ls lt lp lh m b pp bs s ss - j jj ch k t p h".replace("-", "").split(" ") + HANGUL_MEDIAL

# Default romanisation of Cyrillic, letter by letter.
CYRILLIC = (
    "АA БB ВV ГG ДD ЕE ЁYo ЖZh ЗZ ИI ЙY КK ЛL МM НN ОO ПP РR СS ТT УU ФF ХKh ЦTs ЧCh ШSh ЩShch Ъ ЫY Ь ЭE ЮYu ЯYa "
    "ЂDj ЃGj ЄYe ЅDz ІI ЇYi ЈJ ЉLj ЊNj ЋTsh ЌKj ЎU ЏDzh ҐG ЀE ЍI ӘA ӨO ҮU ҰU ҚQ ҒGh ҢNg ҲH ҺH ӢI ӮU ҶJ ӃK"
)
# Default romanisation of Greek.
GREEK = "ΑA ΒV ΓG ΔD ΕE ΖZ ΗI ΘTh ΙI ΚK ΛL ΜM ΝN ΞX ΟO ΠP ΡR ΣS ΤT ΥY ΦF ΧCh ΨPs ΩO ςs ͰH Ϲs"
# Latin letters that do not decompose.
LATIN = "ßss ẞSS æae ÆAE œoe ŒOE øo ØO đd ĐD łl ŁL þth ÞTh ðd ÐD ıi ĸk ŋng ŊNG ħh ĦH ŧt ŦT ĳij ĲIJ ŉ'n ſs Ɂ' ɂ' ƒf"
# Punctuation and signs.
SIGNS = "‘' ’' ‚, ‛' “\" ”\" „\" ‟\" ‹< ›> «<< »>> –- —-- ―-- ‐- ‑- …... •* ·* ′' ″\" №No ©(c) ®(r) ™tm €EUR £GBP ¥JPY ¢c §SS ¶P °deg ±+/- ×x ÷/ ¡! ¿? 。. 、, 「[ 」] ！! ？? ，, ：: ；; ー-"

# Consonants of the Indic core blocks, from the 21st place of a block on.
INDIC = "ka kha ga gha nga cha chha ja jha nya ta tha da dha na ta tha da dha na na pa pha ba bha ma ya ra ra la la la va sha sha sa ha".split(" ")
# Sinhala from U+0D85 (vowels), U+0D9A (consonants) and U+0DCF (vowel signs); a hyphen is an unassigned place.
SINHALA = {
    0x0D85: "a a ae ae i i u u r r l l e e ai o o au".split(" "),
    0x0D9A: "ka kha ga gha nga nnga cha chha ja jha nya jnya nja ta tha da dha na nda ta tha da dha na - nda pa pha ba bha ma mba ya ra - la - - va sha sha sa ha la fa".split(" "),
    0x0DCF: "a ae ae i i u - u - r e e ai o o au l".split(" "),
}
# Old scripts from a first code point on; a hyphen is a place without a value.
OLD_SCRIPTS = {
    0x1681: "b l f s n h d t c q m g ng z r a o u e i ea oi ui ia ae p".split(" "),
    0x10330: "a b g d e q z h th i k l m n j u p 90 r s t w f x hw o 900".split(" "),
    0x103A0: "a i u ka ku ga gu xa ca ja ji ta tu da di du tha pa ba fa na nu ma mi mu ya va vi ra ru la sa za sha ssa ha".split(" "),
    0x103C8: "Auramazda Auramazda Auramazda dahyaus dahyaus baga bumis - - 1 2 10 20 100".split(" "),
    0x10000: (
        "a e i o u da de di do du ja je - jo - ju ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu pa pe pi po qa qe qi qo - ra re ri ro ru sa se si so su ta te ti to tu - - wa we wi wo za ze - zo "
        "a2 a3 au dwe dwo nwa phu pte pu2 ra2 ra3 ro2 ta2 two twe *18 *19 *22 *34 *47 *49 *56 *63"
    ).split(" "),
}
# Vowels of the Ethiopic syllables in a row of eight.
ETHIOPIC = ("e", "u", "i", "a", "e", "", "o", "wa")
# Letters of other scripts where the default is not ICU's.
SCRIPTS = (
    "\u0621' \u0623a \u0624' \u0625a \u0626' \u0627a \u0629h \u062Dh \u0635s \u0636d \u0637t \u0638z \u0639' \u063Agh \u0649a \u064Ea \u064Fu \u0650i \u0651W \u0670a \u0671a \u0679t \u0687ch \u0688d \u0691r \u0698zh \u06D0e "
    "\u05B0e \u05C0 \u05D0' \u05D1v \u05D7ch \u05D8t \u05DAkh \u05DBkh \u05E2 \u05E3f \u05E4f \u05E5ts \u05E6ts \u05E7q \u05E9sh \u05F0v \u05F1vy \u05F2y "
    "\u0538Y \u0539T \u0548Vo \u0549Ch \u054CR \u0551Ts \u0552V \u0553P \u0554K \u0559' \u0568y \u0569t \u0578vo \u0579ch \u057Cr \u0581ts \u0582v \u0583p \u0584k \u0587yev \u0588yi "
    "\u10D7t \u10E4p \u10E5k \u10E6gh \u10E9ch \u10EAts \u10EBdz \u10ECts \u10EEkh \u10F1he \u10F2hi \u10F4har \u10F5ho "
    "\u16A6th \u16B2k \u16B7g \u16B9w \u16BAh \u16BEn \u16C1i \u16C3j \u16C8p \u16C9z \u16CAs \u16CFt \u16D2b \u16D6e \u16D7m \u16DAl \u16DCng \u16DFo \u16DEd \u16EB. \u16EC: "
    "\u3062di \u3065du \u30C2di \u30C5du \u053AZh \u056Azh \u0547Sh \u0577sh \u053ETs \u056Ets \u0542Gh \u0572gh \u0541Dz \u0571dz \u058A- "
    "\u0E31a \u0E34i \u0E36ue \u0E38u \u0E40e \u0E41ae \u0E42o \u0E43ai \u0E44ai \u0E3FB \u0E48 \u0E49 \u0E4A \u0E4B \u0E4C \u0EC8 \u0EC9 \u0ECA \u0ECB \u0ECC "
    "\u1362. \u1363, \u1364; \u1365: \u1367? \u17B7e \u05B1e \u05B2a \u05B3o \u05B4i \u05B5e \u05B6e \u05B7a \u05B8a \u05B9o \u05BAo \u05BBu \uFB4Fal "
    "\u05D5v \uFB2Ash \uFB2Bs \u056Dkh \u053DKh \uFB17mkh \u0BB4zha \u0E33am "
    "\u0E81k \u0E82kh \u0E84kh \u0E87ng \u0E88ch \u0EAAs \u0E8As \u0E8Dny \u0E94d \u0E96th \u0E97th \u0E99n \u0E9Ab \u0E9Bp \u0E9Cph \u0E9Df \u0E9Eph \u0E9Ff \u0EA1m \u0EA2y \u0EA3r \u0EA5l \u0EA7w \u0EABh \u0EAEh "
    "\u0EB0a \u0EB1a \u0EB3am \u0EB4i \u0EB8u \u0EBBo \u0EBCl \u0EC0e \u0EC2o \u0EC4ai "
    "\u0E08ch \u0E0Bs \u0E24rue \u0E26lue \u0E2Do \u0E32a \u0E35i \u0E37ue \u0E39u \u0E45a \u0E4Dm \u0E95t \u0EADo \u0EB2a \u0EB5i \u0EB6ue \u0EB7ue \u0EB9u \u0EBDy \u0EC1ae \u0EC3ai \u0ECDm"
)

# What language tables change, per language: character, then its romanisation.
LANGUAGES = {
    "am": "ጸse ጹsu ጺsi ጻsa ጼse ጽs ጾso ጿswa ፀse ፁsu ፂsi ፃsa ፄse ፅs ፆso ፇswa ዐ'e ዑ'u ዒ'i ዓ'a ዔ'e ዕ'e ዖ'o",
    "bg": "ЪA ъa ЩSht щsht",
    "ca": "·",
    "de": "ÄAe ÖOe ÜUe äae öoe üue ẞSS",
    "el": "ΗI ηi ΥY υy ΧCh χch",
    "es": "¡! ¿?",
    "et": "ÄAe äae ÖOe öoe ÜUe üue ŠSh šsh ŽZh žzh",
    "fa": "بb پp تt ثs جj چch حh خkh دd ذz رr زz ژzh سs شsh صs ضz طt ظz ع' غgh فf قq کk گg لl مm نn وv هh یy كk اa آa ء' أa إe ؤ' ئ' ةe ىa يy ۀ-e ہh َa ِe ُo ْ ّ ۰0 ۱1 ۲2 ۳3 ۴4 ۵5 ۶6 ۷7 ۸8 ۹9 ،, ؛; ؟? ۔.",
    "fr": "ŒOE œoe ÆAE æae",
    "is": "ÆAe æae ðd ÐD þth ÞTh",
    "it": "ªa ºo",
    "ja": "ー",
    "ja-kunrei": "しsi じzi ちti ぢdi つtu づdu ふhu っtu シsi ジzi チti ヂdi ツtu ヅdu フhu ッtu",
    "nl": "ĲIJ ĳij",
    "no": "ÅAa åaa ØOe øoe ÆAe æae",
    "pt": "ªa ºo",
    "ru": "ЁYo ёyo ЙY йy Ъ\" ъ\" Ь' ь' ЭE эe ЮYu юyu ЯYa яya",
    "sr": "ЂDj ђdj ЋC ћc ЏDz џdz ЉLj љlj ЊNj њnj ЈJ јj ЙY йy",
    "sv": "ÄAe äae ÖOe öoe",
    "tr": "İI ıi ĞG ğg ŞS şs",
    "uk": "ГH гh ҐG ґg ЄYe єye ЇI їi ІI іi ИY иy Ь' ь'",
    "vi": "ĐD đd ƠO ơo ƯU ưu",
}
ALIASES = {"nb": "no", "nn": "no", "da": "no"}
ISO9 = "ЙJ йj Ъ ъ Ь ь ЁJo ёjo ЩShch щshch ЖZh жzh ХH хh ЦC цc ЧCh чch ШSh шsh ЮJu юju ЯJa яja ЭE эe"
GOST7034 = "ЙJ йj ХX хx ЦC цc ЩShh щshh Ъ ъ Ь ь"
# ASCII to native letters.
REVERSE = {
    "el": "ThΘ thθ PhΦ phφ ChΧ chχ PsΨ psψ AΑ BΒ GΓ DΔ EΕ ZΖ IΗ KΚ LΛ MΜ NΝ XΞ OΟ PΠ RΡ SΣ TΤ UΥ YΥ FΦ aα bβ gγ dδ eε zζ iη kκ lλ mμ nν xξ oο pπ rρ sσ tτ uυ yυ fφ",
    "ru": "ShchЩ shchщ ZhЖ zhж KhХ khх TsЦ tsц ChЧ chч ShШ shш YuЮ yuю YaЯ yaя YoЁ yoё YeЕ yeе AА BБ VВ GГ DД EЕ ZЗ IИ JЙ KК LЛ MМ NН OО PП RР SС TТ UУ FФ YЫ aа bб vв gг dд eе zз iи jй kк lл mм nн oо pп rр sс tт uу fф yы",
    "uk": "ShchЩ shchщ ZhЖ zhж KhХ khх TsЦ tsц ChЧ chч ShШ shш YuЮ yuю YaЯ yaя YiЇ yiї YeЄ yeє AА BБ VВ HГ GҐ DД EЕ ZЗ YИ IІ KК LЛ MМ NН OО PП RР SС TТ UУ FФ aа bб vв hг gґ dд eе zз yи iі kк lл mм nн oо pп rр sс tт uу fф",
}
# Digits that UTS 39 folds to something else than their value.
DIGITS_TR39 = {
    0x0660: ".", 0x0661: "l", 0x0665: "o", 0x0667: "V", 0x0668: "Ʌ", 0x06F0: ".", 0x06F1: "l", 0x06F5: "o", 0x06F7: "V", 0x06F8: "Ʌ", 0x07C0: "O", 0x0966: "o", 0x09E6: "o",
    0x0A66: "o", 0x0AE6: "o", 0x0B66: "o", 0x0BE6: "o", 0x0C66: "o", 0x0CE6: "O", 0x0D66: "o", 0x0E50: "o", 0x0ED0: "o", 0x1040: "o", 0x17E0: "o", 0x2079: "ꝱ", 0x114D0: "o",
    0x118E0: "O", 0x118E3: "rn", 0x118E5: "Z", 0x118E6: "W", 0x118E9: "C", 0x1CCF0: "O", 0x1CCF1: "l", 0x1D7CE: "O", 0x1D7CF: "l", 0x1D7D8: "O", 0x1D7D9: "l", 0x1D7E2: "O",
    0x1D7E3: "l", 0x1D7EC: "O", 0x1D7ED: "l", 0x1D7F6: "O", 0x1D7F7: "l", 0x1FBF0: "O", 0x1FBF1: "l",
}
# Composed letters that fold to their base, and letters that fold across scripts.
LISTED_COMPOSED = frozenset((0x00C7, 0x00E7, 0x0407, 0x0457))
CROSS_SCRIPT = {0x04CF: "l", 0x2502: "l", 0x2211: "s", 0x03A3: "S"}
#: Digraphs that look like one letter; for host names only.
CONTRACTIONS = {"rn": "m", "vv": "w", "cl": "d"}


def _pairs(text: str) -> dict[int, str]:
    return {ord(x[0]): x[1:] for x in text.split(" ")}


def _with_lower(text: str) -> dict[int, str]:
    """Each pair, and for a capital its small letter with the small romanisation."""
    out = {}
    for cp, value in _pairs(text).items():
        out[cp] = value
        small = chr(cp).lower()
        if len(small) == 1 and small != chr(cp):
            out.setdefault(ord(small), value.lower())
    return out


def _excluded() -> dict[str, str]:
    """Clusters that normalisation leaves apart although a composed character exists, by rule from the decompositions."""
    out = {}
    for c in map(chr, (*range(0x0340, 0x0345), *range(0x0900, 0x0E00), *range(0x0F40, 0x0FC0), *range(0xFB1D, 0xFB50))):
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and unicodedata.normalize("NFC", c) != c:
            out[apart] = c
    return out


EXCLUDED = _excluded()
_EXCLUDED = re.compile("|".join(sorted(map(re.escape, EXCLUDED), key=len, reverse=True)))


def compose(s: str, table: dict[int, str]) -> str:
    """NFC, and those composed characters that NFC excludes but the table maps."""
    if s.isascii():
        return s
    return _EXCLUDED.sub(lambda m: EXCLUDED[m[0]] if ord(EXCLUDED[m[0]]) in table else m[0], unicodedata.normalize("NFC", s))


def fold_case(s: str) -> str:
    """Full case folding with the letters that Unicode 16 added."""
    folded = s.casefold()
    return folded if s.isascii() or not _NEW_16.search(folded) else folded.translate(_FOLD_16)


def map_chars(s: str, table: dict[int, str]) -> str:
    """``s.translate(table)``.

    Few distinct keys are replaced one by one, which searches at memory speed; many, or those that another's value holds, go through ``translate``.
    """
    hits = [c for c in set(s) if ord(c) in table]
    if len(hits) > 20 or not set().union(*(table[ord(c)] for c in hits)).isdisjoint(hits):
        return s.translate(table)
    for c in hits:
        s = s.replace(c, table[ord(c)])
    return s


_FOLD_16 = {0x1C89: "ᲊ", 0xA7CB: "ɤ", 0xA7CC: "ꟍ", 0xA7DA: "ꟛ", 0xA7DC: "ƛ"} | {c: chr(c + 0x20) for c in range(0x10D50, 0x10D66)}
_NEW_16 = re.compile("[" + "".join(map(chr, _FOLD_16)) + "]")


def _marks(s: str) -> str:
    return "".join(c for c in s if unicodedata.category(c)[0] != "M")


def _is_latin(cp: int) -> bool:
    return cp < 0x80 or 0xC0 <= cp <= 0x24F or 0x1E00 <= cp <= 0x1EFF or 0x2C60 <= cp <= 0x2C7F or 0xA720 <= cp <= 0xA7FF or 0xAB30 <= cp <= 0xAB6F


def _is_cyrillic(cp: int) -> bool:
    return 0x400 <= cp <= 0x52F or 0x2DE0 <= cp <= 0x2DFF or 0xA640 <= cp <= 0xA69F


@dataclass(frozen=True)
class Tables:
    """What the scanners look up; immutable, so a snapshot travels in a closure."""

    latin: dict[int, str] = field(repr=False)
    cyrillic: dict[int, str] = field(repr=False)
    upstream: frozenset[int] = field(repr=False)
    default: dict[int, str] = field(repr=False)
    toned: dict[int, str] = field(repr=False)
    languages: dict[str, dict[int, str]] = field(repr=False)
    iso9: dict[int, str] = field(repr=False)
    gost: dict[int, str] = field(repr=False)
    regions: dict[str, str] = field(repr=False, default_factory=dict)

    def confusables(self, target: str = "latin", digits: str = "numeric") -> dict[int, str]:
        if target not in ("latin", "cyrillic"):
            raise ValueError(f"target_script must be latin or cyrillic; got {target!r}")
        if digits not in ("numeric", "tr39"):
            raise ValueError(f"digit_policy must be numeric or tr39; got {digits!r}")
        base = self.latin if target == "latin" else self.cyrillic
        return base | DIGITS_TR39 if digits == "tr39" and target == "latin" else base


def _closed(table: dict[int, str]) -> dict[int, str]:
    """No output holds a key any more."""
    for _ in range(8):
        new = {k: v.translate(table) for k, v in table.items()}
        if new == table:
            return table
        table = new
    return {k: v for k, v in table.items() if not any(ord(c) in table for c in v)}


def _confusables(checker) -> tuple[dict[int, str], dict[int, str], frozenset[int]]:
    points = [c for c in range(0x20, 0x20000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co", "Cc") and not (0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4)]
    skeletons = dict(zip(points, checker.getSkeleton("\n".join(map(chr, points))).split("\n"), strict=True))
    # Composed letters are left to their parts, but for those that UTS 39 lists.
    sources = {c for c, s in skeletons.items() if s != chr(c) and (unicodedata.normalize("NFD", chr(c)) == chr(c) or c in LISTED_COMPOSED)}
    classes: dict[str, list[int]] = {}
    for c, s in skeletons.items():
        classes.setdefault(s, []).append(c)

    def target(own, prefer) -> dict[int, str]:
        out = {}
        for s, members in classes.items():
            plain = _marks(s)
            inside = [c for c in members if own(c)]
            if plain and all(own(ord(x)) and (ord(x) < 0x80 or own is _is_cyrillic) for x in plain):
                found = lambda c, plain=plain: plain
            elif inside:  # of the script's letters one of the same case, if there is one
                found = lambda c, inside=inside: chr(min(inside, key=lambda x: (unicodedata.category(chr(x)) != unicodedata.category(chr(c)), prefer(x))))
            else:
                continue
            for c in members:
                value = found(c)
                if chr(c).isspace() or chr(c) == value or chr(c) in value:
                    continue
                if own is _is_latin and c > 0x7F and _is_latin(c) and not value.isascii():
                    continue
                if own is _is_latin and c < 0x80 and (chr(c).isalnum() or value.isspace() or c not in sources):
                    continue
                if own is _is_cyrillic and (_is_cyrillic(c) or (c < 0x80 and not chr(c).isalpha() and chr(c) != "|")):
                    continue
                if c in sources or (own is not _is_latin and inside):
                    out[c] = value
        return out

    latin = target(_is_latin, lambda c: (not (c < 0x80 and chr(c).isalpha()), c))
    for c in points:  # a digit of any script folds to its value
        if c > 0x7F and unicodedata.category(chr(c)) == "Nd" and (c in latin or c in sources):
            latin[c] = str(unicodedata.decimal(chr(c)))
    latin |= {ord("|"): "l", ord('"'): "''", ord("`"): "'"} | CROSS_SCRIPT
    for c in points:
        if latin.get(c) == "l" and unicodedata.category(chr(c)) == "Lu":
            latin[c] = "I"  # a capital looks like the capital
        if c > 0x3A3 and unicodedata.normalize("NFKC", chr(c)) == "Σ":
            latin[c] = "S"
    latin = {c: v for c, v in latin.items() if v.strip()}
    cyrillic = {c: v for c, v in target(_is_cyrillic, lambda c: c).items() if len(v) == 1} | {ord("l"): chr(0x04CF)}
    both = []
    for table in (latin, cyrillic):
        for c in range(0x340, 0x2F000):  # a singleton folds as what it is canonically equal to
            d = unicodedata.decomposition(chr(c))
            if d and d[0] != "<" and " " not in d and int(d, 16) in table:
                table.setdefault(c, table[int(d, 16)])
        both.append(_closed(table))
    return both[0], both[1], frozenset(sources)


_NAME_PARTS = ("LETTER ", "SYLLABLE ", "SYLLABICS ", "VOWEL SIGN ", "CONSONANT SIGN ", "INDEPENDENT VOWEL ", "VOWEL ")


def _by_name(ch: str) -> str | None:
    """A romanisation from a letter's name: what follows LETTER, SYLLABLE or VOWEL SIGN."""
    name = unicodedata.name(ch, "")
    if unicodedata.category(ch) == "Nd":
        return str(unicodedata.decimal(ch))
    for part in _NAME_PARTS:
        if part in name:
            out = name.rsplit(part, 1)[1].split(" ")[-1].lower().replace("-", "")
            return out.replace("aa", "a").replace("ii", "i").replace("uu", "u") if out.isascii() and out.isalnum() else None
    return None


def hangul(ch: str) -> str:
    k = ord(ch) - 0xAC00
    return HANGUL_INITIAL[k // 588] + HANGUL_MEDIAL[k % 588 // 28] + HANGUL_FINAL[k % 28]


def _translit(transliterator) -> tuple[dict[int, str], dict[int, str]]:
    run = lambda rules, points: dict(zip(points, transliterator.getInstance(rules).transliterate("\n".join(map(chr, points))).split("\n"), strict=True))
    han = [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000), *range(0xF900, 0xFA6E)]
    toned = {c: v for c, v in run("Han-Latin", han).items() if v and v != chr(c) and not any(ord(x) > 0x2FFF for x in v)}
    letters = [c for c in range(0xA0, 0x11000) if not (0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or 0xD800 <= c < 0xFB00) and unicodedata.category(chr(c))[0] in "LMNPS"]
    by_icu = run("Any-Latin; Latin-ASCII", letters)
    default = {}
    for c, value in by_icu.items():
        if unicodedata.category(chr(c))[0] == "M" and not 0x900 <= c <= 0x1CFF:
            default[c] = ""
            continue
        kept = "".join(x for x in value if x.isascii())
        if value.isascii() and value:
            default[c] = kept.lstrip("~") or kept
        elif (named := _by_name(chr(c))) is not None:
            default[c] = named
        elif kept.strip():
            default[c] = kept
    for c in letters:  # accented letters by what they are made of
        plain = _marks(unicodedata.normalize("NFKD", chr(c)))
        if plain and plain.isascii() and unicodedata.category(chr(c))[0] == "L":
            default[c] = plain
    default |= _with_lower(CYRILLIC) | _with_lower(GREEK) | _pairs(LATIN) | _pairs(SIGNS)
    for block in range(0x0900, 0x0D80, 0x80):
        default |= {block + 0x15 + k: v for k, v in enumerate(INDIC) if unicodedata.category(chr(block + 0x15 + k)) == "Lo"}
        default[block + 0x06] = "aa"
    for c in range(0x1000, 0x10A0):  # by name, where ICU spells the aspirated ones otherwise
        default[c] = _by_name(chr(c)) or default.get(c, "")
    for c in range(0x1780, 0x17A3):
        default[c] = re.sub("o$", "a", re.sub("^c(?=[ao])", "ch", _by_name(chr(c)) or ""))
    for c in range(0x1200, 0x1380):
        if unicodedata.category(chr(c)) == "Lo":
            default[c] = re.match("[^aeiou]*", _by_name(chr(c)) or "")[0].replace("ph", "p") + ETHIOPIC[(c - 0x1200) % 8]
    for c in range(0x1828, 0x1843):
        default[c] = default.get(c, "").rstrip("a")
    for k in range(0x2B):  # the other cases of Georgian
        if 0x10D0 + k in default:
            default[0x1C90 + k] = default[0x10D0 + k].capitalize()
            default[0x2D00 + k] = default[0x10D0 + k] if k < 0x26 else default.get(0x2D00 + k, "")
    default |= {0x30FB: " ", 0xFF65: " "} | dict(zip(range(0x103B, 0x103F), "yrwh", strict=True))
    default |= {c: "" for c in range(0xA0, 0x10000) if unicodedata.category(chr(c)) == "Cf"}
    for c in range(0x2190, 0x2200):
        default.pop(c, None)
    default |= {first + k: v for first, values in OLD_SCRIPTS.items() for k, v in enumerate(values) if v != "-"}
    default |= {first + k: v for first, values in SINHALA.items() for k, v in enumerate(values) if v != "-"} | {0x0D82: "m", 0x0D83: "h"}
    default |= _pairs(SCRIPTS)
    for c in (*range(0x370, 0x400), *range(0x1F00, 0x2000)):
        base = _marks(unicodedata.normalize("NFD", chr(c)))
        if len(base) == 1 and ord(base) != c and ord(base) in default:
            default[c] = default[ord(base)]
    default |= {0x3131 + k: v for k, v in enumerate(COMPAT_JAMO)}
    default |= {c: "".join(_marks(unicodedata.normalize("NFD", v)).split()).lower() for c, v in toned.items()}
    return default, toned


_loaded: dict[str, Tables] = {}


def load(spark: SparkSession) -> Tables:
    """The tables, built once per driver process."""
    if "tables" not in _loaded:
        text = spark.sparkContext._jvm.com.ibm.icu.text
        latin, cyrillic, upstream = _confusables(text.SpoofChecker.Builder().build())
        default, toned = _translit(text.Transliterator)
        languages = {k: _pairs(v) for k, v in LANGUAGES.items()}
        locale = spark.sparkContext._jvm.java.util.Locale
        regions = {code: locale("", code).getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()}
        _loaded["tables"] = Tables(latin, cyrillic, upstream, default, toned, languages, _pairs(ISO9), _pairs(GOST7034), regions)
    return _loaded["tables"]
