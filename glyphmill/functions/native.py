"""Functions that run in the JVM: built-in expressions, and ICU through ``try_reflect``.

All map null to null. Those that call ICU (normalisation and case folding) count as not
deterministic for Catalyst: filters stay above them, and a join needs them as columns first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charsets as S

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
NON_ASCII = r"[^\x00-\x7F]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_ascii(c) -> Column:
    return ~F.regexp_like(_col(c), F.lit(NON_ASCII))


def normalize(c, form: str = "NFC") -> Column:
    """NFC, NFD, NFKC or NFKD by ICU."""
    if form not in FORMS:
        raise ValueError(f"form must be one of {', '.join(FORMS)}; got {form!r}")
    method = "decompose" if form.endswith("D") else "compose"
    return F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), _col(c), F.lit("K" in form))


def is_normalized(c, form: str = "NFC") -> Column:
    return normalize(c, form) == _col(c)


def fold_case(c) -> Column:
    """Full, locale-free case folding by ICU."""
    return F.try_reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _col(c), F.lit(True))


casefold = fold_case


def strip_accents(c) -> Column:
    """Combining marks off, then NFC: letters that do not decompose (ø, ß) stay."""
    return normalize(F.regexp_replace(normalize(c, "NFD"), r"\p{M}+", ""), "NFC")


remove_accents = ascii_fold = strip_accents


def collapse_whitespace(c) -> Column:
    # Only runs that change are replaced: those that begin with another space than U+0020, or are longer than one.
    other = S.java_class(S.merged({ord(x) for x in S.FOLD_SPACE + S.BLANK_LETTERS} - {0x20}))
    return F.trim(F.regexp_replace(_col(c), f"[{other}][{S.SPACE_CLASS}]*|\\x20[{S.SPACE_CLASS}]+", " "))


def strip_control_chars(c) -> Column:
    return F.regexp_replace(_col(c), f"[{S.CONTROL_CLASS}]+", "")


def strip_zero_width_chars(c) -> Column:
    return F.regexp_replace(_col(c), f"[{S.ZERO_WIDTH_CLASS}]+", "")


def strip_bidi(c) -> Column:
    return F.regexp_replace(_col(c), f"[{S.BIDI_CLASS}]+", "")


def strip_tags(c) -> Column:
    """Tag characters off, except in the flags that are written with them."""
    keep = "|".join(S.FLAGS)
    return F.regexp_replace(_col(c), f"({keep})|[{S.java_class([S.TAG_RANGE])}]", "$1")


def strip_variation_selectors(c) -> Column:
    return F.regexp_replace(_col(c), f"[{S.java_class(S.SELECTOR_RANGES)}]+", "")


def strip_noncharacters(c) -> Column:
    return F.regexp_replace(_col(c), f"[{S.java_class(S.NONCHARACTER_RANGES)}]+", "")


def strip_pua(c) -> Column:
    return F.regexp_replace(_col(c), f"[{S.java_class(S.PRIVATE_RANGES)}]+", "")


def strip_invisible(c, policy: str = "comparison") -> Column:
    """Tags, grapheme joiner, noncharacters, private use and selectors off.

    The ``rendering`` policy keeps private use, and the text and emoji selectors after a visible character.
    """
    if policy not in ("comparison", "rendering"):
        raise ValueError(f"policy must be comparison or rendering; got {policy!r}")
    out = F.regexp_replace(strip_noncharacters(strip_tags(c)), S.GRAPHEME_JOINER, "")
    if policy == "comparison":
        return strip_pua(strip_variation_selectors(out))
    out = F.regexp_replace(out, f"[{S.java_class([(0xFE00, 0xFE0D), (0xE0100, 0xE01EF)])}]+", "")
    hidden = S.ZERO_WIDTH_CLASS + S.BIDI_CLASS + S.SPACE_CLASS + S.CONTROL_CLASS + S.java_class([(0xFE0E, 0xFE0F)])
    return F.regexp_replace(out, rf"(?<![^{hidden}])[\x{{FE0E}}\x{{FE0F}}]+", "")


def is_zalgo(c, threshold: int = 3) -> Column:
    """Whether a run of more than ``threshold`` combining marks occurs."""
    return F.regexp_like(normalize(c, "NFD"), F.lit(rf"\p{{M}}{{{threshold + 1},}}"))


def strip_zalgo(c, max_marks: int = 2) -> Column:
    """At most ``max_marks`` combining marks stay in a run; the result is NFC."""
    if max_marks < 0:
        raise ValueError("max_marks must be at least 0")
    pattern = rf"(\p{{M}}{{{max_marks}}})\p{{M}}+" if max_marks else r"(\p{M})*"
    return normalize(F.regexp_replace(normalize(c, "NFD"), pattern, "$1" if max_marks else ""), "NFC")


def has_bidi_conflict(c) -> Column:
    """Whether strong left-to-right and right-to-left letters both occur; numerics are neutral."""
    named = [s for _, _, s in S.SCRIPT_RANGES if s not in ("Inherited", *S.RTL)]
    ltr, rtl = (F.regexp_like(_col(c), F.lit(f"[{S.java_class(S.ranges_of(*set(k)))}&&[^\\p{{N}}]]")) for k in (named, S.RTL))
    return ltr & rtl


def detect_scripts(c) -> Column:
    """Scripts of a text in the order of their first characters, without Common and Inherited."""
    text = _col(c)

    def script(ch: Column) -> Column:
        case = F.when(F.ascii(ch) < 0x41, F.lit("Common"))
        for a, b, name in S.SCRIPT_RANGES:
            case = case.when(F.ascii(ch).between(a, b), F.lit(name))
        return case.otherwise(F.lit("Common"))

    found = F.array_distinct(F.transform(F.array_distinct(F.split(text, "")), script))
    general = F.filter(found, lambda x: ~x.isin("Common", "Inherited"))
    # Most texts hold no letter beyond the Latin blocks: one search tells, and one more whether they hold any.
    latin = F.when(F.regexp_like(text, F.lit(f"[{S.java_class(r for r in S.ranges_of('Latin') if r[1] < 0x300)}]")), F.array(F.lit("Latin"))).otherwise(F.array().cast("array<string>"))
    return F.when(text.isNull(), F.lit(None)).when(~F.regexp_like(text, F.lit(r"[^\x{0}-\x{36F}]")), latin).otherwise(general)


def escape_html(c) -> Column:
    out = _col(c)
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def strip_log_injection(c, replacement: str = "�", keep_tab: bool = False) -> Column:
    """Each control character or line separator becomes ``replacement``, which must not hold any itself."""
    import re

    if re.search("[\x00-\x1f\x7f-\x9f\u2028\u2029]", replacement):
        raise ValueError("replacement must not hold control characters or line separators")
    tab = r"\x{0}-\x{8}\x{A}-\x{1F}" if keep_tab else r"\x{0}-\x{1F}"
    return F.regexp_replace(_col(c), rf"[{tab}\x{{7F}}-\x{{9F}}\x{{2028}}\x{{2029}}]", replacement.replace("\\", "\\\\").replace("$", "\\$"))


def graphemes(c) -> Column:
    """Extended grapheme clusters, by the JVM's rules."""
    return F.regexp_extract_all(_col(c), F.lit(r"(\X)"), F.lit(1))


def grapheme_len(c) -> Column:
    return F.size(graphemes(c))


def grapheme_truncate(c, n: int) -> Column:
    if n < 0:
        raise ValueError("n must be at least 0")
    return F.array_join(F.slice(graphemes(c), 1, n), "") if n else F.when(_col(c).isNotNull(), F.lit(""))


def slugify_ascii(c, separator: str = "-") -> Column:
    """The slug of texts that hold ASCII only, with the default options."""
    literal = separator.replace("\\", "\\\\").replace("$", "\\$")  # as a replacement it is no pattern
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "^[^a-z0-9]+|[^a-z0-9]+$", ""), "[^a-z0-9]+", literal)


def strip_format(c) -> Column:
    """Format characters off for display: no normalisation."""
    return collapse_whitespace(strip_zero_width_chars(strip_control_chars(strip_invisible(strip_bidi(c), "rendering"))))


display_clean = strip_format


def percent_encode(c, component: str = "query") -> Column:
    """UTF-8 bytes percent-encoded for a URL's ``path``, ``segment``, ``query`` or ``form``.

    Letters, digits and ``-._~`` stay everywhere; a segment also keeps ``!$&'()*+,;=:@`` and a path ``/``; a form
    writes a space as ``+``.
    """
    if component not in COMPONENTS:
        raise ValueError(f"component must be one of {', '.join(COMPONENTS)}; got {component!r}")
    out = F.url_encode(_col(c))  # a space is +, * stays and ~ is encoded
    space = "+" if component == "form" else "%20"
    out = F.replace(F.replace(F.replace(out, F.lit("+"), F.lit(space)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for ch in COMPONENTS[component]:
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return out


#: What each component keeps beyond letters, digits and ``-._~``.
COMPONENTS = {"path": "!$&'()*+,;=:@/", "segment": "!$&'()*+,;=:@", "query": "", "form": ""}
