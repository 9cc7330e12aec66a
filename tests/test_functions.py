"""Scalar functions against literal pairs and properties."""

import tracemalloc
import unicodedata

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import context, kernels as K, metadata, native, security, udfs
from glyphmill.functions.translit import Context, Reverser, Romanizer, Untranslatable, check_lang, inspect_auto_lang
from glyphmill.plans import catalogue, presets as P

TEXT = st.text(max_size=40)
QUICK = settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize(("name", "text", "expected"), [
    ("canonicalize", "раypal", "paypal"), ("canonicalize", "ﬁlter", "filter"), ("canonicalize", "admin‮user", "adminuser"), ("canonicalize", "hello\x01world", "helloworld"),
    ("ml_normalize", "Über", "uber"), ("sort_key", "Über", "über"), ("search_key", "Москва", "moskva"), ("catalog_key", "Ünïcode", "unicode"), ("strip_obfuscation", "pаypаl", "paypal"),
    ("canonicalize_strict", "аррӏе", "apple"), ("security_clean", "раypal", "paypal"),
])
def test_presets(tables, name, text, expected):
    assert P.preset(name, tables)(text) == expected


@pytest.mark.parametrize("name", ["canonicalize", "canonicalize_strict", "search_key", "sort_key", "catalog_key"])
@QUICK
@given(s=TEXT)
def test_presets_are_idempotent(tables, name, s):
    f = P.preset(name, tables)
    once = f(s)
    assert f(once) == once


@QUICK
@given(s=TEXT)
def test_canonicalize_does_not_depend_on_the_form(tables, s):
    f = P.preset("canonicalize", tables)
    assert f(unicodedata.normalize("NFC", s)) == f(unicodedata.normalize("NFD", s))


@pytest.mark.parametrize(("text", "options", "expected"), [
    ("Москва", {}, "Moskva"), ("Юрий", {"strict_iso9": True}, "Jurij"), ("Київ", {"lang": "uk"}, "Kyiv"), ("北京市", {}, "bei jing shi"), ("서울", {}, "seo ul"), ("ひらがな", {}, "hiragana"),
    ("Αθήνα", {}, "Athina"), ("Größe", {"lang": "de"}, "Groesse"), ("北", {"tones": True}, "běi"), ("hello", {}, "hello"), ("ab", {}, "a[?]b"), ("ab", {"errors": "ignore"}, "ab"),
    ("ab", {"errors": "preserve"}, "ab"), ("क्षमा", {}, "kshama"), ("ｆｕｌｌ", {}, "full"),
])
def test_transliterate(tables, text, options, expected):
    assert Romanizer(tables, **options)(text) == expected


def test_transliterate_refuses(tables):
    with pytest.raises(Untranslatable) as e:
        Romanizer(tables, errors="strict")("é")
    assert (e.value.ch, e.value.byte_offset) == ("", 2)
    with pytest.raises(ValueError, match="did you mean"):
        check_lang("dee")
    with pytest.raises(ValueError, match="exclude"):
        Romanizer(tables, strict_iso9=True, gost7034=True)
    with pytest.raises(ValueError, match="errors"):
        Romanizer(tables, errors="other")
    assert Romanizer(tables).untranslatable("éx") == [("", 2), ("", 6)]


@pytest.mark.parametrize("ch", [chr(c) for c in (0x0457, 0xE7, 0x3AF, 0x625, 0xEF, 0xE9, 0x107, 0xFC, 0xAC01, 0xFB31, 0x0958)])
def test_composition_does_not_matter(tables, ch):
    """A character and its parts give the same answer, also where NFC leaves them apart."""
    forms = {unicodedata.normalize(f, ch) for f in ("NFC", "NFD", "NFKD")} | {ch}
    for f in (Romanizer(tables), Romanizer(tables, "uk"), lambda s: K.fold_confusables(s, tables.latin), P.preset("canonicalize", tables), P.preset("search_key", tables)):
        assert len({unicodedata.normalize("NFC", f(s)) for s in forms}) == 1


@pytest.mark.parametrize(("text", "lang", "expected"), [("Moskva", "ru", "Москва"), ("SH", "ru", "Ш"), ("Shch", "ru", "Щ"), ("Kyyiv", "uk", "Київ"), ("thalassa", "el", "θαλασσα")])
def test_reverse(text, lang, expected):
    assert Reverser(lang)(text) == expected


def test_registry(tables):
    c = Context().register_lang("xx", {"ы": "Q"}).register_replacements({"ab": "1", "abc": "2"})
    assert Romanizer(tables, "xx", context=c)("ы abc ab") == "Q 2 1"
    assert c.remove_replacement("abc").replace("abc") == "1c"
    with pytest.raises(RuntimeError):
        c.seal().register_lang("yy", {})
    with pytest.raises(ValueError, match="single"):
        c.register_lang("zz", {"ab": "x"})


def test_registered_ascii_counts_in_every_text(spark, tables, tmp_path):
    named = lambda mapping: Romanizer(tables, "xx", context=Context().register_lang("xx", mapping))
    one = named({"é": "E1", "q": "k"})
    assert [one(s) for s in ("que", "qué", "Q", "", "北q", "ق q")] == ["kue", "kuE1", "Q", "", "bei k", "q k"]
    assert [named({"q": "k", "k": "q"})(s) for s in ("qk", "qké")] == ["kq", "kqe"] and named({"q": ""})("aqb") == "ab"
    texts = [None, "", "Ouque une", "éq", "Queso qÉß", "q\nq"]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    documents.to_parquet(tmp_path / "documents.parquet")
    got = {r.doc_id: r.value for r in catalogue.QUERIES["transliterate_registered"](spark, str(tmp_path)).collect()}
    assert got == dict(duckdb.sql(catalogue.ORACLE["transliterate_registered"]).fetchall())


@pytest.mark.parametrize(("text", "lang", "reason"), [
    ("Привет", "ru", "script_default"), ("Київ", "uk", "discriminator"), ("ђак", "sr", "discriminator"), ("گل", "fa", "discriminator"), ("Straße", "de", "latin_discriminator"),
    ("hello", None, "no_detection"), ("สวัสดี", "th", "unambiguous_script"), ("ｓａ", None, "no_detection"),
])
def test_auto_lang(text, lang, reason):
    found = inspect_auto_lang(text)
    assert (found["lang"], found["reason"]) == (lang, reason)


def test_confusables(tables):
    latin = tables.confusables("latin")
    assert K.fold_confusables("раураӏ", latin) == "paypal"
    assert K.fold_confusables("|`\"", latin) == "l'''"
    assert K.fold_confusables("٥٠", tables.confusables("latin", "tr39")) == "o."
    assert K.fold_confusables("٥٠", latin) == "50"
    assert K.is_confusable("pаypal", latin) and not K.is_confusable("paypal", latin)
    assert K.fold_confusables("aceop", tables.confusables("cyrillic")) == "асеор"
    assert K.fold_confusables("paypal", tables.confusables("cyrillic")) == "раураӏ" and K.fold_confusables("ї", latin) == "i"
    assert [K.fold_confusables(c, latin) for c in ("Ιnstagram", "wa││et", "𝚺", "∑")] == ["Instagram", "wallet", "S", "s"]
    assert not any(chr(c).isascii() and chr(c).isalnum() for c in latin)
    missing = K.unmapped_confusables(tables)
    assert not set(map(ord, missing)) & latin.keys()
    assert K.find_unmapped("é" + missing[-1], frozenset(map(ord, missing))) == [(missing[-1], 2)]
    with pytest.raises(ValueError, match="target_script"):
        tables.confusables("greek")


def test_only_sources_are_unmapped(tables):
    """What the Cyrillic table maps is no source of UTS 39 for that."""
    missing = K.unmapped_confusables(tables)
    assert [c for c in missing if c.isascii()] == ["%", "0", "1", "I", "m"]
    assert K.find_unmapped("hello yom", frozenset(map(ord, missing))) == [("m", 8)]


def test_find_unmapped_by_slices(spark, tables):
    missing = K.unmapped_confusables(tables)
    wide, gaps = missing[-1], [*map(ord, missing)]
    texts = [None, "", "zé" + wide + "\U0001F600ß" + wide * 2, "z", "z\U0001F600" + wide]
    want = [None if x is None else K.find_unmapped(x, frozenset(gaps)) for x in texts]
    assert want[2] == [(wide, 3), (wide, 9 + len(wide.encode())), (wide, 9 + 2 * len(wide.encode()))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r.v for r in df.select("id", udfs.find_unmapped_confusables("text").alias("v")).orderBy("id").collect()]
    assert [None if v is None else [tuple(x) for x in v] for v in got] == want
    batch = pa.array([wide * 50_000] * 100)  # five million spans: more than a gigabyte as Python objects
    tracemalloc.start()
    spans = [len(part.values) for part in udfs._unmapped_batches(iter([batch]), gaps)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(spans) == 5_000_000 and max(spans) <= 1_000_000 and peak < 100e6


@pytest.mark.parametrize(("host", "suspicious", "whole"), [
    ("аррӏе.com", True, [True, False]), ("яндекс.ру", True, [False, True]), ("example.com", False, [False, False]), ("[::1]", False, []), ("xn--80ak6aa92e.com", True, [True, False]), ("pаypal.com", True, [False, False]),
])
def test_hostnames(tables, host, suspicious, whole):
    found = security.analyze_hostname(host, tables)
    assert (found["suspicious"], found["label_whole_script_confusable"]) == (suspicious, whole)


def test_hostname_contractions_and_bad_punycode(tables):
    assert security.analyze_hostname("arnazon.com", tables, contractions=True)["canonical"] == "amazon.com"
    assert security.analyze_hostname("arnazon.com", tables)["canonical"] == "arnazon.com"
    assert security.analyze_hostname("xn--\x7f.com", tables)["suspicious"]
    assert security.analyze_hostname("varonis.com.ו.קום", tables)["bidi_conflict"]


@pytest.mark.parametrize(("text", "kinds"), [
    ("paypаl", ["mixed_script"]), ("pay​pal", ["invisible"]), ("a‮b", ["bidi"]), ("h̀́̂̃i", ["zalgo"]), ("abא", ["bidi_mixed"]), ("p4ssw0rd", ["leet"]), ("v.i.a.g.r.a", ["segmentation"]),
    ("the 1st at 5pm", []), ("kΩ", []), ("日本go", []), ("password1", []), ("passw0rds", ["leet"]), ("", []),
])
def test_anomalies(text, kinds):
    lexicon = security.Lexicon.of(["Password", "viagra"])
    found = security.inspect_anomalies(text, lexicon)
    assert found["kinds"] == kinds and found["anomalous"] == bool(kinds) == security.has_anomalies(text, lexicon)
    if kinds:
        one = found["findings"][0]
        assert text.encode()[one["start"] : one["end"]].decode() == one["token"] and found["reason"].startswith('"')


def test_anomaly_spans_are_bytes():
    found = security.inspect_anomalies("é  p4ssw0rd", security.Lexicon.of(["password"]))["findings"][0]
    assert (found["start"], found["end"]) == (4, 12)


@pytest.mark.parametrize(("text", "options", "expected"), [
    ("hello &amp; world", {}, "hello-world"), ("🔥", {"default": "../../etc/passwd"}, "etc-passwd"), ("Hello, World!", {}, "hello-world"), ("Größe", {"lang": "de"}, "groesse"),
    ("one two three", {"max_length": 9}, "one-two-t"), ("one two three", {"max_length": 9, "word_boundary": True}, "one-two"), ("the cat and dog", {"stopwords": ["the", "and"]}, "cat-dog"),
    ("the cat and the dog the", {"stopwords": ["the"], "save_order": True}, "cat-and-the-dog"), ("C++ & c", {"replacements": [("C++", "cpp"), ("&", "and")]}, "cpp-and-c"), ("日本", {"allow_unicode": True}, "日本"),
    ("a_b.c", {"separator": "_"}, "a_b_c"), ("Keep Case", {"lowercase": False}, "Keep-Case"), ("x123y", {"regex_pattern": "[0-9]+"}, "xy"), ("&#65;&#x42;", {}, "ab"), ("", {}, ""),
])
def test_slugify(spark, text, options, expected):
    from glyphmill.functions.tables import load

    assert udfs._slugger(load(spark), **options)(text) == expected


def test_unique_slugger(tables):
    unique = K.UniqueSlugger(K.Slugger(Romanizer(tables, errors="ignore")))
    assert [unique(x) for x in ("a", "a", "a-1", "a", "b")] == ["a", "a-1", "a-1-1", "a-2", "b"]
    unique.reset()
    assert unique("a") == "a"
    taken = K.UniqueSlugger(K.Slugger(Romanizer(tables)), check=lambda s: s == "x")
    assert taken("x") == "x-1"


@pytest.mark.parametrize(("text", "expected"), [
    ("CON.txt", "_CON.txt"), ("a***b.txt", "a_b.txt"), ("../../etc/passwd", None), ("0*.0·", "0.0"), ("a*.b.", "a.b"), ("*.b.", "b"), ("", "_"), ("a*.b", "a.b"),
])
def test_sanitize_filename(tables, text, expected):
    f = lambda s: K.sanitize_filename(s, Romanizer(tables, errors="ignore"))
    once = f(text)
    assert f(once) == once and "/" not in once
    if expected is not None:
        assert once == expected


@QUICK
@given(s=TEXT, platform=st.sampled_from(sorted(K.PLATFORMS)))
def test_filenames_are_safe(tables, s, platform):
    out = K.sanitize_filename(s, Romanizer(tables, errors="ignore"), platform=platform)
    assert out and "/" not in out and "\0" not in out and len(out.encode()) <= 256
    if platform != "posix":
        assert out.split(".")[0].upper() not in K.RESERVED


def test_sanitize_filename_stem_as_its_sql(spark, tmp_path):
    texts = [None, "", " ", ".", "..", "\n. .", "_", "/_", "._", "._.\n", ". _ .\n.x", "_a", "/ _\t_a_ .", "._a", "_.a", "a", "..a..b. ", "é_" * 200, "_" * 300 + "ab ", "a." * 127 + " .b"]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    documents.to_parquet(tmp_path / "documents.parquet")
    got = {r.doc_id: r.value for r in catalogue.QUERIES["sanitize_filename_stem"](spark, str(tmp_path)).collect()}
    assert got == dict(duckdb.sql(catalogue.ORACLE["sanitize_filename_stem"]).fetchall())
    assert got[0] is None and got[1] == got[3] == "" and got[11] == "a"


@pytest.mark.parametrize(("text", "expected"), [("🔥", "fire"), ("😀", "grinning face"), ("a🔥b", "a fire b"), ("👍🏽", "thumbs up: medium skin tone"), ("🇫🇷", "flag: FR"), ("1️⃣", "keycap: 1"), ("☕", "hot beverage"), ("plain", "plain")])
def test_demojize(text, expected):
    assert K.demojize(text) == expected


def test_demojize_options(tables):
    assert K.demojize("🇫🇷🇺🇸", regions=tables.regions) == "flag: France flag: United States"
    assert K.demojize("👍🏽", strip_modifiers=True) == "thumbs up"
    assert K.demojize("x\U0001FC00y") == "xy"
    assert K.demojize("x\U0001FC00y", errors="replace") == "x[?]y"
    assert K.demojize("🔥", provider=lambda cps: "hot" if cps == [0x1F525] else None) == "hot"
    assert K.demojize("🔥", provider=lambda cps: 1 / 0) == "fire"
    with pytest.raises(ValueError):
        K.demojize("x\U0001FC00y", errors="strict")


@pytest.mark.parametrize(("text", "wide", "expected"), [("¡", False, 1), ("¡", True, 2), ("日本", False, 4), ("é", False, 1), ("🔥", False, 2), ("☀️", False, 2), ("☀︎", False, 1), ("🇫🇷", False, 2), ("a\tb", False, 2), ("", False, 0)])
def test_width(text, wide, expected):
    assert K.terminal_width(text, wide) == expected


def test_bytes():
    assert K.decode_to_utf8("é".encode("latin-1"), "latin1") == ("é", False)
    assert K.decode_to_utf8(b"\xef\xbb\xbfa", "latin1") == ("a", False)
    assert K.decode_to_utf8(b"a\xff", "utf-8") == ("a�", True)
    assert K.detect_encoding("Привет мир".encode("cp1251"))[0] == "windows-1251"
    assert K.detect_encoding(b"abc")[0] == "UTF-8"
    for bad in ({"encoding": "utf-8", "strict": True}, {"encoding": "no-such"}, {"min_confidence": 0.99}):
        with pytest.raises(ValueError):
            K.decode_to_utf8(b"a\xff", **bad)
    assert K.scrub_surrogates("a😀b\ud800") == "a😀b�"


@pytest.mark.parametrize(("make", "text", "expected"), [
    (native.escape_html, "it's <b>&", "it&#x27;s &lt;b&gt;&amp;"), (native.strip_log_injection, "a\r\nb\x00c", "a��b�c"), (native.strip_format, "hello\t\tworld", "hello world"),
    (native.strip_bidi, "pass­word", "password"), (lambda c: native.percent_encode(c, "path"), "/a b~é", "/a%20b~%C3%A9"), (lambda c: native.percent_encode(c, "form"), "a b*~", "a+b%2A~"),
    (native.fold_case, "STRASSE ẞ ς", "strasse ss σ"), (lambda c: native.normalize(c, "NFKC"), "ﬁ", "fi"), (native.collapse_whitespace, "　a ⠀b\n", "a b"),
    (lambda c: native.strip_zalgo(c, 1), "à́̂", "à"), (native.strip_tags, "\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F\U000E0041", "\U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F"),
    (lambda c: F.array_join(native.detect_scripts(c), ","), "abя1", "Latin,Cyrillic"), (lambda c: native.strip_log_injection(c, "$1\\", True), "a\tb\n", "a\tb$1\\"), (lambda c: native.grapheme_truncate(c, 1), "éx", "é"),
    (lambda c: native.grapheme_truncate(c, 0), "abc", ""), (native.slugify_ascii, "Hello, World!", "hello-world"), (lambda c: native.slugify_ascii(c, "$"), "Hello, World!", "hello$world"), (lambda c: native.slugify_ascii(c, "\\"), " a b ", "a\\b"),
])
def test_native(spark, make, text, expected):
    assert column(spark, text, make) == expected
    assert column(spark, None, make) is None


@settings(QUICK, max_examples=25)
@given(s=st.text(alphabet=st.characters(exclude_categories=("Cs",), max_codepoint=0x2FFF), max_size=25))
def test_native_and_kernels_agree(spark, s):
    pairs = [(native.collapse_whitespace, K.collapse_whitespace), (native.strip_control_chars, K.strip_control), (native.strip_zero_width_chars, K.strip_zero_width), (native.strip_bidi, K.strip_bidi), (native.strip_invisible, K.strip_invisible)]
    row = spark.createDataFrame([(s,)], "x string").select(*(n("x") for n, _ in pairs), native.detect_scripts("x"), native.has_bidi_conflict("x")).first()
    assert list(row) == [k(s) for _, k in pairs] + [K.detect_scripts(s), K.has_bidi_conflict(s)]


@pytest.mark.parametrize("make", [
    udfs.transliterate, udfs.canonicalize, udfs.search_key, udfs.slugify, udfs.sanitize_filename, udfs.demojize, udfs.normalize_confusables, udfs.is_confusable, udfs.terminal_width, udfs.graphemes,
    udfs.analyze_hostname, udfs.inspect_anomalies, udfs.auto_lang, udfs.find_untranslatable,
])
def test_null_in_null_out(spark, make):
    assert column(spark, None, make) is None


@pytest.mark.parametrize("bad", [
    lambda: native.normalize("x", "NFX"), lambda: native.percent_encode("x", "host"), lambda: native.strip_log_injection("x", "\n"), lambda: native.grapheme_truncate("x", -1), lambda: native.strip_invisible("x", "none"),
    lambda: P.Pipeline(normalize="NFX"), lambda: P.get_pipeline("none"), lambda: metadata.lang_info("none"), lambda: metadata.script_info("none"), lambda: Reverser("fr"),
])
def test_options_are_checked_on_the_driver(spark, bad):
    with pytest.raises(ValueError):
        bad()


def test_pipeline_order():
    p = P.Pipeline(collapse_whitespace=True, fold_case=True, normalize="NFKC", strip_zalgo=True)
    assert [n for n, _ in p.steps] == ["normalize", "strip_zalgo", "fold_case", "strip_control", "strip_zero_width", "collapse_whitespace"]
    assert p.explain().startswith("normalize(NFKC) -> strip_zalgo(2)")
    assert len(P.list_profiles()) == 7


def test_context_dictionaries(tables):
    data = context.dump({"كتب": "كَتَبَ"}, {("من", "كتب"): "كُتُب"})
    r = context.ContextRomanizer(Romanizer(tables), "fa", {"ar": data})
    assert r("كتب") != r("من كتب").split(" ")[1]
    assert r("من. كتب").split(" ")[1] == r("كتب")
    with pytest.raises(context.ContextError, match="context_dict_not_found"):
        context.ContextRomanizer(Romanizer(tables), "he", {})
    with pytest.raises(context.ContextError, match="context_dict_corrupt"):
        context.parse(data[:-3])


def test_sql_registration(spark):
    assert "slugify" in udfs.register(spark)
    assert spark.sql("select slugify('Héllo Wörld') s, canonicalize('раypal') c, detect_scripts('aя') d").first() == ("hello-world", "paypal", ["Latin", "Cyrillic"])
