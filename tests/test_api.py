"""Public names, registry and builders."""

import pytest
from pyspark.sql import functions as F

from glyphmill import api
from glyphmill.functions import context, registry
from glyphmill.functions.translit import Context


@pytest.fixture
def clean():
    yield
    registry._state.update(context=Context(), provider=None)


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).first()[0]


def test_registry_is_taken_when_a_column_is_built(spark, clean):
    api.register_lang("xx", {"ы": "Q"})
    api.register_replacements({"foo": "bar"})
    column = api.transliterate("x", lang="xx")
    api.clear_replacements()
    df = spark.createDataFrame([("foo ы",)], "x string")
    assert df.select(column, api.transliterate("x", lang="xx")).first()[:] == ("bar Q", "foo Q")
    api.set_emoji_provider(lambda cps: "hot" if cps == [0x1F525] else None)
    assert one(spark, "🔥", api.demojize) == "hot"
    api.seal_registrations()
    assert api.registrations_sealed()
    for change in (lambda: api.register_lang("yy", {}), lambda: api.set_emoji_provider(None), lambda: api.remove_replacement("foo")):
        with pytest.raises(RuntimeError):
            change()


def test_limits(clean):
    with pytest.raises(api.ResourceLimitError):
        api.register_replacements({str(k): "x" for k in range(10_001)})
    with pytest.raises(api.InvalidArgumentError):
        api.register_replacements({"": "x"})


def test_batches(spark, clean):
    assert api.dedup_batch(spark, ["é", "é", "ü"]) == ["e", "e", "u"]
    cached = api.make_cached_transliterator(spark)
    assert cached("é") == "e"
    api.register_replacements({"é": "E!"})
    assert cached("é") == "E!"


def test_context_column(spark, tmp_path, monkeypatch):
    data = context.dump({"كتب": "كَتَبَ"}, {})
    assert one(spark, "كتب", lambda c: api.transliterate_in_context(c, "ar", {"ar": data})) == "kataba"
    (tmp_path / "ar.bin").write_bytes(data)
    monkeypatch.setenv("GLYPHMILL_DICT_DIR", str(tmp_path))
    assert one(spark, "كتب", lambda c: api.transliterate_in_context(c, "fa")) == one(spark, "كَتَبَ", lambda c: api.transliterate(c, lang="fa"))
    monkeypatch.setenv("GLYPHMILL_DICT_DIR", "relative")
    with pytest.raises(context.ContextError, match="context_dict_not_found"):
        api.transliterate_in_context("x", "ar")
    with pytest.raises(api.UnsupportedError):
        api.transliterate_in_context("x", "de")


def test_slug_builders(spark):
    assert one(spark, "Hello World", api.Slugifier(separator="_")) == "hello_world"
    assert one(spark, "hello world", lambda c: api.Slugify(c, capitalize=True, to_lower=True)) == "Hello-world"
    unique = api.UniqueSlugifier(spark, check=lambda s: s == "a")
    assert [unique("a"), unique("a")] == ["a-1", "a-2"]


def test_metadata(spark):
    assert api.LANG_DE == "de" and api.NF.KC == "NFKC" and api.Script.LATIN == "Latin" and api.Component.FORM == "form"
    assert api.lang_meta(spark).count() == len(api.list_langs()) == len(api.LANG_META) and api.script_meta(spark).count() == len(api.SCRIPT_META)
    assert api.lang_info("sr")["script"] == "Cyrillic" and api.script_info("Hebrew")["rtl"]
    assert set(api.list_context_langs()) == {"ar", "fa", "he"} and api.reverse_langs() == ["el", "ru", "uk"]


def test_fluent_builder(spark):
    row = spark.createDataFrame([(" Pаypаl ",)], "x string").select(api.Text("x").canonicalize().fold_case().value, api.Text("x").has_bidi_conflict(), api.Text("x").is_confusable()).first()
    assert row[:] == ("paypal", False, True)
