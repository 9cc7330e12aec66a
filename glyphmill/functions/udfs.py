"""Column functions that need a scanner: Arrow-batched UDFs around ``kernels``.

Each factory fixes its options when the column is built, checks them on the driver, and carries an
immutable snapshot of its tables in the closure. Null maps to null. ASCII texts, where an operation
leaves those as they are, return early inside the kernel, as a guard outside would not keep a UDF
from running on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import presets as P
from . import kernels as K
from . import native, registry, security
from .context import ContextRomanizer, load_dictionaries
from .errors import UnsupportedError
from .tables import Tables, load
from .translit import Context, Reverser, Romanizer, inspect_auto_lang

SPAN = T.ArrayType(T.StructType([T.StructField("ch", T.StringType()), T.StructField("byte_offset", T.IntegerType())]))
STRINGS = T.ArrayType(T.StringType())
AUTO_LANG = T.StructType([T.StructField("script", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("discriminators", STRINGS)])
HOSTNAME = T.StructType([
    T.StructField("suspicious", T.BooleanType()), T.StructField("scripts", STRINGS), T.StructField("mixed_script", T.BooleanType()), T.StructField("has_confusables", T.BooleanType()),
    T.StructField("bidi_conflict", T.BooleanType()), T.StructField("cross_label_script", T.BooleanType()), T.StructField("label_scripts", T.ArrayType(STRINGS)),
    T.StructField("whole_script_confusable", T.BooleanType()), T.StructField("label_whole_script_confusable", T.ArrayType(T.BooleanType())), T.StructField("canonical", T.StringType()),
])
FINDING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("detail", T.StringType())])
ANOMALIES = T.StructType([T.StructField("anomalous", T.BooleanType()), T.StructField("kinds", STRINGS), T.StructField("findings", T.ArrayType(FINDING)), T.StructField("reason", T.StringType())])
DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("had_errors", T.BooleanType())])
DETECTED = T.StructType([T.StructField("encoding", T.StringType()), T.StructField("confidence", T.DoubleType())])


def _session(spark: SparkSession | None) -> SparkSession:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("there is no active Spark session")
    return spark


def vectorised(kernel: Callable, returns) -> Callable[[Column | str], Column]:
    """A kernel on one value as a UDF on Arrow batches."""
    struct = isinstance(returns, T.StructType)

    def on_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else kernel(x) for x in batch], dtype=object)

    def on_structs(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = returns.names
        for batch in batches:
            rows = [dict.fromkeys(names) if x is None else kernel(x) for x in batch]
            yield pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})

    if struct:
        on_structs.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        inner = F.pandas_udf(on_structs, returns)
    else:
        on_batches.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        inner = F.pandas_udf(on_batches, returns)

    def apply(c: Column | str) -> Column:
        col = F.col(c) if isinstance(c, str) else c
        # A struct of nulls becomes null where the input is.
        return F.when(col.isNotNull(), inner(col)) if struct else inner(col)

    apply.udf = inner
    return apply


def _takes_tables(build):
    """A factory (tables, options) -> (kernel, type) as a column function (column, options, spark)."""

    @wraps(build)
    def function(c: Column | str, *args, spark: SparkSession | None = None, **options) -> Column:
        kernel, returns = build(load(_session(spark)), *args, **options)
        return vectorised(kernel, returns)(c)

    return function


TEXT, FLAG, COUNT = T.StringType(), T.BooleanType(), T.IntegerType()


@_takes_tables
def transliterate(tables: Tables, lang: str | None = None, errors: str = "replace", replace_with: str = "[?]", strict_iso9: bool = False, gost7034: bool = False, tones: bool = False,
                  target: str | None = None, context: Context | None = None):
    """Romanise, or with ``target`` (el, ru, uk) the way back from ASCII."""
    if target is not None:
        if lang or strict_iso9 or gost7034 or tones or errors != "replace":
            raise ValueError("target excludes the options of the forward direction")
        return Reverser(target), TEXT
    return Romanizer(tables, lang, errors, replace_with, strict_iso9, gost7034, tones, context or registry.snapshot()), TEXT


@_takes_tables
def transliterate_in_context(tables: Tables, lang: str, dictionaries: dict[str, bytes] | None = None):
    """Romanise Arabic, Persian or Hebrew by a dictionary of word forms; without ``dictionaries`` they are read from ``$GLYPHMILL_DICT_DIR``."""
    if lang not in ("ar", "fa", "he"):
        raise UnsupportedError(f"no context for {lang!r}")
    return ContextRomanizer(Romanizer(tables, lang, context=registry.snapshot()), lang, load_dictionaries() if dictionaries is None else dictionaries), TEXT


@_takes_tables
def find_untranslatable(tables: Tables, lang: str | None = None, **options):
    romanizer = Romanizer(tables, lang, **options)
    return lambda s: [{"ch": c, "byte_offset": at} for c, at in romanizer.untranslatable(s)], SPAN


@_takes_tables
def unidecode(tables: Tables, errors: str = "ignore", replace_str: str = "?"):
    return Romanizer(tables, None, errors, replace_str), TEXT


@_takes_tables
def normalize_confusables(tables: Tables, target_script: str = "latin", digit_policy: str = "numeric"):
    table = tables.confusables(target_script, digit_policy)
    return lambda s: K.fold_confusables(s, table), TEXT


@_takes_tables
def is_confusable(tables: Tables, target_script: str = "latin"):
    table = tables.confusables(target_script)
    return lambda s: K.is_confusable(s, table), FLAG


#: Bytes of text whose hits are held at once.
PIECE_BYTES = 1 << 20


def _pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """``texts`` in slices of whole rows, of about ``limit`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    stops = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for begin, stop in zip([0, *stops], stops, strict=False):
        yield texts.slice(begin, stop - begin)


def _unmapped_spans(texts: pa.Array, missing: np.ndarray) -> pa.Array:
    """``kernels.find_unmapped`` on a column, by arrays; ``missing`` says it for each code point."""
    filled = pc.fill_null(texts.cast(pa.string()), "")
    _, ends, data = filled.buffers()
    ends = np.frombuffer(ends, np.int32)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int32)
    data = bytes(data[int(ends[0]) : int(ends[-1])]) if data else b""
    ends = ends - ends[0]
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    hit = missing[points]
    at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[hit].astype(np.int32)
    found = points[hit]
    rows = np.searchsorted(at, ends).astype(np.int32)
    widths = 1 + (found > 0x7F).astype(np.int32) + (found > 0x7FF) + (found > 0xFFFF)
    chars = pa.StringArray.from_buffers(len(found), pa.py_buffer(np.concatenate(([0], np.cumsum(widths))).astype(np.int32)), pa.py_buffer(found.tobytes().decode("utf-32-le").encode()))
    spans = pa.StructArray.from_arrays([chars, pa.array(at - np.repeat(ends[:-1], np.diff(rows)), pa.int32())], names=["ch", "byte_offset"])
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), spans, mask=texts.is_null())


def _unmapped_batches(batches: Iterator[pa.Array], gaps: list[int]) -> Iterator[pa.Array]:
    missing = np.zeros(0x110000, bool)
    missing[gaps] = True
    for batch in batches:
        for piece in _pieces(batch):
            yield _unmapped_spans(piece, missing)


def find_unmapped_confusables(c: Column | str, target_script: str = "latin", spark: SparkSession | None = None) -> Column:
    """Confusable characters that the target's table does not map. Any character of a text may be one, so the spans stay in Arrow and go out by slices."""
    gaps = sorted(map(ord, K.unmapped_confusables(load(_session(spark)), target_script)))

    def on_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _unmapped_batches(batches, gaps)

    on_batches.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(on_batches, SPAN)(F.col(c) if isinstance(c, str) else c)


@_takes_tables
def apply_preset(tables: Tables, name: str, **options):
    return P.preset(name, tables, **options), TEXT


def _named(name: str):
    def function(c: Column | str, **options) -> Column:
        return apply_preset(c, name, **options)

    function.__name__ = name
    function.__doc__ = f"The preset {name}: " + ", ".join(step for step, _ in P.PRESETS[P.ALIASES.get(name, name)]) + "."
    return function


canonicalize, canonicalize_strict, strip_obfuscation = map(_named, ("canonicalize", "canonicalize_strict", "strip_obfuscation"))
ml_normalize, catalog_key, search_key, sort_key = map(_named, ("ml_normalize", "catalog_key", "search_key", "sort_key"))
security_clean, normalize_user_input = map(_named, ("security_clean", "normalize_user_input"))


@_takes_tables
def apply_pipeline(tables: Tables, pipeline: P.Pipeline | str):
    """A pipeline, or the named profile, on a column."""
    return (P.get_pipeline(pipeline) if isinstance(pipeline, str) else pipeline).kernel(tables), TEXT


@_takes_tables
def analyze_hostname(tables: Tables, contractions: bool = False):
    return lambda s: security.analyze_hostname(s, tables, contractions), HOSTNAME


def is_mixed_script(c: Column | str) -> Column:
    return F.size(native.detect_scripts(c)) > 1


def is_suspicious_hostname(c: Column | str, contractions: bool = False) -> Column:
    return analyze_hostname(c, contractions)["suspicious"]


def _slugger(tables: Tables, lang: str | None = None, **options) -> K.Slugger:
    return K.Slugger(Romanizer(tables, lang, "ignore", ""), **options)


@_takes_tables
def slugify(tables: Tables, lang: str | None = None, **options):
    """Options as of ``kernels.Slugger``, and the language."""
    return _slugger(tables, lang, **options), TEXT


class Slugifier:
    """``slugify`` with its options fixed: ``Slugifier(separator="_")("name")``."""

    def __init__(self, **options):
        self.options = options

    def __call__(self, c: Column | str) -> Column:
        return slugify(c, **self.options)


def unique_slugifier(spark: SparkSession, check: Callable[[str], bool] | None = None, lang: str | None = None, **options) -> K.UniqueSlugger:
    """Unique slugs of single strings, in the order of the calls, on the driver; for tables see ``operators.datasets.unique_slugs``."""
    return K.UniqueSlugger(_slugger(load(spark), lang, **options), check)


# Shims with other names for the same options.
def slugify_compat(c, *, to_lower: bool = False, max_length: int = 0, separator: str = "-", capitalize: bool = False, stop_words=(), safe_chars: str = "", pretranslate=(), lang: str | None = None) -> Column:
    out = slugify(c, lang=lang, lowercase=to_lower, max_length=max_length, separator=separator, stopwords=tuple(stop_words), safe_chars=safe_chars, replacements=tuple(pretranslate), word_boundary=bool(max_length))
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, F.lit(2), F.length(out))) if capitalize else out


def slugify_url(c, **options) -> Column:
    return slugify(c, **({"stopwords": ("a", "an", "and", "in", "of", "or", "the", "to"), "max_length": 200} | options))


def slugify_filename(c, **options) -> Column:
    return slugify(c, **({"separator": "_", "safe_chars": "-.", "max_length": 255, "lowercase": False} | options))


def slugify_unicode(c, **options) -> Column:
    return slugify(c, allow_unicode=True, **options)


def slugify_ru(c, **options) -> Column:
    return slugify(c, lang="ru", **options)


def slugify_de(c, **options) -> Column:
    return slugify(c, lang="de", **options)


def slugify_el(c, **options) -> Column:
    return slugify(c, lang="el", **options)


@_takes_tables
def sanitize_filename(tables: Tables, separator: str = "_", max_length: int = 255, platform: str = "universal", lang: str | None = None, preserve_extension: bool = True, default: str = "_"):
    if platform not in K.PLATFORMS:
        raise ValueError(f"platform must be one of {', '.join(K.PLATFORMS)}; got {platform!r}")
    romanizer = Romanizer(tables, lang, "ignore", "")
    return lambda s: K.sanitize_filename(s, romanizer, separator, max_length, platform, preserve_extension, default), TEXT


@_takes_tables
def demojize(tables: Tables, strip_modifiers: bool = False, errors: str = "ignore", replace_with: str = "[?]", provider=None):
    K.demojize("é", strip_modifiers, errors, replace_with)  # checks the options
    provider, regions = provider or registry.emoji_provider(), tables.regions
    return lambda s: K.demojize(s, strip_modifiers, errors, replace_with, provider, regions), TEXT


def inspect_anomalies(c, lexicon: security.Lexicon | None = None) -> Column:
    words = lexicon or security.Lexicon()
    return vectorised(lambda s: security.inspect_anomalies(s, words), ANOMALIES)(c)


def has_anomalies(c, lexicon: security.Lexicon | None = None) -> Column:
    words = lexicon or security.Lexicon()
    return vectorised(lambda s: security.has_anomalies(s, words), FLAG)(c)


def auto_lang(c) -> Column:
    return vectorised(inspect_auto_lang, AUTO_LANG)(c)


def terminal_width(c, ambiguous_wide: bool = False) -> Column:
    return vectorised(lambda s: K.terminal_width(s, ambiguous_wide), COUNT)(c)


def grapheme_width(c, ambiguous_wide: bool = False) -> Column:
    return vectorised(lambda s: K.grapheme_width(s, ambiguous_wide), COUNT)(c)


def graphemes(c) -> Column:
    """Extended grapheme clusters by the rules of the installed regex library (newer than the JVM's)."""
    return vectorised(K.graphemes, STRINGS)(c)


def detect_encoding(c) -> Column:
    return vectorised(lambda b: dict(zip(("encoding", "confidence"), K.detect_encoding(bytes(b)), strict=True)), DETECTED)(c)


def decode_to_utf8(c, encoding: str | None = None, min_confidence: float = 0.0, strict: bool = False) -> Column:
    return vectorised(lambda b: dict(zip(("text", "had_errors"), K.decode_to_utf8(bytes(b), encoding, min_confidence, strict), strict=True)), DECODED)(c)


def register(spark: SparkSession) -> list[str]:
    """All scalar functions under their names for SQL, with default options; returns the names."""
    tables = load(spark)
    kernels = {
        "transliterate": (Romanizer(tables), TEXT), "unidecode": (Romanizer(tables, None, "ignore"), TEXT), "normalize_confusables": (lambda s: K.fold_confusables(s, tables.latin), TEXT),
        "is_confusable": (lambda s: K.is_confusable(s, tables.latin), FLAG), "slugify": (_slugger(tables), TEXT), "sanitize_filename": (lambda s: K.sanitize_filename(s, Romanizer(tables, None, "ignore", "")), TEXT),
        "demojize": (lambda s: K.demojize(s, regions=tables.regions), TEXT), "terminal_width": (K.terminal_width, COUNT), "graphemes": (K.graphemes, STRINGS), "detect_scripts": (K.detect_scripts, STRINGS),
        "has_bidi_conflict": (K.has_bidi_conflict, FLAG), "strip_accents": (K.strip_accents, TEXT), "strip_zalgo": (K.strip_zalgo, TEXT), "is_zalgo": (K.is_zalgo, FLAG),
        "collapse_whitespace": (K.collapse_whitespace, TEXT), "strip_bidi": (K.strip_bidi, TEXT), "inspect_auto_lang": (inspect_auto_lang, AUTO_LANG),
        "analyze_hostname": (lambda s: security.analyze_hostname(s, tables), HOSTNAME), "inspect_anomalies": (lambda s: security.inspect_anomalies(s, security.Lexicon()), ANOMALIES),
    } | {name: (P.preset(name, tables), TEXT) for name in P.PRESETS}
    for name, (kernel, returns) in kernels.items():
        spark.udf.register(name, vectorised(kernel, returns).udf)
    return sorted(kernels)
