"""Operators on whole tables: keys, joins, slugs, reports and recovery metrics."""


from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native, udfs
from ..functions.security import Lexicon

#: A side of a join is broadcast only if a count shows no more rows and bytes of values than this.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 << 20


def once_per_value(df: DataFrame, column: str, function: Callable[[Column], Column], name: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with ``name`` = function(column), computed once per distinct value and joined back.

    The distinct values are broadcast if a count shows few short ones; else they are joined by a shuffle. Worth it for columns
    whose values repeat. Null values get null.
    """
    values = df.select(F.col(column).alias("value_")).where("value_ is not null").distinct()
    mapped = values.withColumn(name, function(F.col("value_")))
    counted = values.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("value_")), F.lit(0)).alias("bytes")).first()
    if counted["n"] <= broadcast_rows and counted["bytes"] <= BROADCAST_BYTES:
        mapped = F.broadcast(mapped)
    return df.join(mapped, F.col(column) == F.col("value_"), "left").drop("value_")


def dedup_transliterate(df: DataFrame, column: str, name: str = "transliterated", **options) -> DataFrame:
    return once_per_value(df, column, lambda c: udfs.transliterate(c, **options), name)


def dedup_by_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row for each key, the first in ``order``, and ``group_size``. Sums before the shuffle: a hot key costs one row per task."""
    keyed = df.withColumn("key_", key)
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    return keyed.groupBy("key_").agg(F.min(row).alias("first_"), F.count("*").alias("group_size")).select(F.col("key_").alias("key"), *[F.col(f"first_.{c}").alias(c) for c in df.columns], "group_size")


def key_groups(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(key, n, first_id) of each key."""
    return df.select(key.alias("key"), F.col(id_col).alias("id_")).groupBy("key").agg(F.count("*").alias("n"), F.min("id_").alias("first_id"))


def search_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, how: str = "inner", lang: str | None = None) -> DataFrame:
    """Rows whose search keys are equal; keys are columns first, as they are not deterministic for Catalyst."""
    a = left.withColumn("search_key", udfs.search_key(left_col, lang=lang))
    b = right.withColumn("right_search_key", udfs.search_key(right_col, lang=lang))
    return a.join(b, F.col("search_key") == F.col("right_search_key"), how)


def collated_sort(df: DataFrame, column: str, *ties: str, lang: str | None = None) -> DataFrame:
    return df.withColumn("sort_key", udfs.sort_key(column, lang=lang)).orderBy("sort_key", *ties)


def unique_slugs(df: DataFrame, slug: Column, order: str, separator: str = "-") -> DataFrame:
    """``df`` with ``slug``, unique in the order of ``order``: base, base-1, base-2 and so on.

    All rows of a base are numbered by a window; that is final unless some text's base has the form of another's
    numbered slug. Families of bases that may meet so (one stem before trailing numbers, several bases, and one of them
    more than once) are numbered in order by one task each: equal to a sequential pass, as other families cannot take
    their slugs. Families whose bases all occur once need no numbers, whatever their size.
    """
    rows = df.withColumn("base_", slug)
    stem = F.regexp_replace("base_", rf"({_quoted(separator)}[0-9]+)+$", "")
    rows = rows.withColumn("stem_", F.coalesce(stem, F.lit("")))
    bases = rows.groupBy("stem_", "base_").agg(F.count("*").alias("times_"))
    mixed = bases.groupBy("stem_").agg(F.count("*").alias("bases_"), F.max("times_").alias("times_")).where("bases_ > 1 and times_ > 1").select(F.col("stem_").alias("mixed_"))
    marked = rows.join(mixed, F.col("stem_") == F.col("mixed_"), "left")
    at = F.row_number().over(Window.partitionBy("base_").orderBy(order)) - 1
    simple = marked.where("mixed_ is null").withColumn("slug", F.when(at == 0, F.col("base_")).otherwise(F.concat("base_", F.lit(separator), at.cast("string"))))
    columns = [*df.columns, "slug"]
    schema = simple.select(columns).schema

    def number(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        taken, following, out = set(), {}, []
        for base in pdf["base_"]:
            candidate, n = base, following.get(base, 1)
            while candidate in taken:
                candidate, n = f"{base}{separator}{n}", n + 1
            following[base] = n
            taken.add(candidate)
            out.append(candidate)
        return pdf.assign(slug=out)[columns]

    ordered = marked.where("mixed_ is not null").groupBy("stem_").applyInPandas(number, schema)
    return simple.select(columns).unionByName(ordered)


def _quoted(s: str) -> str:
    import re

    return re.escape(s)


def screen_hosts(df: DataFrame, column: str, contractions: bool = False) -> DataFrame:
    """``df`` with ``host`` (the analysis), ``flagged``: suspicious, or a label other than the last looks Latin as a whole before a Latin top label."""
    out = df.withColumn("host", udfs.analyze_hostname(column, contractions))
    flags = F.col("host.label_whole_script_confusable")
    labels = F.col("host.label_scripts")
    spoof = F.exists(F.slice(flags, 1, F.greatest(F.size(flags) - 1, F.lit(0))), lambda x: x) & F.forall(F.element_at(labels, -1), lambda s: s == "Latin")
    return out.withColumn("flagged", F.when(F.col("host").isNotNull(), F.coalesce(spoof, F.lit(False)) | F.col("host.suspicious")))


def anomaly_report(df: DataFrame, column: str, lexicon: Lexicon | None = None, *carry: str) -> DataFrame:
    """One row per finding: carried columns, kind, token, start, end, detail."""
    return df.select(*carry, F.explode(udfs.inspect_anomalies(column, lexicon)["findings"]).alias("f")).select(*carry, "f.*")


def anomaly_counts(df: DataFrame, column: str, lexicon: Lexicon | None = None) -> DataFrame:
    return anomaly_report(df, column, lexicon).groupBy("kind").agg(F.count("*").alias("n"))


def script_profile(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Number of texts per script, and per cube of the columns ``by``."""
    each = df.select(*by, F.explode(native.detect_scripts(column)).alias("script"))
    return each.cube(*by, "script").agg(F.count("*").alias("n")) if by else each.groupBy("script").agg(F.count("*").alias("n"))


def recovery(df: DataFrame, clean: str, recovered: str) -> DataFrame:
    """Rows, share of exact matches and share of recovered words (as multisets, over all words)."""
    words = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    tagged = lambda c, a, b: F.coalesce(F.transform(words(c), lambda w: F.struct(w.alias("w"), a.alias("a"), b.alias("b"), zero.alias("n"), zero.alias("same"))), none)
    none = F.expr("cast(array() as array<struct<w:string,a:bigint,b:bigint,n:bigint,same:bigint>>)")
    head = F.array(F.struct(F.lit(None).cast("string").alias("w"), zero.alias("a"), zero.alias("b"), one.alias("n"), (F.col(clean) == F.col(recovered)).cast("long").alias("same")))
    each = df.select(F.monotonically_increasing_id().alias("row"), F.concat(head, tagged(clean, one, zero), tagged(recovered, zero, one)).alias("words")).select("row", F.inline("words"))
    counted = each.groupBy("row", "w").agg(*(F.sum(c).alias(c) for c in ("a", "b", "n", "same")))
    return counted.agg(
        F.sum("n").alias("n"), (F.sum("same") / F.sum(F.when(F.col("same").isNotNull(), F.col("n")))).alias("xmr"), (F.sum(F.least("a", "b")) / F.sum("a")).alias("word_recovery")
    ).withColumn("n", F.coalesce("n", zero))


def _word_edits(reference: str, output: str) -> int:
    x, y = reference.split(), output.split()
    row = list(range(len(y) + 1))
    for i, w in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (w != v))
    return row[-1]


def cer_wer(df: DataFrame, reference: str, output: str) -> DataFrame:
    """Character and word error rate, micro-averaged: edits over the reference's characters and words."""

    @F.pandas_udf("long")
    def edits(references: pd.Series, outputs: pd.Series) -> pd.Series:
        return pd.Series([_word_edits(a, b) for a, b in zip(references, outputs, strict=True)], dtype="int64")

    rows = df.where(F.col(reference).isNotNull() & F.col(output).isNotNull())
    return rows.agg(
        (F.sum(F.levenshtein(reference, output)) / F.sum(F.length(reference))).alias("cer"),
        (F.sum(edits(reference, output)) / F.sum(F.size(F.filter(F.split(reference, r"\s+"), lambda w: w != "")))).alias("wer"),
    )


def miss_mining(df: DataFrame, column: str, known: DataFrame, top: int = 50) -> DataFrame:
    """The most frequent characters outside ASCII that ``known(src)`` does not map: (ch, n)."""
    each = df.select(F.explode(F.split(F.regexp_replace(column, r"[\x00-\x7F]+", ""), "")).alias("ch")).where("ch != ''").groupBy("ch").agg(F.count("*").alias("n"))
    return each.join(known, F.col("ch") == F.col("src"), "left_anti").orderBy(F.desc("n"), "ch").limit(top)
