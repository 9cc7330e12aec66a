"""Host-level quality rules, in DataFrame operations only.

Every document is measured by itself first. The share of a host's documents that fail a rule is
then shrunk towards all hosts' share with a beta prior whose two parameters are fitted to the hosts
by moments, so that a host with few documents is not condemned by them. The verdict on a host is
joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import barrier, cut, fresh, others, small, words

#: Base rules: a document fails with fewer words, or with a larger share (%) of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Soft rules: shares (%) of symbols among word characters and of repeated lines among lines with a word, mean word length.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT, WORD_LENGTH = 5, 30, (2, 15)
#: A host whose shrunk failure rate is above the first is watched, above the second blocked.
WATCH, BLOCK = 0.25, 0.6
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, not once per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _joined(hashes: Column, apart: int) -> Column:
    """Each hash joined with the one ``apart`` places after it."""
    return _let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + apart))))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``window`` words found twice or more in the same array."""
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    n = F.size(words)
    # A window's hash is that of its halves' hashes, so a word is hashed once and not once per window.
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    half = 1
    while half < window:
        hashed = _joined(hashed, half)
        half *= 2
    windows = F.when(n >= window, F.slice(hashed, F.lit(1), n - (window - 1))).otherwise(F.expr("cast(array() as array<bigint>)"))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(ordered, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
            lambda acc, p: F.struct((p + window).alias("end"), (acc["total"] + p + window - F.greatest(acc["end"], p)).alias("total")),
            lambda acc: acc["total"],
        )

    return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the six measures (they replace columns of the same names); null text measures as empty."""
    (w,) = fresh([*docs.columns, *MEASURES], "words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    return (
        docs.withColumn(w, words(text_col))
        .select(
            *others(docs, *MEASURES),
            barrier(F.size(w).cast("long")).alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col(w)).alias("n_repeat_words"),
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def soft_failed() -> Column:
    mean = F.try_divide(F.col("word_chars"), F.col("n_words"))
    return F.coalesce(
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
        | (mean < WORD_LENGTH[0])
        | (mean > WORD_LENGTH[1]),
        F.lit(False),
    )


def host_verdicts(measured: DataFrame, host_col: str = "source") -> DataFrame:
    """One row per host: documents, failures, prior, shrunk rate and verdict (trusted, watched, blocked).

    The prior beta(a, b) has the hosts' mean failure rate m (over documents) and their variance v:
    a + b = m (1 - m) / v - 1, kept between 1 and 10,000; where the hosts do not differ, 10,000.
    A null host is a host of its own.
    """
    failed = (base_failed() | soft_failed()).cast("long")
    hosts = cut(measured.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(failed).alias("n_failed")))
    # One row reaches the driver.
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("q")).first()
    n, m = (total["n"] or 0), (total["f"] / total["n"] if total["n"] else 0.0)
    v = max(0.0, total["q"] / n - m * m) if n else 0.0
    strength = min(1e4, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1e4
    rate = (F.col("n_failed") + m * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("host_rate", rate).withColumn(
        "host_verdict", F.when(F.col("host_rate") > BLOCK, F.lit("blocked")).when(F.col("host_rate") > WATCH, F.lit("watched")).otherwise(F.lit("trusted"))
    )


def apply_rules(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Every document with its measures, ``base_failed``, ``host_rate``, ``host_verdict`` and ``kept``.

    A document is rejected if it fails a base rule, if its host is blocked, or if its host is
    watched and it fails a soft rule itself. Hosts with a normal share of failures thus lose only
    what fails a base rule.

    ``carry`` names columns to keep beside the result. With narrow columns (no text) the measures
    are cut, and texts are read and measured once; with all columns (None) they are measured twice,
    which costs less disk than a copy of the texts.

    Null text: no words, fails. Null host: a host of its own. Repeated rows are separate documents.
    Empty table: no rows. Columns called like a result are replaced.
    """
    own = (*MEASURES, "base_failed", "host_rate", "host_verdict", "kept")
    keep = [c for c in docs.columns if (carry is None or c in carry) and c.lower() not in own]
    host, of_host = fresh([*docs.columns, *own], "rule_host", "verdict_host")
    measured = measure(docs.withColumn(host, F.col(host_col)), text_col).select(*[F.col(f"`{c}`") for c in keep], host, *MEASURES)
    if carry is not None and text_col not in keep:
        measured = cut(measured)
    verdicts = cut(host_verdicts(measured, host).select(F.col("host").alias(of_host), "host_rate", "host_verdict"))
    # Only hosts that are not trusted need a row on the other side; a host's documents are the skewed side.
    off = verdicts.filter("host_verdict != 'trusted'")
    rates = small(verdicts) if carry is not None else small(off)
    joined = measured.join(rates, F.col(host).eqNullSafe(F.col(of_host)), "left")
    verdict = F.coalesce(F.col("host_verdict"), F.lit("trusted"))
    failed = base_failed()
    kept = ~failed & (verdict != "blocked") & ~((verdict == "watched") & soft_failed())
    return joined.select(
        *[F.col(f"`{c}`") for c in keep], *MEASURES, failed.alias("base_failed"), F.col("host_rate"), verdict.alias("host_verdict"), kept.alias("kept")
    )
