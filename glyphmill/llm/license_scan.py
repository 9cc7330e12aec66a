"""Licences in texts, by the Dice coefficient over word bigrams; DataFrame operations only.

A unit (a line of a text, a paragraph, or the whole text) and a template are normalised alike: lower case, runs
of anything but letters and digits are one space. With A and B their sets of word bigrams, Dice is
2 |A and B| / (|A| + |B|). As |A and B| is at most the smaller size, a coefficient of t or more needs
t / (2 - t) <= |A| / |B| <= (2 - t) / t: templates outside these bounds are not compared.

A licence within a longer line, or in a comment block whose empty lines hold a mark, is no such unit. So runs of words of
the whole text are units too: from a bigram of the template to another, no longer than the bounds allow. As a match has
at least t / (2 - t) of the template's bigrams, texts without any of a few fixed ones of each template (``anchors``) hold no
licence and are not searched.

Dice cannot tell "version 2" from "version 3", nor "not licensed" from "licensed". So a match is refused unless unit and template agree
in the words that change which licence it is (``MARKS``), the unit has all of the template's version numerals, and no negation stands
among the three words before a run.

All is done within a row: no join, no shuffle. Templates are a fixed table of a few kilobytes.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_templates import TEMPLATES

THRESHOLD = 0.8

# Words that change which licence a text names, or that it does; a unit and a template have words of the same groups.
MARKS = (
    ("noncommercial", "commercial", "nc"), ("noderivatives", "noderivs", "derivatives", "nd"), ("sharealike", "alike", "sa"), ("lesser", "library", "lgpl"), ("affero", "agpl"),
    ("neither",), ("not", "never", "cannot", "isn", "wasn", "aren"),
)
NEGATIONS = MARKS[-1]


def _plain_bigrams(text: str) -> list[str]:
    words = re.findall(r"[0-9a-z]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _marks(text: str) -> int:
    words = set(re.findall(r"[0-9a-z]+", text.lower()))
    return sum(1 << k for k, group in enumerate(MARKS) if words & set(group))


def _numerals(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<![0-9a-z])[0-9](?![0-9a-z])", text.lower())))


def agrees(template: Column, words: Column) -> Column:
    """Whether a unit of these words may be what the template names."""
    marked = lambda group: F.arrays_overlap(words, F.array(*map(F.lit, group))).cast("int")
    marks = sum((marked(group) * (1 << k) for k, group in enumerate(MARKS)), F.lit(0))
    return (marks == template["marks"]) & (F.size(F.array_except(template["numerals"], words)) == 0)


def _least(size: int, threshold: float) -> int:
    """Number of a template's bigrams that a unit must share to reach the threshold."""
    return max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9))


def _templates(templates, threshold: float) -> Column:
    # As one SQL expression: building hundreds of literals one by one takes seconds.
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = []
    for k, (name, form, text) in enumerate(templates):
        grams = _plain_bigrams(text)
        listed = f"array({', '.join(map(quoted, grams))})" if grams else "cast(array() as array<string>)"
        least, most = _least(len(grams), threshold), int(len(grams) * (2 - threshold) / threshold)
        numerals = f"cast(array({', '.join(map(quoted, _numerals(text)))}) as array<string>)"
        rows.append(f"named_struct('k', {k}, 'license', {quoted(name)}, 'form', {quoted(form)}, 'n', {len(grams)}, 'grams', {listed}, 'least', {least}, 'most', {most}, 'marks', {_marks(text)}, 'numerals', {numerals})")
    return F.expr(f"array({', '.join(rows)})")


def _pattern(grams: list[str], between: str) -> str:
    """Pattern of any of the bigrams, grouped by first letter, so that most words are passed over after a comparison of few letters."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b in map(str.split, sorted(set(grams))):
        tree.setdefault(a[0], {}).setdefault(a[1:], []).append(b)
    return "(?:" + "|".join(f"{x}(?:{'|'.join(f'{a}{between}(?:{"|".join(seconds)})' for a, seconds in rest.items())})" for x, rest in tree.items()) + ")"


def anchors(templates, threshold: float) -> str:
    """Pattern that the lower-case text of any match fits: of each template, one bigram more than a match can lack, those of long words first."""
    chosen: list[str] = []
    for _, _, text in templates:
        grams = sorted(_plain_bigrams(text), key=lambda g: (min(map(len, g.split())), len(g), g), reverse=True)
        chosen += grams[: len(grams) - _least(len(grams), threshold) + 1]
    return f"(?<![0-9a-z]){_pattern(chosen, '[^0-9a-z]+')}(?![0-9a-z])"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(unit: Column, templates: Column, low: int, high: int, threshold: float) -> Column:
    """Templates that reach the threshold for one normalised unit, best first: array of {dice, k, license, form}.

    ``low`` and ``high`` bound the numbers of bigrams that any template can match.
    """
    none = F.expr("cast(array() as array<struct<dice:double,k:int,license:string,form:string>>)")
    words = F.split(unit, " ")

    def compare(grams: Column, w: Column) -> Column:
        n = F.size(grams)
        near = F.filter(templates, lambda t: (n <= t["n"] * ((2 - threshold) / threshold)) & (n >= t["n"] * (threshold / (2 - threshold))))
        scored = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(grams, t["grams"])) / (n + t["n"])).alias("dice"), t["k"], t["license"], t["form"]))
        enough = F.filter(scored, lambda x: x["dice"] <= -threshold)
        good = F.sort_array(F.filter(enough, lambda x: agrees(F.get(templates, x["k"]), w)))
        return F.transform(good, lambda x: F.struct((-x["dice"]).alias("dice"), x["k"], x["license"], x["form"]))

    def pairs(w: Column) -> Column:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.slice(w, i, F.lit(2)), " ")))
        return _let(grams, lambda g: F.when((F.size(g) >= low) & (F.size(g) <= high), compare(g, w)).otherwise(none))

    # A set of bigrams has no more members than the unit has words, less one, and no fewer than it has different words, less one.
    return _let(words, lambda w: F.when((F.size(w) > low) & (F.size(F.array_distinct(w)) <= high + 1), pairs(w)).otherwise(none))


def runs(text: Column, templates: Column, grams: list[str], threshold: float) -> Column:
    """Runs of words of a normalised text that reach the threshold: array of {dice, k, at, end, license, form}, none overlapping a better one.

    ``grams`` are all templates' bigrams. For each start, the end is the one that is best when no bigram repeats
    within the run; the coefficient is then that of the sets. ``at`` and ``end`` count bigrams from 0.
    """
    kind = "array<struct<dice:double,k:int,at:int,end:int,license:string,form:string>>"

    def of_template(t: Column, w: Column, pairs: Column, hits: Column) -> Column:
        def scored(h: Column) -> Column:
            # Hit j and hit j + least - 1 must lie within a run of the greatest length.
            starts = F.filter(F.transform(h, lambda x, j: F.struct(x["i"].alias("i"), j.alias("j"))), lambda x: F.get(h, x["j"] + t["least"] - 1)["i"] - x["i"] < t["most"])

            def run(x: Column) -> Column:
                ends = F.transform(F.slice(h, x["j"] + t["least"], t["most"]), lambda y, d: F.struct((2.0 * (d + t["least"]) / (y["i"] - x["i"] + 1 + t["n"])).alias("e"), (-y["i"]).alias("end")))
                end = -F.array_max(F.filter(ends, lambda y: -y["end"] - x["i"] < t["most"]))["end"]
                return _let(end, lambda e: _let(F.array_distinct(F.slice(pairs, x["i"] + 1, e - x["i"] + 1)), lambda own: F.struct(
                    (-2.0 * F.size(F.array_intersect(own, t["grams"])) / (F.size(own) + t["n"])).alias("dice"), t["k"], x["i"].alias("at"), e.alias("end"), t["license"], t["form"])))

            def stands(r: Column) -> Column:
                before = F.slice(w, F.greatest(r["at"] - 2, F.lit(1)), F.least(r["at"], F.lit(3)))
                return agrees(t, F.slice(w, r["at"] + 1, r["end"] - r["at"] + 2)) & ~F.arrays_overlap(before, F.array(*map(F.lit, NEGATIONS)))

            return F.filter(F.filter(F.transform(starts, run), lambda r: r["dice"] <= -threshold), stands)

        return _let(F.filter(hits, lambda x: F.array_contains(t["grams"], x["g"])), scored)

    def found(w: Column, pairs: Column) -> Column:
        hits = F.filter(F.transform(pairs, lambda g, i: F.struct(i.alias("i"), g.alias("g"))), lambda x: x["g"].rlike(f"^{_pattern(grams, ' ')}$"))
        best = F.sort_array(_let(hits, lambda h: F.flatten(F.transform(templates, lambda t: of_template(t, w, pairs, h)))))
        return F.aggregate(best, F.expr(f"cast(array() as {kind})"), lambda taken, r: F.when(F.exists(taken, lambda o: (o["at"] <= r["end"]) & (r["at"] <= o["end"])), taken).otherwise(F.concat(taken, F.array(r))))

    words = F.split(text, " ")
    pairs = lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    return F.transform(
        _let(words, lambda w: F.when(F.size(w) > 1, _let(pairs(w), lambda p: found(w, p))).otherwise(F.expr(f"cast(array() as {kind})"))),
        lambda r: F.struct((-r["dice"]).alias("dice"), r["k"], r["at"], r["end"], r["license"], r["form"]),
    )


def normalised(text: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces between words."""
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))


def scan(docs: DataFrame, *, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """Every document with the licences that its lines, its paragraphs, its whole text or runs of its words match.

    Adds ``licenses``, sorted distinct SPDX identifiers; ``license_spans``, one struct {unit, number,
    license, form, dice} per matching unit with its best template (unit: line, paragraph, text or words;
    numbers from 1, of a run of words that of its first); runs are given for licences that no other unit matches; ``license_dice``, the best coefficient (0: no match). Paragraphs are parted by
    blank lines, so a grant that is wrapped over lines matches as one. A text of one paragraph or
    one line is not compared again as such. Columns of these names are replaced;
    ``carry`` names the columns to keep (default: all). Ties between templates go to the one that
    stands first.

    Null or empty text: no licence. Repeated rows are separate documents. Empty table: no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    own = ("licenses", "license_spans", "license_dice")
    keep = [c for c in docs.columns if (carry is None or c in carry) and c.lower() not in own]
    sizes = [len(_plain_bigrams(text)) for _, _, text in templates]
    low = max(1, int(min(sizes) * threshold / (2 - threshold)))
    high = int(max(sizes) * (2 - threshold) / threshold) + 1
    table = _templates(templates, threshold)
    grams = sorted({g for _, _, text in templates for g in _plain_bigrams(text)})
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")

    def best(kind: str, unit: Column, number: Column) -> Column:
        span = lambda m: F.struct(F.lit(kind).alias("unit"), number.cast("int").alias("number"), m[0]["license"].alias("license"), m[0]["form"].alias("form"), m[0]["dice"].alias("dice"))
        return _let(matches(normalised(unit), table, low, high, threshold), lambda m: F.when(F.size(m) > 0, span(m)))

    nothing = F.expr("cast(array() as array<struct<unit:string,number:int,license:string,form:string,dice:double>>)")
    several = lambda units, each: _let(units, lambda x: F.when(F.size(x) > 1, F.transform(x, each)).otherwise(nothing))
    paragraphs = F.split(text, r"\n[\x20\x09-\x0D]*\n")
    by_line = F.concat(
        F.transform(lines, lambda u, i: best("line", u, i + 1)),
        several(paragraphs, lambda u, i: best("paragraph", u, i + 1)),
        F.when(F.contains(text, F.lit("\n")), F.array(best("text", text, F.lit(1)))).otherwise(nothing),
    )
    # Units that match hold an anchor, so other texts are not taken apart.
    def with_runs(units: Column) -> Column:
        named = F.transform(units, lambda x: x["license"])
        rest = F.filter(runs(normalised(text), table, grams, threshold), lambda r: ~F.array_contains(named, r["license"]))
        return F.concat(units, F.transform(rest, lambda r: F.struct(F.lit("words").alias("unit"), (r["at"] + 1).cast("int").alias("number"), r["license"].alias("license"), r["form"].alias("form"), r["dice"].alias("dice"))))

    found = F.when(F.lower(text).rlike(anchors(templates, threshold)), _let(F.array_compact(by_line), with_runs)).otherwise(nothing)
    spans = "license_spans"
    out = docs.select(*[F.col(f"`{c}`") for c in keep], found.alias(spans))
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.array_sort(F.array_distinct(F.transform(F.col(spans), lambda x: x["license"]))).alias("licenses"),
        F.col(spans),
        F.coalesce(F.array_max(F.transform(F.col(spans), lambda x: x["dice"])), F.lit(0.0)).alias("license_dice"),
    )
