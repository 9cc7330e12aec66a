"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over training time ``t`` in [0, 1], piecewise linear between
knots. Its integral ``A(t)`` is the source's cumulative token demand up to a factor: the whole
integral fixes the source's target number of tokens, and inverting ``A`` at a document's place in
its source's token stream gives the training time at which that document is due.

Plan: document sizes are summed by (source, bucket of the document's md5); running sums over these
bucket totals, one row per source and bucket, place each bucket in its source's stream; a window
inside (source, bucket) places each document. A hot source is thus spread over all buckets, and no
task sees a whole source. The last step range-sorts by training position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, others

#: Weights dealt to the sources in order of their names, again and again.
CYCLE = (1.0, 2.0, 3.0)


def cycle_schedule(weights: tuple[float, ...] = CYCLE) -> Callable[[Column, Column], Column]:
    """A curriculum over sources in the order of their names: the integral of the k-th one's weight is ``weights[k % len(weights)]``.

    Weights change over the time: those of odd sources (the first, third, ...) rise from half to one and a half times
    their integral, those of the others fall likewise.
    """

    def knots(source: Column, rank: Column) -> Column:
        w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
        rises = rank % 2 == 1
        low, high = w * 0.5, w * 1.5
        ends = F.when(rises, low).otherwise(high), F.when(rises, high).otherwise(low)
        return F.array(*(F.struct(F.lit(t).alias("t"), e.alias("w")) for t, e in zip((0.0, 1.0), ends, strict=True)))

    return knots


def table_schedule(table: dict[str | None, list[tuple[float, float]]]) -> Callable[[Column, Column], Column]:
    """A schedule given as {source: [(t, weight), ...]}; t rises from 0 to 1; sources not named get nothing."""
    for name, points in table.items():
        ts = [t for t, _ in points]
        if len(points) < 2 or ts[0] != 0 or ts[-1] != 1 or any(a >= b for a, b in zip(ts, ts[1:], strict=False)) or any(w < 0 for _, w in points):
            raise ValueError(f"schedule of {name!r}: times must rise from 0 to 1 and weights be at least 0")

    def knots(source: Column, rank: Column) -> Column:
        out = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(0.0).alias("w")) for t in (0.0, 1.0)))
        for name, points in table.items():
            own = F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in points))
            out = F.when(source.eqNullSafe(F.lit(name)), own).otherwise(out)
        return out

    return knots


def _segments(knots: Column) -> Column:
    """From knots to segments {t, w, slope, a}: a is the integral up to the segment's start."""
    step = lambda acc, k: F.struct(
        F.concat(acc["done"], F.array(F.struct(
            acc["t"].alias("t"), acc["w"].alias("w"),
            ((k["w"] - acc["w"]) / (k["t"] - acc["t"])).alias("slope"), acc["a"].alias("a"),
        ))).alias("done"),
        k["t"].alias("t"), k["w"].alias("w"),
        (acc["a"] + (k["t"] - acc["t"]) * (k["w"] + acc["w"]) / 2).alias("a"),
    )
    first = F.element_at(knots, 1)
    start = F.struct(
        F.expr("cast(array() as array<struct<t:double,w:double,slope:double,a:double>>)").alias("done"),
        first["t"].alias("t"), first["w"].alias("w"), F.lit(0.0).alias("a"),
    )
    return F.aggregate(F.slice(knots, F.lit(2), F.size(knots)), start, step, lambda acc: F.struct(acc["done"].alias("segments"), acc["a"].alias("whole")))


def _invert(segments: Column, area: Column) -> Column:
    """The time at which the integral reaches ``area``."""
    hit = lambda s: s["t"] + F.coalesce(
        F.try_divide(2 * (area - s["a"]), s["w"] + F.sqrt(F.greatest(s["w"] * s["w"] + 2 * s["slope"] * (area - s["a"]), F.lit(0.0)))), F.lit(0.0)
    )
    return F.element_at(F.transform(F.filter(segments, lambda s: s["a"] <= area), hit), -1)


def plan_mix(
    docs: DataFrame,
    schedule: Callable[[Column, Column], Column] | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: int = 3,
    buckets: int = 4096,
    sort: bool = True,
) -> DataFrame:
    """One row per document with what the mix takes of it, sorted by training position.

    Added columns (they replace columns of the same names): ``size`` long, words of the text;
    ``source_size`` long; ``target`` double, words that the mix takes from the source; ``taken``
    long, words it takes from the document, repeats counted; ``positions`` array<double>, the
    training time of each pass over the document, in [0, 1).

    All sizes together are shared among the sources by the integrals of their schedules. A target
    ends at ``max_repeats`` times its source's size, and what it leaves is shared among the others
    by weight until none is above. A source's documents are passed through in the order of the md5
    of their ids as often as its target asks; the last pass ends at the target's last word.

    Null source: a source of its own, last in order. Null or empty text: size 0, nothing taken, no
    position, last in order. Null id: hashed as the empty string. Repeated rows are separate
    documents; equal ids are ordered by size and a hash of all columns (of maps and variants none). Empty table: no rows.
    """
    schedule = schedule or cycle_schedule()
    own = ("size", "source_size", "target", "taken", "positions")
    skey, key, bucket, tie, size, before, at, whole, segs, start = fresh(
        [*docs.columns, *own], "mix_source", "mix_key", "mix_bucket", "mix_tie", "mix_size", "mix_before", "mix_at", "mix_whole", "mix_segments", "mix_start"
    )
    width = len(f"{buckets - 1:x}")
    sized = docs.withColumns({
        skey: F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")),
        key: F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")),
        size: n_words(text_col),
    }).withColumns({bucket: F.substring(key, 1, width), tie: F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))])})

    by_bucket = sized.groupBy(skey, bucket).agg(F.sum(size).alias(before))
    along = Window.partitionBy(skey).orderBy(bucket)
    by_bucket = by_bucket.select(
        skey, bucket,
        F.coalesce(F.sum(before).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before),
        F.sum(before).over(Window.partitionBy(skey)).alias("source_size"),
    )

    # One row per source from here on; windows without a partition see only these.
    sources = by_bucket.groupBy(skey).agg(F.max("source_size").alias("size"))
    name = F.when(F.col(skey) != "-", F.substring(skey, 2, 1 << 30))
    sources = sources.withColumn("rank", F.row_number().over(Window.orderBy(name.asc_nulls_last())))
    sources = sources.withColumn("s", _segments(schedule(name, F.col("rank")))).select(
        skey, F.col("s.segments").alias(segs), F.col("s.whole").alias(whole), F.col("size").cast("double").alias("size"), "rank"
    )
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.col("size") * max_repeats
    sources = sources.withColumn("ratio", F.try_divide(full, F.col(whole)))
    earlier = Window.orderBy(F.col("ratio").asc_nulls_last(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = F.try_divide(
        F.sum("size").over(everything) - F.coalesce(F.sum(full).over(earlier), F.lit(0.0)),
        F.sum(whole).over(everything) - F.coalesce(F.sum(whole).over(earlier), F.lit(0.0)),
    )
    sources = sources.withColumn("level", F.when(F.col(whole) > 0, level))
    sources = sources.withColumn("level", F.max("level").over(everything))
    sources = sources.select(
        skey, segs, whole, F.when(F.col(whole) > 0, F.least(full, F.col("level") * F.col(whole))).otherwise(F.lit(0.0)).alias("target")
    )

    offsets = by_bucket.join(sources, skey)
    inside = Window.partitionBy(skey, bucket).orderBy(key, id_col, size, tie).rowsBetween(Window.unboundedPreceding, -1)
    keep = others(docs, *own)
    placed = sized.withColumn(at, F.coalesce(F.sum(size).over(inside), F.lit(0))).drop(*[c for c in docs.columns if c.lower() in own]).join(offsets, [skey, bucket])
    placed = placed.withColumn(start, F.col(before) + F.col(at))
    end = F.floor(F.col("target") + 0.5).cast("long")
    taken, due = F.lit(0).cast("long"), []
    for k in range(max_repeats):
        begin = F.col(start) + k * F.col("source_size")
        part = F.greatest(F.lit(0).cast("long"), F.least(F.col(size), end - begin))
        taken = taken + part
        due.append(F.when(part > 0, _invert(F.col(segs), F.col(whole) * begin / F.col("target"))))
    out = placed.select(
        *keep, F.col(size).alias("size"), "source_size", "target", taken.alias("taken"), F.array_compact(F.array(*due)).alias("positions"), F.col(key)
    )
    if sort:
        out = out.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), key)
    return out.drop(key)


def training_stream(plan: DataFrame) -> DataFrame:
    """The mix as a stream of whole documents: one row per pass of which at least half a document is taken.

    Adds ``pass`` (from 0) and ``position``; sorted by position.
    """
    own = ("pass", "position")
    passes = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    return (
        plan.filter((F.col("size") > 0) & (2 * F.col("taken") >= F.col("size")))
        .select(*others(plan, *own), F.posexplode(F.slice("positions", F.lit(1), passes)).alias(*own))
        .orderBy("position")
    )
