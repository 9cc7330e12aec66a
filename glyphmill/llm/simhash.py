"""Near-duplicates by SimHash, found in a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits, and mapped to its 32 bit counts (0 to 2).
The Manhattan distance of two count vectors is never more than the Hamming distance of the
fingerprints, so a range join with radius 3 in the embedding misses no link. Its grid: the vector is
cut into six blocks of five or six segments, and two vectors within distance 3 differ in at most
three of the blocks, so they share the cell of at least one of the 20 choices of three blocks.
Inside a cell a pair is bounded by its Manhattan distance, then verified by its Hamming distance.

Counts are kept in unary (0: 00, 1: 01, 2: 11), so a vector is a 64-bit number too and the Manhattan
distance of two is the number of bits in which these differ.

Copies are one row from the start (distinct fingerprints). A cell gives edges that span its linked
members, never all its pairs, so a large group of near copies costs as many edges as it has members.
Cells too full to be read as one are split by finer grids over the fingerprint's own bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, look_up, others, pieces, release_memory, scratch, small

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Bits of the six blocks, in pairs: 5 or 6 segments each.
BLOCKS = ((0, 10), (10, 20), (20, 32), (32, 42), (42, 52), (52, 64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles: a bit is 1 if set in over half the XXH64 of the shingles; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - shingle + 1)
    if count == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate(([0], ends[: count - 1])).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    hashes = [digest(view[a:b], SEED) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    for at in range(0, count, 1 << 16):
        bits = np.unpackbits(np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with its columns and ``name``, the fingerprint as a signed long. Batches of whole rows go through Python once."""
    at = docs.columns.index(text_col)
    keep = [i for i, c in enumerate(docs.columns) if c.lower() != name.lower()]
    schema = docs.select(*[F.col(f"`{docs.columns[i]}`") for i in keep], F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, at):
                found = pa.array([_signed(fingerprint(t.as_py())) for t in batch.column(at)], pa.int64())
                columns = [batch.column(i) for i in keep] + [found]
                yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in keep] + [name])
            release_memory()

    return docs.mapInArrow(run, schema)


def unary_counts(fp: Column) -> Column:
    """The 32 bit counts of two-bit segments in unary, as a long."""
    odd = 0x5555555555555555
    low, high = fp.bitwiseAND(F.lit(odd)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(odd))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _masks(blocks: tuple[tuple[int, int], ...]) -> list[int]:
    """For every choice of all but ``RADIUS`` blocks, its bits: two numbers that differ in ``RADIUS`` bits agree on one of these masks."""
    every = (1 << 64) - 1
    return [every ^ sum((1 << hi) - (1 << lo) for lo, hi in free) for free in combinations(blocks, RADIUS)]


def _even(n: int) -> tuple[tuple[int, int], ...]:
    """``n`` blocks of about as many bits."""
    return tuple((64 * k // n, 64 * (k + 1) // n) for k in range(n))


#: The grids, coarse to fine: over the bit counts first; members of cells that are too full meet in finer ones, over the fingerprint's own
#: bits. In the last at most 9 bits are free, so a cell has at most 512 fingerprints.
GRIDS = (("counts", _masks(BLOCKS)), ("fp", _masks(_even(6))), ("fp", _masks(_even(12))), ("fp", _masks(_even(24))))
#: A cell of more fingerprints is not read as one, but left to the next grid. At least 512.
MOST = 4096


def cell_stars(members: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the linked fingerprints of one cell: (least of a component, any other of it), at most members - 1.

    A fingerprint taken up asks those not yet reached: first the Manhattan distance of the counts, then the Hamming distance.
    """
    fps = np.sort(members.view(np.uint64))
    odd = np.uint64(0x5555555555555555)
    low, high = fps & odd, fps >> np.uint64(1) & odd
    counts = low | high | (low & high) << np.uint64(1)
    left, out = np.arange(len(fps)), []
    while len(left):
        least, front = left[0], [left[0]]
        left = left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(counts[left] ^ counts[at]) <= RADIUS
            near[near] = np.bitwise_count(fps[left[near]] ^ fps[at]) <= RADIUS
            if near.any():
                reached = left[near]
                front += reached.tolist()
                out += [(int(fps[least].view(np.int64)), x) for x in fps[reached].view(np.int64).tolist()]
                left = left[~near]
    return out


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = batch.column(0)
        flat, ends = members.values.to_numpy(), members.offsets.to_numpy()
        found = {e for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True) for e in cell_stars(flat[a:b])}
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def spanning_links(fps: DataFrame, *, most: int = MOST) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in column ``fp``; two of them are joined by edges just if they are by links.

    A link is a pair that differs in ``RADIUS`` bits or fewer. Each cell gives a star for every component inside it,
    not its links, so edges grow with the fingerprints, whatever their groups. A cell of two is settled by its least and
    greatest member; one of up to ``most`` is gathered; the members of fuller ones go on to the next grid, where all
    links between them are found again.
    """
    if most < 512:
        raise ValueError("most: at least 512, what a cell of the last grid can hold")
    none = fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    edges, level = none, fps.select("fp")
    for base, masks in GRIDS:
        point = level.select("fp", (unary_counts(F.col("fp")) if base == "counts" else F.col("fp")).alias("base"), F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
        point = point.select("fp", "mask", F.col("base").bitwiseAND(F.col("mask")).alias("cell"))
        cells = cut(point.groupBy("mask", "cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
        apart = unary_counts(F.col("a")).bitwiseXOR(unary_counts(F.col("b")))
        pairs = cells.filter("n = 2").filter(F.bit_count(apart) <= RADIUS).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
        gathered = point.join(small(cells.filter(f"n between 3 and {most}").select("mask", "cell")), ["mask", "cell"]).groupBy("mask", "cell").agg(F.collect_list("fp").alias("members"))
        edges = edges.union(pairs).union(gathered.select("members").mapInArrow(_stars, "a long, b long"))
        full = cells.filter(f"n > {most}").select("mask", "cell")
        if full.isEmpty():
            break
        level = cut(point.join(small(full), ["mask", "cell"]).select("fp").distinct())
    return edges.distinct()


def _plain(numbers: DataFrame) -> DataFrame:
    """``numbers`` as a table in the shared folder: a checkpoint keeps the estimated size, which joins multiply with every round."""
    target = scratch(numbers.sparkSession, "labels")
    numbers.write.parquet(target)
    return numbers.sparkSession.read.schema(numbers.schema).parquet(target)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b), by min-label rounds with pointer jumping, each cut to the shared folder.

    Root: the least node of the component. In each round a node takes the least label among its
    neighbours' and its own, partial minima before the shuffle, then its label's label.
    """
    both = _plain(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = _plain(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    for _ in range(max_rounds):
        offered = _plain(look_up(both, "b", label, "node").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("root")))
        # What a node is offered goes to its present root too (hooking), so that long chains close in few rounds.
        hooked = offered.join(label.withColumnRenamed("root", "old"), "node").select(F.col("old").alias("node"), "root")
        best = _plain(label.unionByName(offered).unionByName(hooked).groupBy("node").agg(F.min("root").alias("root")))
        new = _plain(look_up(best, "root", best.select(F.col("node").alias("at"), F.col("root").alias("further")), "at").select("node", F.col("further").alias("root")))
        changed = new.join(label.withColumnRenamed("root", "old"), "node").filter("root != old")
        if changed.isEmpty():
            return new
        label = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``.

    Fingerprints link at ``RADIUS`` or fewer differing bits, equal ones always; ``component_id`` is the least id reachable,
    itself included.

    Null or empty text: fingerprint zero, linked like any other. Null ids come last: a component has a null id only if
    all its documents have. Repeated rows are separate documents of one component. Empty table: no rows.
    """
    narrow = cut(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "fp"))
    classes = cut(narrow.groupBy("fp").agg(F.min("id").alias("least")))
    root = components(cut(spanning_links(classes)))
    placed = cut(classes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = look_up(placed.select("fp", "root"), "root", least.withColumnRenamed("root", "top"), "top").select(F.col("fp").alias("at"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return look_up(narrow, "fp", cut(placed), "at").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each component the one with the least id, with all its columns.

    Ids are taken to name documents: rows that repeat an id are reduced to one. Rows with a null id are judged
    together: one stays if a component consists of such rows only.
    """
    judged = near_dedup(docs, id_col=id_col, text_col=text_col)
    gone, one = fresh(docs.columns, "gone_id", "stay_row")
    stays = F.col(id_col).eqNullSafe(F.col("component_id"))
    ids = cut(judged.groupBy(F.col(id_col).alias(gone)).agg(F.sum(F.when(stays, 1).otherwise(0)).alias("winners")))
    # The ids that go are few where copies are few, so texts are not shuffled to find what stays.
    losers = ids.filter("winners = 0").select(gone)
    kept = docs.join(small(losers), F.col(id_col).eqNullSafe(F.col(gone)), "left_anti")
    if ids.filter("winners > 1").isEmpty():
        return kept
    from pyspark.sql import Window

    ranked = kept.withColumn(one, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))))
    return ranked.filter(F.col(one) == 1).select(*others(docs))
