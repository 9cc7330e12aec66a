"""Token counts of documents in flat token files that have no index.

A flat file is nothing but token ids of fixed width, with an end-of-document id after each document.
Files are read as blocks; each block is searched for the id as one vector. What a block cannot know,
where the document began that ends at its first separator, comes from a prefix scan over the
block table (numbers of tokens and separators, place of the last separator): one narrow row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import release_memory

#: Tokens in a block, and the size in bytes from which a file is read by ranges and not as a whole.
BLOCK_TOKENS = 1 << 19
WHOLE_FILE_BYTES = 256 << 20
KIND = {2: "<u2", 4: "<u4"}


def write_flat(docs: DataFrame, target: str, *, text_col: str = "text", path: str | None = None, end: int = 50256, width: int = 2) -> None:
    """Encode each text and write all ids as flat little-endian files under ``target``, one per partition.

    The text of an added token in a document is encoded as ordinary text, so ``end`` occurs as a
    separator only. Null text: no ids, just the separator. The writer is Spark's own, so any store
    that Spark writes to will do: a row is a document's bytes, its line end the separator's.
    """
    path = path or bpe.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.load(path)
        encoder = vocabulary.encoder(added=False)
        for batch in batches:
            for texts in bpe.chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([t.astype(KIND[width]).tobytes() for t in encoder.encode_batch(texts)], pa.binary())], names=["ids"])
            release_memory()

    separator = int(end).to_bytes(width, "little").decode("latin-1")
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "ids binary")
    rows.select(F.col("ids").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", separator).text(target)


def read_blocks(spark: SparkSession, target: str, *, width: int = 2, block_tokens: int = BLOCK_TOKENS, whole_file_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """(file, block, data) of all files under ``target``; a file's blocks are numbered from 0.

    Files up to ``whole_file_bytes`` are read as a whole and sliced; longer ones by ranges of a length that divides theirs.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(target)
    size = block_tokens * width
    whole = files.filter(F.col("length") <= whole_file_bytes).select(
        F.col("path").alias("file"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}")))).alias("block"),
        "content",
    )
    out = whole.select("file", "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("data"))
    long = files.filter(F.col("length") > whole_file_bytes).select("path", "length")
    for file, length in long.toLocalIterator():  # names of very long files only
        out = out.unionByName(_ranges(spark, file, length, width, size))
    return out


def _ranges(spark: SparkSession, file: str, length: int, width: int, size: int) -> DataFrame:
    record = max(d for d in _divisors(length) if d % width == 0 and d <= size) if length % width == 0 else 0
    if not record:
        raise ValueError(f"{file}: its length is no multiple of {width}")
    rdd = spark.sparkContext.newAPIHadoopFile(
        file, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record)},
    )
    return spark.createDataFrame(rdd.map(lambda kv: (file, kv[0], bytearray(kv[1]))), "file string, block long, data binary")


def _divisors(n: int) -> list[int]:
    low = [d for d in range(1, int(n**0.5) + 1) if n % d == 0]
    return low + [n // d for d in low]


def count_tokens(blocks: DataFrame, *, end: int = 50256, width: int = 2) -> DataFrame:
    """One row per document: ``file``, ``ordinal`` in the file from 0, ``start`` (token), ``n_tokens``, ``ended``.

    The separator counts to no document. Two separators in a row hold an empty document between them. Tokens
    after a file's last separator are a document that has not ended. Empty files and blocks: no document. A file
    whose length is no multiple of the width fails.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer() or b"", KIND[width])
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == end).astype(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(e) for e in ends])))
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ends, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), found], names=["file", "block", "n", "ends"])

    table = blocks.select("file", "block", "data").mapInArrow(search, "file string, block long, n long, ends array<long>")
    along = Window.partitionBy("file").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    table = table.withColumns({
        "begin": F.coalesce(F.max(F.col("base") + F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)).over(before) + 1, F.lit(0).cast("long")),
        "ordinal": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long"),
        "last": F.lead("block").over(along).isNull(),
    })
    stops = F.transform("ends", lambda e: F.struct((F.col("base") + e).alias("stop"), F.lit(True).alias("ended")))
    tail_begin = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1) + 1).otherwise(F.col("begin"))
    tail = F.when(F.col("last") & (tail_begin < F.col("base") + F.col("n")), F.array(F.struct((F.col("base") + F.col("n")).alias("stop"), F.lit(False).alias("ended"))))
    each = table.select("file", "begin", "base", "ends", "ordinal", F.posexplode(F.concat(stops, F.coalesce(tail, F.expr("cast(array() as array<struct<stop:bigint,ended:boolean>>)")))).alias("k", "s"))
    start = F.when(F.col("k") == 0, F.col("begin")).otherwise(F.col("base") + F.get("ends", F.col("k") - 1) + 1)
    return each.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("s.stop") - start).alias("n_tokens"), F.col("s.ended").alias("ended"))
