"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as all operators here understand them (ASCII white space only).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only when a count has shown it to have no more rows than this.
BROADCAST_ROWS = 50_000

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, only a local master may go on, with a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if "dir" not in _fallback:
        _fallback["dir"] = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    return _fallback["dir"]


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors cost no recomputation.

    Meant for narrow rows (ids, numbers, digests), never for texts.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted, over a cut or cheap plan), else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


#: A key that more than this share of all rows hold is looked up by broadcast; so at most as many keys are.
HOT_SHARE = 1 / 1000


def look_up(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """``rows`` joined with the only row of ``table`` that has their ``key``; rows without one are left out.

    Rows of hot keys stay where they are and meet the at most 1,000 or so table rows of these keys by broadcast; the others are shuffled.
    """
    bound = max(100, int(rows.count() * HOT_SHARE))
    values = [c for c in table.columns if c != table_key]
    counted = rows.groupBy(key).count().filter(F.col("count") > bound).select(F.col(key).alias(table_key))
    held = table.join(F.broadcast(counted), table_key, "left_semi")
    (there,) = fresh([*rows.columns, *table.columns], "there")
    tagged = rows.join(F.broadcast(held.withColumn(there, F.lit(True))), F.col(key) == F.col(table_key), "left").drop(table_key)
    rest = tagged.filter(F.col(there).isNull()).select(*rows.columns).join(table, F.col(key) == F.col(table_key)).select(*rows.columns, *values)
    return tagged.filter(there).select(*rows.columns, *values).unionByName(rest)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column is called so (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *names: str) -> list[Column]:
    """Columns of ``df`` whose names do not clash with ``names``; the operator's own columns win over them."""
    own = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in own]


def words(text: Column | str) -> Column:
    """The words of a text as an array (null: none), evaluated in the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def release_memory() -> None:
    """Give what a Python worker has freed back to the system: workers live on beside the JVM between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of text that an operator works on at once. Batches that come from the JVM are bounded by its own
#: spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set; a text longer than either is a batch of its own.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, at: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of whole rows, of about ``limit`` bytes each in the string column number ``at``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    stops = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for begin, stop in zip([0, *stops], stops, strict=False):
        yield batch.slice(begin, stop - begin)


def barrier(number: Column) -> Column:
    """A whole number as it is, marked as not deterministic.

    Filters on what is computed from it are not pushed below the projection that holds it, where
    Catalyst would compute the column again for each use.
    """
    return number + F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)
