"""Exact deduplication with a stateful stream.

The stream's state is keyed by the digest of the normalised text and kept on disk (RocksDB) without
expiry. A state row holds the digest (key), the smallest document id seen, that document's content
locator (file and row), and a count. Partial sums before the shuffle mean that a text with any
number of copies reaches the state as one row per task and batch.

Equal digests are only a hit. The kept document's bytes are then fetched by its locator and
compared with those of every other document of its digest; documents that differ (a collision) are
grouped by their bytes instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, drop_path, scratch, small

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # One bound for all stores of an executor, not one for each.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # Else each store reserves megabytes on disk before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column | str) -> Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _glob(path: str) -> str:
    """The path as a pattern that matches only itself: a file source takes a pattern for a single file too."""
    head, last = path.rstrip("/")[:-1], path.rstrip("/")[-1]
    return f"{head}[{last}]"


def dedup_index(
    spark: SparkSession, path: str, checkpoint: str, *, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int | None = None
) -> DataFrame:
    """Bring the stream's state up to date with the Parquet files in ``path`` and return it.

    A later call with the same ``checkpoint`` reads only files that are new since then. Columns:
    ``digest`` binary, ``ref`` struct of the kept document (nulls last, so a null id stays only
    among null ids), ``n`` long.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        # No file is too old: by default a file a week older than the newest is passed over.
        reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFileAge", "36500d")
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        seen = reader.parquet(_glob(path)).select(digest(normalised(text_col)).alias("digest"), _ref(id_col).alias("ref"))
        state = seen.groupBy("digest").agg(F.min("ref"), F.count("*"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not query.recentProgress and not _has_batch(spark, checkpoint):
        schema = seen.groupBy("digest").agg(F.min("ref").alias("ref"), F.count("*").alias("n")).schema
        return spark.createDataFrame([], schema)
    return spark.read.format("statestore").load(checkpoint).select("key.digest", F.col("value.min").alias("ref"), F.col("value.count").alias("n"))


def _has_batch(spark: SparkSession, checkpoint: str) -> bool:
    jvm = spark.sparkContext._jvm
    commits = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/0")
    return commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(commits)


def _ref(id_col: str) -> Column:
    return F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )


def dedup_files(
    spark: SparkSession, path: str, *, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", digest=sha256, checkpoint: str | None = None
) -> DataFrame:
    """A verdict for every row of the Parquet files in ``path``.

    Added columns (they replace columns of the same names): ``keep_id``, id of the document that
    stays; ``group_size`` long; ``kept`` boolean; ``text_sha256`` lowercase hex of the normalised
    text. ``columns`` names the columns to carry (default: all).

    Null or empty text counts as the empty text. Of equal texts the smallest id stays; null ids come
    last; equal ids are told apart by file and row, so exactly one row of a group is kept. Empty
    table: no rows.
    """
    own = ("keep_id", "group_size", "kept", "text_sha256")
    lasting = checkpoint or scratch(spark, "dedup")
    index = dedup_index(spark, path, lasting, id_col=id_col, text_col=text_col, digest=digest)
    many = cut(index.filter("n > 1").select("digest", F.col("ref").alias("keep"), "n"))
    if not checkpoint:
        drop_path(spark, lasting)

    read = spark.read.parquet(path)
    carried = [c for c in read.columns if (columns is None or c in columns) and c.lower() not in own]
    # The table's columns and the working ones sit in a struct each, so none can clash.
    rows = read.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
        F.struct(digest(normalised(text_col)).alias("digest"), normalised(text_col).alias("body"), _ref(id_col).alias("ref")).alias("x"),
    )
    looked = rows.join(small(many.select(F.struct(*many.columns).alias("hit"))), F.col("x.digest") == F.col("hit.digest"), "left")
    hex_of = F.lower(F.hex("x.digest")) if digest is sha256 else F.sha2("x.body", 256)

    def verdict(rows: DataFrame, keep_id: Column, size: Column, kept: Column, text_hex: Column) -> DataFrame:
        named = (keep_id.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), text_hex.alias("text_sha256"))
        return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in carried], *named)

    out = verdict(looked.filter("hit is null"), F.col("x.ref.id"), F.lit(1), F.lit(True), hex_of)
    copies = looked.filter("hit is not null")
    at_ref = (F.col("x.ref.file") == F.col("hit.keep.file")) & (F.col("x.ref.row") == F.col("hit.keep.row"))
    kept_body = copies.filter(at_ref).select(F.col("x.digest").alias("kept_digest"), F.col("x.body").alias("kept_body"))
    same = F.col("x.body") == F.col("kept_body")
    checked = copies.join(kept_body, F.col("x.digest") == F.col("kept_digest")).select(
        "row", "x.digest", "x.ref", "hit.keep", "hit.n", same.alias("same"), at_ref.alias("at_ref"), hex_of.alias("hex"), F.when(~same, F.col("x.body")).alias("body")
    )
    if text_col not in carried:
        checked = cut(checked)  # without texts the rows are narrow, and both uses below read them from there
    collided = cut(checked.filter("not same").select("digest", "body", "ref"))
    size = F.col("n")
    if not collided.isEmpty():
        lost = collided.groupBy("digest").agg(F.count("*").alias("lost"))
        apart = collided.groupBy("digest", "body").agg(F.min("ref").alias("apart_keep"), F.count("*").alias("apart_n"))
        regrouped = checked.filter("not same").join(apart, ["digest", "body"])
        out = out.unionByName(verdict(regrouped, F.col("apart_keep.id"), F.col("apart_n"), F.col("ref") == F.col("apart_keep"), F.col("hex")))
        checked = checked.join(lost, "digest", "left")
        size = F.col("n") - F.coalesce(F.col("lost"), F.lit(0))
    return out.unionByName(verdict(checked.filter("same"), F.col("keep.id"), size, F.col("at_ref"), F.col("hex")))


def _own_files(docs: DataFrame) -> str | None:
    """The path of a DataFrame that is nothing but a scan of one folder or file of Parquet, else null.

    Reading that path again must give the same rows: the scan has no options of its own (filters on files, nested
    folders, merged schemas, rebased dates), no partition columns, and the schema that the files have.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return None
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString() != "Parquet" or relation.partitionSchema().length():
        return None
    options, roots = relation.options(), relation.location().rootPaths()
    if roots.size() != 1 or options.size() > (1 if options.contains("path") else 0):
        return None
    path = roots.head().toString()
    return path if docs.sparkSession.read.parquet(path).schema == docs.schema else None


def dedup(docs: DataFrame, **options) -> DataFrame:
    """``dedup_files`` for any DataFrame: a plain scan of Parquet is streamed from its own files, other rows are first
    landed as Parquet in the shared folder."""
    path = _own_files(docs)
    if path is None:
        path = scratch(docs.sparkSession, "landed")
        docs.write.parquet(path)
    return dedup_files(docs.sparkSession, path, **options)
