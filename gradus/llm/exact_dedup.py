"""Exact duplicates found by a stream whose keyed state lives on disk and never expires.

The stream reads a folder of Parquet files, whatever has arrived since its last run. Its state
(RocksDB, snapshots in the shared folder) has one row for each digest ever seen: how many rows
had it, the stable identifier of the row that stays and the locator of that row's content (file
and row number). Partial sums before the shuffle keep a digest of many rows small. On every hit
the full bytes of both texts are compared, fetched by their locators; should texts differ that
share a digest, the digest's rows are grouped anew by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.session import scratch_path, write_out

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    # Else every partition of the state sets some megabytes of disk aside, used or not.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # One bound for all partitions that an executor holds, and changes saved as such.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: In a shared folder that is mounted as files, a checkpoint file by way of a file context takes
#: several child processes of the executor (for links and permissions); this manager takes one.
MOUNTED = {
    "spark.sql.streaming.checkpointFileManagerClass": (
        "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
    ),
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",  # Hadoop's own are kept there
}
#: Locators of repeated rows are broadcast up to this many, about 100 bytes each.
BROADCAST_ROWS = 200_000
_KEEP = "keep struct<doc_id:long,file:string,row:long>"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case. ``lower`` does the same where all is ASCII, and is faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _rows(source: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Identifier, locator and normalised bytes of each row of a Parquet scan, streaming or not."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return source.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        ascii_lowered(text).cast("binary").alias("bytes"),
    )


def _digested(rows: DataFrame, digest_bytes: int) -> DataFrame:
    heads = rows.select("doc_id", "file", "row", F.sha2("bytes", 256).alias("text_sha256"))
    digest = F.unhex(F.substring("text_sha256", 1, 2 * digest_bytes))
    return heads.select("doc_id", "file", "row", digest.alias("digest"), "text_sha256")


def ingest(
    spark: SparkSession,
    path: str,
    store: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest_bytes: int = 32,
) -> None:
    """Bring the state in ``store`` up to what ``path`` holds now; files are read once ever.

    A run that was cut off goes on from the stream's own checkpoint: a batch that is done again
    writes the same rows over its first try. A path with characters of a file pattern raises.
    """
    if set(path) & set("[]{}*?\\"):
        raise ValueError(f"characters of a pattern in the path: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(store)
    scheme = place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    settings = STATE | MOUNTED if scheme == "file" else STATE
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        # A pattern that only the path itself matches: a stream takes a single file only so.
        files = f"{path[:-1]}[{path[-1]}]"
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(files)
        state = (
            _digested(_rows(stream, id_column, text_column), digest_bytes)
            .groupBy("digest")
            .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
        )

        def changed(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{store}/changes/{number}")

        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{store}/stream")
            .trigger(availableNow=True)
            .foreachBatch(changed)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def repeated(spark: SparkSession, store: str) -> DataFrame:
    """``digest, n, keep`` of the digests that two rows or more have had."""
    schema = f"digest binary, n long, {_KEEP}"
    # Both values only ever grow, so the largest is the last, whatever the batch.
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .parquet(f"{store}/changes")
        .where("n > 1")
        .groupBy("digest")
        .agg(F.max("n").alias("n"), F.max("keep").alias("keep"))
    )


def _found(rows: DataFrame, locators: DataFrame, how: str = "inner") -> DataFrame:
    """Rows by locator; the list is broadcast only where its counted size is small."""
    small = locators.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(locators) if small else locators, ["file", "row"], how)


def decide(
    spark: SparkSession,
    path: str,
    store: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest_bytes: int = 32,
) -> DataFrame:
    """What becomes of every row in the Parquet folder (or file) ``path``.

    ``file, row, doc_id, keep_id, group_size, kept, text_sha256``. Texts are equal when they
    are identical after lower-casing A-Z; of equal texts the row with the largest id stays. A
    NULL text equals an empty one. A NULL id is smaller than any. Rows that repeat the largest
    id too are told apart by their locator: one stays. An empty table gives an empty result.
    Other columns are ignored, whatever their names. ``digest_bytes`` shortens the digest, for
    tests of what happens when different texts share one.
    """
    path = path.rstrip("/")
    store = store or scratch_path(spark, "dedup")
    spark.createDataFrame([], f"digest binary, n long, {_KEEP}").write.mode("overwrite").parquet(
        f"{store}/changes/none"
    )
    ingest(spark, path, store, id_column, text_column, digest_bytes)
    groups = write_out(repeated(spark, store), "dedup-groups")
    rows = _rows(spark.read.parquet(path), id_column, text_column)
    heads = write_out(_digested(rows, digest_bytes), "dedup-heads")
    hits = write_out(
        heads.join(groups, "digest").select(
            "file",
            "row",
            "digest",
            (F.struct("file", "row") == F.struct("keep.file", "keep.row")).alias("first"),
        ),
        "dedup-hits",
    )
    content = _found(rows, hits).select("doc_id", "file", "row", "digest", "first", "bytes")
    content = write_out(content, "dedup-content")
    stays = content.where("first").select("digest", F.col("bytes").alias("stays"))
    # Written before it is made distinct, so that a digest of very many hits can be split.
    unlike = content.where("not first").join(stays, "digest").where("bytes != stays")
    differ = write_out(unlike.select("digest"), "dedup-unlike").distinct()
    if not differ.isEmpty():
        groups = groups.join(differ, "digest", "left_anti").withColumn("bytes", F.lit(None).cast("binary"))
        parts = content.join(differ, "digest").groupBy("digest", "bytes")
        parts = parts.agg(
            F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep")
        )
        parted = content.join(differ, "digest").join(parts, ["digest", "bytes"])
        settled = parted.select("file", "row", "n", "keep").unionByName(
            heads.join(groups, "digest").select("file", "row", "n", "keep")
        )
        decided = heads.join(settled, ["file", "row"], "left")
    else:
        decided = heads.join(groups, "digest", "left")
    return decided.select(
        "file",
        "row",
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (
            F.col("n").isNull()
            | ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row")))
        ).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; see ``decide`` for which.

    The rows are written once, so that locators mean something. The state lasts for this call;
    ``ingest`` and ``decide`` with a ``store`` of one's own remember from run to run.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "dedup-input")
    docs.write.parquet(path)
    dropped = decide(spark, path, None, id_column, text_column).where("not kept")
    dropped = write_out(dropped.select("file", "row"), "dedup-dropped")
    kept = spark.read.schema(docs.schema).parquet(path)
    names = {"file": "_dedup_file", "row": "_dedup_row"}
    located = kept.withColumns(
        {names["file"]: F.col("_metadata.file_path"), names["row"]: F.col("_metadata.row_index")}
    )
    dropped = dropped.withColumnsRenamed(names)
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return located.join(dropped, list(names.values()), "left_anti").select(
        *[located[f"`{name}`"] for name in docs.columns]
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP8_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
