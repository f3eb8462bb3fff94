"""Token counts of documents in flat token files: a scan for separators.

A flat file is nothing but ids of two bytes (little-endian), each document's ids followed by the separator.
Nothing says where documents begin. Files are cut into byte ranges, from their listing alone, and dealt over tasks
that read only their own ranges, so neither a large file nor its neighbours come into one task; in each block one vectorised comparison finds
the separators. A document may begin blocks before it ends: a prefix scan over the blocks' summaries (how many
separators, where the last one is) tells each block how many documents came before and where its first
document began, and only then are the separators turned into documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentlens.llm import tokens
from rentlens.llm.common import saved, workers

#: Bytes of a block, and how many blocks a task reads, one after the other.
BLOCK_BYTES, TASK_BLOCKS = 1 << 20, 64
#: Hadoop's names of stores that pyarrow names otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def _short_ids(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(content)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in tokens.runs(texts):
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in encoder.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])
    return run


def write_flat(docs: DataFrame, tokenizer_path: str, separator: int, path: str, text_col: str = "text",
               file_documents: int = 0) -> None:
    """Writes the texts' ids as flat files, one a task, or with at most ``file_documents`` documents each. Spark's text writer puts the bytes of a row and then the line separator,
    here the two bytes of the separator. Null and empty texts are a separator alone."""
    if not 0 <= separator < 1 << 16:
        raise ValueError("the separator must be an id of two bytes")
    slim = docs.select(F.col(text_col).cast("string").alias("text"))
    content = tokens.shipped(docs.sparkSession, tokenizer_path)
    ids = workers(slim).mapInArrow(_short_ids(content), "ids binary").select(F.col("ids").cast("string").alias("value"))
    (ids.write.option("encoding", "ISO-8859-1").option("lineSep", separator.to_bytes(2, "little").decode("latin-1"))
     .option("maxRecordsPerFile", file_documents).option("compression", "none").text(path))


def _ranges(spark: SparkSession, path: str, block_bytes: int) -> DataFrame:
    """Rows (file, block) of the files below ``path``, dealt over tasks; only names and lengths are read."""
    if block_bytes % 2:
        raise ValueError("ids have two bytes")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
             .filter("length > 0"))
    blocks = files.select(F.col("path").alias("file"), F.explode(F.expr(f"sequence(0L, (length - 1) div {block_bytes})")).alias("block"))
    n = files.agg(F.sum(F.expr(f"(length - 1) div {block_bytes} + 1"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_BLOCKS))  # a number of its own: the rows are small, their ranges are not
    return workers(blocks.repartition(tasks, "file", "block"))


def _stored(file: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = file.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def _read(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[str, int, bytes]]:
    """The bytes of each range, one at a time."""
    for batch in batches:
        for file, block in zip(*(c.to_pylist() for c in batch.columns)):
            store, at = _stored(file)
            with store.open_input_file(at) as f:
                yield file, block, f.read_at(block_bytes, block * block_bytes)


def read_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (file, block from 0, data) of the files below ``path``, whose sizes must be even; empty files have none.
    Tasks read their byte ranges through pyarrow's file systems (local and mounted folders, hdfs, s3, gs, abfs)."""
    def run(batches):
        for file, block, data in _read(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary())],
                                             ["file", "block", "data"])
    return _ranges(spark, path, block_bytes).mapInArrow(run, "file string, block long, data binary")


SCAN = "file string, block long, n long, at array<int>"


def _found(files: list[str], blocks: list[int], data: list[bytes | None], separator: int) -> pa.RecordBatch:
    """Each block's number of ids and the places of separators in it."""
    ids = [np.frombuffer(d or b"", "<u2") for d in data]
    return pa.RecordBatch.from_arrays(
        [pa.array(files, pa.string()), pa.array(blocks, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
         pa.array([np.flatnonzero(x == separator).astype(np.int32) for x in ids], pa.list_(pa.int32()))],
        ["file", "block", "n", "at"])


def file_tokens(spark: SparkSession, path: str, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``document_tokens`` of the flat files below ``path``; ranges are read and scanned in the same task."""
    def run(batches):
        for file, block, data in _read(batches, block_bytes):
            yield _found([file], [block], [data], separator)
    return _stitched(saved(_ranges(spark, path, block_bytes).mapInArrow(run, SCAN)))


def document_tokens(blocks: DataFrame, separator: int) -> DataFrame:
    """One row per document: file, doc_no (from 0 in the file), start, n_tokens (without the separator).

    ``blocks``: file, block, data (binary; a document may span any number of blocks; null is empty). Ids after a
    file's last separator are a document without an end and count as one (ended = false); a file that ends with a
    separator has none. No blocks, no rows; other columns are ignored.
    """
    slim = blocks.select(F.col("file").cast("string").alias("file"), F.col("block").cast("long").alias("block"),
                         F.col("data").cast("binary").alias("data"))

    def run(batches):
        for batch in batches:
            yield _found(*(c.to_pylist() for c in batch.columns), separator)
    return _stitched(saved(workers(slim).mapInArrow(run, SCAN)))


def _stitched(scan: DataFrame) -> DataFrame:
    """Documents from blocks' separators, by a prefix scan over the blocks of each file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    brief = scan.select("file", "block", "n", F.size("at").cast("long").alias("k"),
                        F.get("at", F.size("at") - 1).alias("last"))
    brief = brief.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    brief = brief.withColumn("after", F.col("base") + F.col("last") + 1)  # where the next document begins
    tails = brief.groupBy("file").agg(F.sum("n").alias("stop"), F.sum("k").alias("doc_no"),
                                      F.coalesce(F.max("after"), F.lit(0)).alias("start"))
    brief = brief.select("file", "block", "base", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("docs"),
                         F.coalesce(F.max("after").over(before), F.lit(0)).alias("open"))
    ends = scan.filter(F.size("at") > 0).join(brief, ["file", "block"])
    ended = ends.select("file", "docs", "base", "open", "at", F.posexplode("at").alias("i", "end")).select(
        "file", (F.col("docs") + F.col("i")).alias("doc_no"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("at", F.col("i") - 1) + 1).alias("start"),
        (F.col("base") + F.col("end")).alias("stop"), F.lit(True).alias("ended"))
    rest = tails.filter("start < stop").select("file", "doc_no", "start", "stop", F.lit(False).alias("ended"))
    return ended.unionByName(rest).select("file", "doc_no", "start", (F.col("stop") - F.col("start")).alias("n_tokens"),
                                          "ended")
