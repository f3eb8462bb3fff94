"""The append-only prediction log as a Structured Streaming job.

Landing files (parquet batches written by ``sources.predlog.append``) are read as
a file stream, de-duplicated by id, and appended to the log
table with a checkpoint, so a restarted or retried query neither loses nor
repeats records. Records later than the watermark are dropped by the stream; ``append_late`` finds what the log
lacks and keeps it in a folder of its own beside the stream's (a batch must not write into a stream sink's folder,
whose readers follow the sink's own list of files). ``read_log`` reads both.

A run over what has landed (``available_now``) gives the same log in however many micro-batches it reads the files: what
is late is judged by the records of earlier runs, and of an id that landed several times the first landed record stays.
Which those are is known before the run from counts of hashes, so whole records are neither shuffled nor held in state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.session import materialize

#: How far a record may lie behind the newest record of earlier runs.
WATERMARK = "1 hour"


def log_stream(spark: SparkSession, landing_dir: str, schema, watermark: str = WATERMARK,
               max_files_per_trigger: int = 100, available_now: bool = True) -> DataFrame:
    """The landed records, once each. With ``available_now`` (for a run of ``run_to_table`` that stops) a record is left
    out when its id has landed before, at any time; call it anew for each run, and let nothing land in between.
    Otherwise the stream goes on and remembers ids for as long as the watermark."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(landing_dir))
    if not available_now:
        return src.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["id"])
    again = landed_again(spark.read.schema(schema).parquet(landing_dir))
    if again is None:
        return src
    return src.select("*", *_place()).join(again, ["_file", "_row"], "left_anti").select(*src.columns)


def _place() -> list[Column]:
    """Where a record has landed."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def landed_again(landing: DataFrame) -> DataFrame | None:
    """File and row of the records whose id had landed before (None: there are none). Hashes of the ids are counted
    first; only records that share one are compared."""
    ids = landing.select("id", F.col("_metadata.file_modification_time").alias("_at"), *_place(), F.xxhash64("id").alias("_h"))
    shared = materialize(ids.groupBy("_h").count().filter("count > 1").select("_h"))
    if shared.isEmpty():
        return None
    some = materialize(ids.join(shared, "_h", "left_semi").withColumn("_place", F.struct("_at", "_file", "_row")))
    first = some.groupBy("id").agg(F.min("_place").alias("_first"))
    again = some.join(first, some["id"].eqNullSafe(first["id"])).filter(F.col("_place") > F.col("_first"))
    return materialize(again.select("_file", "_row"))


def run_to_table(stream: DataFrame, table_dir: str, checkpoint_dir: str, available_now: bool = True, watermark: str = WATERMARK):
    """Append the stream to ``table_dir``; with ``available_now`` the query
    processes what has landed and stops (batch-style scheduling of a stream). Such a run drops records that lie
    ``watermark`` or more behind the newest record of the runs that ended before it."""
    spark, bounds = stream.sparkSession, f"{checkpoint_dir}/late_bounds"
    if available_now:
        spark.createDataFrame([], "bound long").write.mode("append").parquet(bounds)
        late = spark.read.schema("bound long").parquet(bounds).agg(F.max("bound")).first()[0]
        if late is not None:
            stream = stream.filter(F.col("timestamp").isNull() | (_micros(F.col("timestamp")) > late))
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_dir).option("path", table_dir).option("compression", "zstd"))
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        q.awaitTermination()
        if q.lastProgress is not None:  # something has been read
            newest = F.max("timestamp") - F.expr(f"INTERVAL {watermark}")
            read_log(spark, stream.schema, table_dir).agg(_micros(newest).alias("bound")).coalesce(1).write.mode("append").parquet(bounds)
    return q


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def read_log(spark: SparkSession, schema, table_dir: str, late_dir: str | None = None) -> DataFrame:
    """The log: what the stream has appended and, when given, the late records."""
    log = spark.read.schema(schema).parquet(table_dir)
    return log.unionByName(spark.read.schema(schema).parquet(late_dir)) if late_dir else log


def append_late(landing: DataFrame, table_dir: str, late_dir: str) -> DataFrame:
    """The dead-letter path: landed records whose id the log lacks, once each, are appended to ``late_dir`` (made when it
    is missing). Running it again appends nothing. Run it after the stream has read what landed. Returns the records
    appended now. Ids are compared as 128 bits (MD5); whole records are only shuffled from files with some that the log
    lacks."""
    spark, schema = landing.sparkSession, landing.schema
    spark.createDataFrame([], schema).write.mode("append").parquet(late_dir)
    key = F.coalesce(F.unhex(F.md5("id")), F.lit(b"")).alias("_key")
    known = read_log(spark, schema, table_dir, late_dir).select(key)
    landed = landing.select("*", key, F.xxhash64(F.input_file_name()).alias("_file"))
    lacking = materialize(landed.select("_key", "_file").join(known, "_key", "left_anti"))
    late = landed.join(lacking.select("_file").distinct(), "_file", "left_semi").join(lacking, "_key", "left_semi")
    late = materialize(late.dropDuplicates(["id"]).select(*landing.columns))
    late.write.mode("append").option("compression", "zstd").parquet(late_dir)
    return late


def checked_records(records: DataFrame) -> DataFrame:
    """Records with the columns the log requires, timestamps as TIMESTAMP."""
    return records.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def rows_dropped_by_watermark(query) -> int:
    """Rows a streaming query discarded as later than its watermark, summed over
    the progress reports it still holds (the late-row count the policy asks for)."""
    total = 0
    for p in query.recentProgress or []:
        for op in p.get("stateOperators", []) or []:
            total += int(op.get("numRowsDroppedByWatermark", 0) or 0)
    return total
