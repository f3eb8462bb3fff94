"""Shards along a Hilbert curve (DataFrame operations only).

Each metadata dimension is quantised to 2**bits steps; the cell of a row has a place on the Hilbert
curve through the grid, rows are sorted by that place, and the order is cut into runs. Rows of a run
are neighbours in every dimension, so the minima and maxima of a shard prune well on any of them.
The curve is a table of 2**(dimensions * bits) rows (its size is fixed by the parameters, 65,536 rows
by default), so a row needs one lookup. Ranks come from a range partitioning, written once, and one
count per partition: no task sees more than its partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentlens.llm.common import saved, text_or_empty

BITS = 4


def hilbert_table(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """cell (the coordinates' bits one after another, first dimension highest), place on the curve.

    From coordinates to the transposed index: undo the excess of rotations and reflections from the
    highest bit down, then Gray-encode; the index takes one bit of each dimension in turn.
    """
    if dims * bits > 20:
        raise ValueError("the grid is a broadcast table: at most 2**20 cells")
    cells = spark.range(1 << (dims * bits)).withColumnRenamed("id", "cell")
    x = [f"x{i}" for i in range(dims)]
    cells = cells.select("cell", *[F.shiftright("cell", bits * (dims - 1 - i)).bitwiseAND((1 << bits) - 1).alias(c)
                                   for i, c in enumerate(x)])
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for c in x:
            bit = F.col(c).bitwiseAND(1 << b) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(c)).bitwiseAND(low)
            first = F.when(bit, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]).bitwiseXOR(swap))
            own = F.when(bit, F.col(c)).otherwise(F.col(c).bitwiseXOR(swap))
            new = {x[0]: first} if c == x[0] else {x[0]: first, c: own}
            cells = cells.select("cell", *[new.get(k, F.col(k)).alias(k) for k in x])
    for i in range(1, dims):
        cells = cells.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn = reduce(lambda a, b: a.bitwiseXOR(b),
                  [F.when(F.col(x[-1]).bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0))
                   for b in range(1, bits)], F.lit(0))
    cells = cells.withColumn("turn", turn)
    place = reduce(lambda a, b: a + b,
                   [F.shiftleft(F.shiftright(F.col(c).bitwiseXOR(F.col("turn")), b).bitwiseAND(1).cast("long"),
                                b * dims + dims - 1 - i) for b in range(bits) for i, c in enumerate(x)])
    return cells.select(F.col("cell").cast("int").alias("cell"), place.alias("place"))


def category(col: Column, bits: int = BITS) -> Column:
    """A category's step, from a hash of its name (null: 0)."""
    return F.coalesce(F.conv(F.substring(F.md5(col.cast("string")), 1, 4), 16, 10).cast("int")
                      .bitwiseAND((1 << bits) - 1), F.lit(0))


def magnitude(col: Column, bits: int = BITS, least: int = 4) -> Column:
    """A size's step: its binary length, from ``least`` binary digits on (null: 0)."""
    digits = F.length(F.bin(F.greatest(col.cast("long"), F.lit(0))))
    return F.coalesce(F.least(F.greatest(digits - least, F.lit(0)), F.lit((1 << bits) - 1)), F.lit(0))


def between(col: Column, low: int | None, high: int | None, bits: int = BITS) -> Column:
    """An ordered value's step between the table's least and greatest value (null: 0)."""
    if low is None or high is None:
        return F.lit(0)
    width = max(1, -(-(high - low + 1) // (1 << bits)))
    return F.coalesce(F.floor((col.cast("long") - low) / width).cast("int"), F.lit(0))


def hilbert_shards(rows: DataFrame, dims: list[Column], order: list[str], shards: int, law: str = "rows",
                   size: str | None = None, bits: int = BITS) -> DataFrame:
    """``rows`` plus shard (int, from 0) and slot (long, gapless from 0 in each shard), in curve order.

    ``dims``: steps from 0 to 2**bits - 1. ``order``: columns that order rows of one cell (nulls first).
    ``law``: ``rows`` cuts so that counts differ by one at most, ``bytes`` so that each shard gets an
    equal part of the sum of the column ``size``, up to one row. Rows alike in ``order`` are in any order.
    An empty table gives an empty result; with fewer rows than shards some shards are empty.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    spark, names = rows.sparkSession, rows.columns
    cell = reduce(lambda a, b: F.shiftleft(a, bits).bitwiseOR(b), [d.cast("int") for d in dims])
    at = rows.select(F.struct(*names).alias("row"), cell.alias("cell"))
    curve = hilbert_table(spark, len(dims), bits)
    by = ["place", *[f"row.{c}" for c in order]]
    ranked = saved(at.join(F.broadcast(curve), "cell").select("row", "place").repartitionByRange(*by)
                   .sortWithinPartitions(*by).select("row", "place", F.monotonically_increasing_id().alias("at")))
    ranked = ranked.select("row", "place", F.shiftright("at", 33).alias("part"),
                           F.col("at").bitwiseAND((1 << 33) - 1).alias("nth"))
    weight = F.col(f"row.{size}") if size else F.lit(1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))  # a row per partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                         F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    total, heavy = ranked.agg(F.count("*"), F.sum(weight)).first()
    ranked = ranked.join(F.broadcast(parts), "part").withColumn("rank", F.col("n0") + F.col("nth"))
    if law == "rows":
        out = (ranked.withColumn("shard", F.expr(f"rank * {shards} div {max(total, 1)}"))
               .withColumn("slot", F.expr(f"rank - (shard * {total} + {shards - 1}) div {shards}")))
    else:
        own = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
        done = F.col("w0") + F.coalesce(F.sum(weight).over(own), F.lit(0))
        cut = saved(ranked.withColumn("shard", F.least(F.floor(done / (max(heavy or 1, 1) / shards)),
                                                       F.lit(shards - 1)).cast("long")))
        first = cut.groupBy("shard").agg(F.min("rank").alias("first"))  # a row per shard
        out = cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first"))
    return out.select("row.*", F.col("place").alias("curve_place"), F.col("shard").cast("int").alias("shard"),
                      F.col("slot").cast("long").alias("slot"))


def document_shards(docs: DataFrame, shards: int, law: str = "rows", id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Shards of documents by source, language, size and order of arrival (id): id, size, text_crc32,
    curve_place, shard, slot. size: UTF-8 bytes of the text plus 16. A null text has no bytes and crc32 0;
    null sources, languages and ids take step 0. Missing source or lang columns count as null."""
    low, high = docs.agg(F.min(id_col).cast("long"), F.max(id_col).cast("long")).first()
    have = {c: F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang")}
    crc = F.coalesce(F.crc32(F.encode(F.col(text_col).cast("string"), "UTF-8")), F.lit(0)).cast("long")
    size = (F.octet_length(text_or_empty(text_col)) + 16).cast("long")
    slim = docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"),
                       have["source"].alias("source"), have["lang"].alias("lang"))
    dims = [category(F.col("source")), category(F.col("lang")), magnitude(F.col("size")),
            between(F.col("id"), low, high)]
    out = hilbert_shards(slim, dims, ["id", "text_crc32", "size"], shards, law, "size")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "curve_place", "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Writes ``docs`` as one folder per shard in slot order; returns the manifest: per shard the rows and the
    least and greatest value of each plain column but the text, by which ``shards_for`` prunes."""
    plain = [f.name for f in docs.schema.fields if f.dataType.simpleString() in ("bigint", "int", "string", "double")
             and f.name != "text"]
    shards = placed.select(F.col(id_col).alias("__id"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    (docs.join(shards, docs[id_col].eqNullSafe(shards["__id"])).drop("__id").repartition("__shard")
     .sortWithinPartitions("__shard", "__slot").withColumnRenamed("__shard", "shard").drop("__slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
    return docs.sparkSession.read.parquet(path).groupBy("shard").agg(
        F.count("*").alias("rows"), *[f(c).alias(f"{k}_{c}") for c in plain for k, f in (("min", F.min), ("max", F.max))])


def shards_for(manifest: DataFrame, **ranges: tuple) -> DataFrame:
    """The shards that may hold rows with every column between its two values."""
    for c, (low, high) in ranges.items():
        manifest = manifest.filter((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high))
    return manifest.select("shard")
