"""Exact duplicates by a tree merge of sorted digest runs (DataFrame operations only).

Every input partition makes one run of digests, sorted, with one entry for each different text.
In rounds, ``fan_in`` neighbouring runs become one: their entries meet on (new run, digest) and the
best row of each text goes on. A digest that a third of all rows share is therefore one entry per run
before it first moves, and no more than ``fan_in`` entries meet at any level. The winners go back down
the same tree, so the way back has no hot key either. An entry counts as the same text only if
64-bit sort key, SHA-256 and length of the normalised text all agree, at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import fresh, null_safe_semi, saved, text_or_empty

#: ASCII white space, which the comparison of texts deletes.
WHITE = r"[\x20\x09-\x0D]"
KEY = ["key", "sha", "len"]


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    normal = F.regexp_replace(text_or_empty(text_col), WHITE, "")
    return (docs.select(F.col(id_col).alias("id"), normal.alias("normal"),
                        F.length(text_or_empty(text_col)).alias("chars"))
            .select("id", "chars", F.xxhash64("normal").alias("key"), F.unhex(F.sha2("normal", 256)).alias("sha"),
                    F.length("normal").alias("len"), F.spark_partition_id().cast("long").alias("run")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space; null counts as empty, and all
    empty texts are one group. The row with the longest original text stays, then the smallest id (a
    null id is the smallest). Rows with the same id and text are one group, and each of them has kept
    = true. An empty table gives an empty result; other columns are ignored.
    """
    base = saved(_digests(docs, id_col, text_col))
    runs = (base.agg(F.max("run")).first()[0] or 0) + 1
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").alias("i"))).alias("best")
    levels = [saved(base.groupBy("run", *KEY).agg(best, F.count("*").alias("n"))
                    .sortWithinPartitions("run", *KEY))]
    while runs > 1:
        runs = -(-runs // fan_in)
        merged = (levels[-1].withColumn("run", F.expr(f"run div {fan_in}")).groupBy("run", *KEY)
                  .agg(F.min("best").alias("best"), F.sum("n").alias("n")).sortWithinPartitions("run", *KEY))
        levels.append(saved(merged))
    won = levels[-1]
    for level in reversed(levels[:-1]):
        up = won.withColumnRenamed("run", "up")
        won = (level.select("run", *KEY, F.expr(f"run div {fan_in}").alias("up")).join(up, ["up", *KEY])
               .select("run", *KEY, "best", "n"))
    out = base.join(won, ["run", *KEY])
    return out.select(F.col("id").alias(id_col), F.col("best.i").alias("keep_id"), F.col("n").alias("group_size"),
                      F.col("id").eqNullSafe(F.col("best.i")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; of rows with the same id and text one stays."""
    sha, nth = fresh(docs, "sha_of_text"), fresh(docs, "row_of_key")
    stay = exact_groups(docs, id_col, text_col).filter("kept").select(F.col(id_col), F.col("text_sha256").alias(sha))
    tagged = docs.withColumn(sha, F.sha2(F.regexp_replace(text_or_empty(text_col), WHITE, ""), 256))
    from pyspark.sql import Window
    w = Window.partitionBy(id_col, sha).orderBy(F.length(text_or_empty(text_col)).desc())
    return (null_safe_semi(tagged, stay, [id_col, sha]).withColumn(nth, F.row_number().over(w))
            .filter(F.col(nth) == 1).select(*docs.columns))
