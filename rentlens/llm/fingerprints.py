"""Winnowed fingerprints of documents (DataFrame operations only).

A text is lower-cased and cut into words at ASCII white space. A word of more than ``LONG`` characters (writing
without white space, minified code, one long line) counts as so many words as it has runs of ``PIECE`` characters,
one from each of its characters on. Every run of ``k`` words has a 64-bit hash, and
of every ``w`` neighbouring hashes the least is chosen, the rightmost of equal ones. A run of w + k - 1
words that two texts share therefore gives them a common hash, at positions that are kept. A text with
fewer than k words has one hash for the whole; with fewer than w hashes the least of all is chosen; a text
without words has none.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rentlens.llm.common import text_or_empty

K, W = 3, 4
#: Longer words are rolled over by characters, in runs of so many.
LONG, PIECE = 48, 8
#: Rows in a bucket of neighbouring ids, and the most buckets (their least ids go through the driver).
BUCKET_ROWS, MOST_BUCKETS = 2_000, 65_536


def _least(low: Column, high: Column, of: Column) -> Column:
    """The position in ``of`` with the smaller value, the right one of equals."""
    return F.when(F.get(of, high) <= F.get(of, low), high).otherwise(low)


def _window_least(i: Column, width: int, of: Column) -> Column:
    if width == 1:
        return i
    half = width // 2
    return _least(_window_least(i, half, of), _window_least(i + half, width - half, of), of)


def _word_hashes(words: Column) -> Column:
    """The hashes of words, and of long words' runs of characters."""
    def rolled(word: Column) -> Column:
        return F.get(F.transform(F.array(F.transform(F.split(word, ""), lambda c: F.xxhash64(c))), lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - PIECE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(PIECE)]))), F.lit(0))
    each = F.transform(words, lambda x: F.when(F.length(x) > LONG, rolled(x)).otherwise(F.array(F.xxhash64(x))))
    return (F.when(F.exists(words, lambda x: F.length(x) > LONG), F.flatten(each))
            .otherwise(F.transform(words, lambda x: F.xxhash64(x))))


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """``df`` and a column ``out``: struct(positions, hashes), the chosen positions (of words, from 0, in order)
    and their hashes. Null counts as empty."""
    words = F.filter(F.split(F.lower(text_or_empty(text)), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    v, h, g, p = (f"__{out}_{x}" for x in "vhgp")
    hashed, gram, at = F.col(h), F.col(g), F.col(p)
    df = df.withColumn(v, words).withColumn(h, _word_hashes(F.col(v)))
    grams = F.when(F.size(hashed) >= k, F.transform(
        F.sequence(F.lit(0), F.size(hashed) - k), lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(k)])))
    df = df.withColumn(g, grams.when(F.size(hashed) > 0, F.array(F.xxhash64(hashed)))
                       .otherwise(F.array().cast("array<bigint>")))
    some = F.when(F.size(gram) >= w, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(gram) - w), lambda i: _window_least(i, w, gram))))
    few = F.array(F.size(gram) - F.array_position(F.reverse(gram), F.array_min(gram)).cast("int"))
    df = df.withColumn(p, some.when(F.size(gram) > 0, few).otherwise(F.array().cast("array<int>")))
    chosen = F.struct(at.alias("positions"), F.transform(at, lambda i: F.get(gram, i)).alias("hashes"))
    return df.withColumn(out, chosen).drop(v, h, g, p)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes; two empty ones are alike."""
    x, y = a["hashes"], b["hashes"]
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / both)


def digest(a: Column) -> Column:
    """A fingerprint as one string: the SHA-256 of its positions and hashes."""
    return F.sha2(F.concat_ws(" ", F.array_join(a["positions"].cast("array<string>"), ","),
                              F.array_join(a["hashes"].cast("array<string>"), ",")), 256)


def _order_key(docs: DataFrame, order: str, low, high) -> Column:
    """A double that never falls when ``order`` rises (numbers: themselves; strings: six bytes after what all begin
    with), nulls before all."""
    key = F.col(order)
    if isinstance(docs.schema[order].dataType, StringType):
        rest = F.substring(key, len(commonprefix([low or "", high or ""])) + 1, 6)
        key = F.conv(F.rpad(F.substring(F.hex(F.encode(rest, "UTF-8")), 1, 12), 12, "0"), 16, 10)
    return F.coalesce(key.cast("double"), F.lit(float("-inf")))


def with_buckets(docs: DataFrame, order: str) -> DataFrame:
    """``docs`` and __bucket, which never falls when ``order`` rises: about BUCKET_ROWS rows each however the values are
    spread, for the cuts are quantiles (within a quarter of a bucket). Equal values share a bucket."""
    low, high, n = docs.agg(F.min(order), F.max(order), F.count("*")).first()
    buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    key = _order_key(docs, order, low, high)
    cuts = docs.select(key.alias("k")).approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    cuts = sorted({c for c in cuts if c > float("-inf")})
    if not cuts:
        return docs.withColumn("__bucket", F.lit(0))
    limits = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    # the number of cuts that the key reaches, found by halving
    reached = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(limits, at + step - 1) <= F.col("__key"), at + step).otherwise(at))
    return docs.withColumn("__key", key).withColumn("__bucket", reached).drop("__key")


def with_next(docs: DataFrame, order: str, ties: str, carry: list[str], there=lambda df: df) -> DataFrame:
    """``docs`` and the columns next_<c> for c in ``carry``, of the next row by ``order`` (numbers or strings; nulls first,
    then by ``ties``); after the last row comes the first. The rows are cut into buckets of neighbours; the first
    row of each bucket is also sent to the bucket before it, so no task sees more than a bucket. ``there`` adds
    columns where rows have arrived, so that they need not be shuffled."""
    placed = with_buckets(docs, order)
    text = isinstance(docs.schema[order].dataType, StringType)

    def shown(c: Column) -> Column:  # without commas
        return F.coalesce(F.hex(F.encode(c, "UTF-8")) if text else c.cast("string"), F.lit("null"))
    least = F.when(F.count(F.when(F.col(order).isNull(), 1)) == 0, F.min(order))
    firsts = dict(map(tuple, placed.groupBy("__bucket").agg(shown(least)).collect()))  # at most MOST_BUCKETS
    filled = sorted(firsts)
    before = dict(zip(filled, filled[-1:] + filled[:-1]))
    lists = [",".join(str(d.get(b, "")) for b in range(max(filled, default=0) + 1)) for d in (firsts, before)]
    first_at, send_to = (F.split(F.lit(s), ",") for s in lists)
    is_first = F.get(first_at, F.col("__bucket")) == shown(F.col(order))
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(False).alias("sent"))
    sent = F.struct(F.get(send_to, F.col("__bucket")).cast("int").alias("bucket"), F.lit(True).alias("sent"))
    dealt = placed.withColumn("__to", F.explode(F.when(is_first, F.array(own, sent)).otherwise(F.array(own))))
    dealt = dealt.withColumns({"__bucket": F.col("__to.bucket"), "__sent": F.col("__to.sent")}).drop("__to")
    w = Window.partitionBy("__bucket").orderBy("__sent", order, ties)
    return (there(dealt.repartition("__bucket")).withColumns({f"next_{c}": F.lead(c).over(w) for c in carry})
            .filter("not __sent").drop("__bucket", "__sent"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_chars, edited_text's SHA-256, both fingerprints, and the likeness
    of the text's fingerprint to that of its edited text and that of the next document.

    The edited text has its last n_chars / 4 (rounded down) code points replaced by the first as many, or all, of
    the next document's by ascending id (a number or a string). Null counts as empty; null ids come first; rows with the same id follow
    each other by text. One row alone is its own next. An empty table gives an empty result; other columns are
    ignored.
    """
    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = with_next(slim, "id", "text", ["text", "own"], lambda df: with_fingerprint(df, "text", "own", k, w))
    n = F.length("text")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(length(text) - length(text) div 4 as int))"),
                                              F.expr("substring(next_text, 1, cast(length(text) div 4 as int))")))
    rows = with_fingerprint(rows.select("id", n.cast("long").alias("n_chars"), "own", "next_own", "edited"),
                            "edited", "new", k, w)
    return rows.select(F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       F.col("own").alias("fingerprint"), F.col("new").alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("new")).alias("near_edited"),
                       likeness(F.col("own"), F.col("next_own")).alias("near_next"))
