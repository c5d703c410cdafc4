"""Mixing sources to target weights by hash-threshold histograms.

A document's place is a hash of its id. A source takes every document a
whole number of times, and once more those whose hash lies below a threshold
that spends the rest of its budget. The threshold is found from sums of
tokens by source and hash bucket: a histogram of 4,096 sums gives the bucket
that the budget ends in, and only that one is refined by the next hash
digits. Then the documents are filtered against one threshold a source: none
is sorted, ranked or joined by its id, and mixes of a larger budget contain
those of a smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD_RE, stage

#: Hex digits of each level: 4,096 buckets of a source, then of a bucket.
LEVEL, LEVELS = 3, 3
#: Sources whose thresholds are broadcast (some 100 bytes each); those of more are joined, dealt over SALTS.
SOURCES, SALTS = 200_000, 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size -> and target: the sources, in code-point order,
    null last, weigh ``weights`` in turn and share ``share`` of all sizes; no
    target exceeds ``most`` times its source, the excess goes to the others
    by weight. There is one row per source, so its windows run in one task."""
    every = Window.partitionBy()
    ranked = Window.partitionBy().orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    sized = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.partitionBy().orderBy("ratio", F.col("source").isNull(), "source")
    filled = (
        sized.withColumn("k", F.row_number().over(by_ratio))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (share * F.sum("source_size").over(every) - F.col("spent")) / F.col("left_w"))
    )
    # the first source, by ratio, that the level of those after it does not fill
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("k", "level"))).over(every)
    return filled.withColumn("at", first).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("at.level") * F.col("w")).alias("target"))


def _place(id_col: str) -> Column:
    """The leading hex digits of a document's hash."""
    return F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, LEVEL * LEVELS)


def _name(source: Column) -> Column:
    """A source's name that is never null and not that of another."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def sizes(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Staged (doc_id, source, size, place) of every row."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_RE)), F.lit(0)).cast("long")
    return stage(spark, df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), _place(id_col).alias("place")), "sizes")


def thresholds(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """A staged row per source: mix_s (its name), source_size, target, whole
    (times that each document is taken), cut (documents whose place lies
    below it are taken once more). Its rows are sums; a source's histogram
    is one array of 4,096 sums."""
    per = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    now = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumn("whole", per.cast("long"))
    now = stage(spark, now.select(_name(F.col("source")).alias("mix_s"), "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"), F.lit("").alias("cut")), "budgets")
    digits = lambda i: F.conv(F.substring("place", 1 + LEVEL * i, LEVEL), 16, 10).cast("int")
    hexed = lambda b: F.lower(F.lpad(F.hex(b), LEVEL, "0"))
    for i in range(LEVELS):
        named = docs.select(_name(F.col("source")).alias("mix_s"), "place", "size", digits(i).alias("b"))
        if i:  # only the bucket in which each source's budget ends
            named = _meet(spark, named, now.select("mix_s", "cut")).where(F.substring("place", 1, LEVEL * i) == F.col("cut")).drop("cut")
        sums = named.groupBy("mix_s", "b").agg(F.sum("size").alias("n")).groupBy("mix_s").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("sums"))
        # the first bucket that the budget doesn't fill, and what is left of it there
        zero = F.struct(F.col("left").alias("left"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("n"))

        def step(acc, b):
            n = F.coalesce(F.try_element_at("sums", b), F.lit(0).cast("long"))
            fills = (acc["at"] < 0) & (acc["left"] > 0) & (n <= acc["left"])
            stops = (acc["at"] < 0) & ~fills
            return F.struct(F.when(fills, acc["left"] - n).otherwise(acc["left"]).alias("left"), F.when(stops, b).otherwise(acc["at"]).alias("at"), F.when(stops, n).otherwise(acc["n"]).alias("n"))

        end = F.aggregate(F.sequence(F.lit(0), F.lit((1 << 4 * LEVEL) - 1)), zero, step)
        met = now.join(sums, "mix_s", "left").withColumn("sums", F.coalesce("sums", F.create_map().cast("map<int,bigint>"))).withColumn("end", end)
        at, rest = F.when(F.col("end.at") < 0, F.lit(1 << 4 * LEVEL)).otherwise(F.col("end.at")), F.col("end.left")
        if i == LEVELS - 1:  # the last bucket is taken if that is nearer to the target
            at = at + F.when((F.col("end.at") >= 0) & (rest > 0) & (2 * rest >= F.col("end.n")), 1).otherwise(0)
        # a budget that fills all buckets ends beyond the last: "g" follows every hex digit
        text = F.when(at >= 1 << 4 * LEVEL, F.lit("g")).otherwise(hexed(at))
        cut = F.when(F.col("cut").endswith("g"), F.col("cut")).otherwise(F.concat("cut", text))
        now = stage(spark, met.select("mix_s", "source_size", "target", "whole", rest.alias("left"), cut.alias("cut")), "thresholds")
    return now


def _meet(spark: SparkSession, rows: DataFrame, few: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source, by mix_s: a broadcast of a
    counted number of sources, or a join in which each source is dealt over
    SALTS tasks."""
    if few.count() <= SOURCES:
        return rows.join(F.broadcast(few), "mix_s")
    salted = few.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("mix_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, ["mix_s", "mix_salt"]).drop("mix_salt")


def _times(place: Column) -> Column:
    return F.col("whole") + (place < F.col("cut")).cast("long")


def mix(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words,
    repeats counted) and times (how often the mix takes the document).

    size is the number of words (null text: 0). A source's sum of taken
    differs from its target by at most half of the documents of one leaf
    bucket (36 bits of hash), in practice half of one document. A null
    source is a source; null ids share one hash; rows with one id are taken
    or left together. An empty table gives no rows. Only the three named
    columns are read.
    """
    docs = sizes(spark, df, id_col, text_col, source_col)
    met = _meet(spark, docs.withColumn("mix_s", _name(F.col("source"))), thresholds(spark, docs, weights, share, most))
    return met.withColumn("times", _times(F.col("place"))).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times")


def take(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: every row of ``df`` as often as the mix takes it, with
    its own columns, as ``mix`` counts it. Each row is held against its
    source's threshold; texts are not shuffled."""
    docs = sizes(spark, df, id_col, text_col, source_col)
    cuts = thresholds(spark, docs, weights, share, most).select("mix_s", "whole", "cut")
    row = df.select(_name(F.col(source_col)).alias("mix_s"), _place(id_col).alias("mix_place"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    met = _meet(spark, row, cuts).withColumn("times", _times(F.col("mix_place")))
    return met.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")
