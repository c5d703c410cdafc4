"""SimHash near-duplicates through segment popcounts.

A 64-bit fingerprint is embedded as the bit counts of its sixteen 4-bit
segments. The Manhattan distance of two embeddings is a lower bound of the
Hamming distance, so fingerprints within 2 bits lie within 2 steps on that
grid, and then share a cell when each takes its own cell and those one step
away (two points two steps apart have a point between them). Pairs of a
shared cell are verified on the fingerprints themselves. Cells with more
than ``DENSE`` fingerprints are not paired but refined: their fingerprints
meet again on the grid of 2-bit segments, and, where that is dense too, on
that of single bits, whose cells hold at most 65 fingerprints, all within 2
bits of each other. Every level joins all pairs within 2 bits.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, lean, ready_python, stage

DENSE = 32
#: Tables of more rows are never broadcast, whatever size Spark expects: it takes exploded cells and compressed ids for as small as their files.
BROADCAST = 100_000
_PIECE = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def _pieces(text: bytes):
    """The words of a text, some MB at a time."""
    at, n = 0, len(text)
    while at < n:
        to = min(at + _PIECE, n)
        while to < n and text[to] not in _SPACE:
            to += 1
        yield text[at:to].split()
        at = to


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned SimHash of the word shingles of a text, repeats included."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for words in _pieces((text or b"").lower()):
        tail += words
        n = len(tail) - shingle + 1
        if n < 1:
            continue
        grams = map(b" ".join, zip(*(tail[i:] for i in range(shingle))))
        counts += _bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n))
        total += n
        tail = tail[n:]
    if not total and tail:
        counts, total = _bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(tail), 42)], np.uint64)), 1
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > total))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit; 255 rows at a time in bytes."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    return np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprints(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: str | None = None) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits in a long; with ``carry``, that
    string column too, as ``key``."""
    ready_python(spark, 8)
    key = ["key"] * bool(carry)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch["text"].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.array(fps, np.uint64).view(np.int64)), *(batch[k] for k in key)], ["doc_id", "fp", *key])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(carry).alias(k) for k in key))
    return source.mapInArrow(lean(run), "doc_id long, fp long" + ", key string" * bool(carry))


#: Cells by bits of a segment: SQL of the counts, each in its segment's own bits (no sum may carry beyond the sign), and a mask of these.
_COUNTS = {
    4: (" + ".join(f"(shiftrightunsigned(fp, {i}) & 1229782938247303441L)" for i in range(4)), 15),
    2: ("((fp & 6148914691236517205L) ^ (shiftrightunsigned(fp, 1) & 6148914691236517205L)) | shiftleft(fp & shiftrightunsigned(fp, 1) & 6148914691236517205L, 1)", 3),
    1: ("fp", 1),
}


def _cells(distinct: DataFrame, width: int) -> DataFrame:
    """(fp, cell): the fingerprint's cell and those one step away. A cell
    packs the counts (0 to ``width``) of its segments."""
    count, field = _COUNTS[width]
    f = f"(shiftrightunsigned(cell, s) & {field}L)"
    step = lambda test, by: f"if({f} {test}, cell ^ shiftleft({f} ^ ({f} {by}), s), NULL)"
    return distinct.selectExpr("fp", f"{count} AS cell").selectExpr(
        "fp", f"explode(array_compact(concat(array(cell), flatten(transform(sequence(0, {64 - width}, {width}), s -> array({step(f'< {width}', '+ 1')}, {step('> 0', '- 1')})))))) AS cell"
    )


def links(spark: SparkSession, distinct: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fingerprints
    within 2 bits. ``distinct`` has a row per fingerprint."""
    out, rest = None, distinct.select("fp")
    for width in _COUNTS:
        cells = _cells(rest, width)
        shared = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        near = stage(spark, cells.hint("merge").join(shared, "cell"), "near")
        few = near.where(F.col("n") <= DENSE) if width > 1 else near
        together = few.groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # DENSE or 65 at most
        if width > 1:
            pairs = together.selectExpr("fps", "explode(fps) AS a").selectExpr("a", "explode(filter(fps, b -> b > a AND bit_count(a ^ b) <= 2)) AS b")
        else:
            pairs = together.selectExpr("fps[0] AS a", "explode(slice(fps, 2, 65)) AS b")
        out = pairs if out is None else out.union(pairs)
        rest = near.where(F.col("n") > DENSE).select("fp").distinct()
    return out.distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component. Alternating
    large-star and small-star steps; each round is staged."""

    def star(e: DataFrame, large: bool, hint) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = hint(both).join(low, "a")
        if large:
            out = out.where("b > a").select(F.col("b").alias("x"), "m")
        else:
            out = out.where("b < a").select(F.col("b").alias("x"), "m").union(low.where("m < a").select(F.col("a").alias("x"), "m"))
        return out.where("x <> m").selectExpr("m AS a", "x AS b").distinct()

    now = stage(spark, edges.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").where("a <> b").distinct(), "edges")
    while not now.isEmpty():
        hint = (lambda df: df.hint("merge")) if now.count() > BROADCAST else (lambda df: df)
        was, now = now, stage(spark, star(star(now, True, hint), False, hint), "edges")
        if hint(now).join(was, ["a", "b"], "left_anti").isEmpty() and hint(was).join(now, ["a", "b"], "left_anti").isEmpty():
            break
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).union(now.select("a", "a").distinct())


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and
    component_id, the least doc_id reachable over links of 2 bits or fewer.

    A text without words, or null, has fingerprint 0 and links like any
    other. Null ids are not candidates for component_id (null where a
    component has no other). Repeated rows are kept. An empty table gives no
    rows. Only the two named columns are read.
    """
    docs = stage(spark, fingerprints(spark, df, id_col, text_col), "fingerprints")
    distinct = stage(spark, docs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(spark, links(spark, distinct))
    joined = distinct.hint("merge").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with its own columns: that
    of the least id (null last), then by a hash of id and text. Of rows equal
    in both one stays too, any if other columns differ; a null text counts as
    empty.

    Rows are known by that hash (128 bits), so groups are formed without the
    texts, which are shuffled once, to meet the hashes of the rows that stay
    in a table of these; only rows that share a hash are sorted.
    """
    key = fresh(df, "row_key")
    of = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    docs = stage(spark, fingerprints(spark, df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), of.alias("key")), "doc_id", "text", carry="key"), "fingerprints")
    roots = components(spark, links(spark, stage(spark, docs.select("fp").distinct(), "distinct")))
    rooted = docs.hint("merge").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least")).select(F.col("least.key").alias(key))
    rows = docs.groupBy(F.col("key").alias(key)).agg(F.count("*").alias("n"))
    first = stage(spark, first.hint("merge").join(rows, key), "first")
    keyed = df.withColumn(key, of)
    meet = lambda found: keyed.join(found.select(key).hint("shuffle_hash"), key, "left_semi")
    return meet(first.where("n = 1")).unionByName(meet(first.where("n > 1")).dropDuplicates([key])).drop(key)
