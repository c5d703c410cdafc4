"""Benchmark decontamination by size-partitioned MinHash containment.

An item is in a document if the document holds at least 0.8 of the item's
distinct shingles of five words. Of n shingles, at most m = n - ceil(0.8 n)
may be missing, so the document must hold one of any m + 1 of them. The
index keeps those of least hash: a bottom-k MinHash sketch whose k grows
with the item's size, so none is missed. Items are partitioned by size;
a partition's largest kept hash bounds the hashes with which documents probe
it, about a fifth of them for long items. What meets is verified on the
shingles themselves.

A benchmark of up to ``PASSES`` blocks is broadcast block by block, and the
documents pass each. Beyond that the sketches are a table: documents probe a
filter of all their hashes (a bitmap of a fixed size), what passes is joined
by hash, and the pairs that meet are verified with the texts of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import _gram_hash
from .shared import Shared, fresh, lean, lean_group, mix64, ready_python, stage

MATCHES = "doc_id long, item_id long, n_shingles long, n_found long, containment double"
#: An index block that executors hold at once: items and bytes, about at most.
ITEMS, BYTES = 20_000, 16 << 20
PASSES = 8
#: Segments of the filter, and bits of each (a power of 2): 64 MB in all.
SEGMENTS, SEGMENT_BITS = 1 << 10, 1 << 19
SLICE = 500  # items that a document is verified against at once


def shingles(words: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def _hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return mix64(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))


class Index:
    """Sketches of a block of items: by shingle length and size class, the
    kept hashes in order and the item of each."""

    def __init__(self, rows: list[tuple[int, bytes]], size: int = 5, num: int = 4, den: int = 5):
        self.items, sketch, known = [], {}, {}
        for item, text in rows:
            words = text.lower().split()
            if not words:
                continue
            m = min(size, len(words))
            grams = shingles(words, m)
            need = -(-num * len(grams) // den)
            h = np.unique(_gram_hash(_hashes(words, known), m))
            at = len(self.items)
            self.items.append((item, grams, need))
            sketch.setdefault((m, len(grams).bit_length()), []).extend((int(x), at) for x in h[: len(grams) - need + 1])
        self.parts = []
        for (m, _), pairs in sorted(sketch.items()):
            pairs.sort()
            self.parts.append((m, np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])))

    def match(self, text: bytes, known: dict[bytes, int]) -> list[tuple[int, int, int]]:
        """(item, its shingles, those found) of the items in a text."""
        words = text.lower().split()
        if not words or not self.parts:
            return []
        own, grams, near = _hashes(words, known), {}, set()
        for m, keys, items in self.parts:
            if len(words) < m:
                continue
            if m not in grams:
                grams[m] = _gram_hash(own, m)
            h = grams[m][grams[m] <= keys[-1]]
            at = np.searchsorted(keys, h)
            for x in np.unique(h[keys[at] == h]):
                lo, hi = np.searchsorted(keys, [x]), np.searchsorted(keys, [x], side="right")
                near.update(items[lo[0] : hi[0]].tolist())
        sets: dict[int, set[bytes]] = {}
        found = []
        for i in sorted(near):
            item, want, need = self.items[i]
            m = next(iter(want)).count(b" ") + 1
            if m not in sets:
                sets[m] = shingles(words, m)
            n = len(want & sets[m])
            if n >= need:
                found.append((item, len(want), n))
        return found


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(item, text) of the items with a text, and the index blocks that they fill."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.encode(F.col(text_col).cast("string"), "utf-8").alias("text")).where("text IS NOT NULL")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return rows, max(1, -(-n // ITEMS), -(-size // BYTES))


def index_blocks(spark: SparkSession, rows: DataFrame, blocks: int):
    """Broadcast indexes of bounded size that together hold every item."""
    ready_python(spark)
    if blocks > 1:  # equal items are dealt over the blocks too
        rows = stage(spark, rows.withColumn("place", F.monotonically_increasing_id()), "items")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("place"), F.lit(blocks)))
    for b in range(blocks):
        part = (rows.where(F.col("own") == b) if blocks > 1 else rows).collect()
        yield Shared(spark, Index([(r.item, bytes(r.text)) for r in part]))


def _filter(spark: SparkSession, sketch: DataFrame) -> Shared:
    """Bitmaps by segment of the hashes, two bits a hash."""

    def build(table: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT_BITS, np.uint8)
        for at in _bits(table["h"].to_numpy().view(np.uint64)):
            bits[at] = 1
        return pa.table({"segment": table["segment"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    rows = sketch.select(F.shiftrightunsigned("h", 64 - (SEGMENTS.bit_length() - 1)).cast("int").alias("segment"), "h").distinct()
    found = rows.groupBy("segment").applyInArrow(lean_group(build), "segment int, bits binary").collect()  # SEGMENTS at most
    return Shared(spark, {r.segment: np.frombuffer(bytes(r.bits), np.uint8) for r in found})


def _bits(h: np.ndarray) -> list[np.ndarray]:
    width = SEGMENT_BITS.bit_length() - 1
    return [((h >> np.uint64(i * width)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64) for i in (0, 1)]


def _passes(h: np.ndarray, bitmaps: dict[int, np.ndarray]) -> np.ndarray:
    """Which hashes the filter doesn't rule out."""
    out, segment = np.zeros(len(h), bool), (h >> np.uint64(64 - (SEGMENTS.bit_length() - 1))).astype(np.int64)
    order = np.argsort(segment)
    cut = np.searchsorted(segment[order], np.arange(SEGMENTS + 1))
    for s in np.unique(segment).tolist():
        if s in bitmaps:
            mine = order[cut[s] : cut[s + 1]]
            ok = np.ones(len(mine), bool)
            for at in _bits(h[mine]):
                ok &= (bitmaps[s][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            out[mine] = ok
    return out


def _joined(spark: SparkSession, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(did, item, n, k) for docs (did, text), by a join of the sketches."""
    ready_python(spark)
    texts = stage(spark, rows.select("text").distinct().withColumn("iid", F.monotonically_increasing_id()), "items")
    names = rows.join(texts, "text").select("item", "iid")

    def sketches(batches):
        for batch in batches:
            out = []
            for i, t in zip(batch["iid"].to_pylist(), batch["text"]):
                for m, keys, _ in Index([(i, t.as_py())]).parts:
                    out.append((np.full(len(keys), m, np.int32), keys.view(np.int64), np.full(len(keys), i)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *(r[j] for r in out)])) for j, k in enumerate((np.int32, np.int64, np.int64))], ["m", "h", "iid"])

    sketch = stage(spark, texts.mapInArrow(lean(sketches), "m int, h long, iid long"), "sketch")
    sizes = [r.m for r in sketch.select("m").distinct().collect()]  # five at most
    bitmaps = _filter(spark, sketch)

    def probes(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for i, t in zip(batch["did"].to_pylist(), batch["text"].cast(pa.binary())):
                words = (t.as_py() or b"").lower().split()
                own = _hashes(words, known)
                for m in sizes:
                    if len(words) >= m:
                        h = np.unique(_gram_hash(own, m))
                        h = h[_passes(h, bitmaps.value)]
                        out.append((np.full(len(h), i), np.full(len(h), m, np.int32), h.view(np.int64)))
                _cut(known)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *(r[j] for r in out)])) for j, k in enumerate((np.int64, np.int32, np.int64))], ["did", "m", "h"])

    pairs = stage(spark, docs.mapInArrow(lean(probes), "did long, m int, h long").join(sketch, ["m", "h"]).select("did", "iid").distinct(), "pairs")
    slices = pairs.groupBy("did").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    listed = pairs.join(slices, "did").withColumn("own", F.pmod(F.xxhash64("iid"), F.col("slices"))).join(texts, "iid").groupBy("did", "own").agg(F.collect_list(F.struct("iid", F.col("text").alias("item"))).alias("items"))

    def verify(batches):
        for batch in batches:
            out = []
            for i, t, items in zip(batch["did"].to_pylist(), batch["text"].cast(pa.binary()), batch["items"].to_pylist()):
                out += [(i, *x) for x in Index([(x["iid"], x["item"]) for x in items]).match(t.as_py() or b"", {})]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], ["did", "iid", "n", "k"])

    found = docs.join(listed, "did").select("did", "text", "items").mapInArrow(lean(verify), "did long, iid long, n long, k long")
    return found.join(names, "iid").select("did", "item", "n", "k")


def _cut(known: dict) -> None:
    if len(known) > 500_000:
        known.clear()


def find_items(spark: SparkSession, df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item that it contains (``MATCHES``).

    Words are lower-cased (A-Z). An item of fewer than five words is one
    shingle of them all; an item without words, or null, is in no document,
    and a null text contains nothing. Null ids are kept; repeated documents
    and items match each. Only the named columns are read.
    """
    out = None
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, blocks = _items(benchmark, "item_id", "text")
    if blocks > PASSES:
        docs = stage(spark, docs.withColumn("did", F.monotonically_increasing_id()), "documents")
        found = _joined(spark, docs.select("did", "text"), rows)
        return docs.select("did", "id").join(found, "did").select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("n").alias("n_shingles"), F.col("k").alias("n_found"), (F.col("k") / F.col("n")).alias("containment"))
    for index in index_blocks(spark, rows, blocks):

        def run(batches, index=index):
            known: dict[bytes, int] = {}
            for batch in batches:
                rows = []
                for i, t in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary())):
                    rows += [(i, item, n, k, k / n) for item, n, k in index.value.match(t.as_py() or b"", known)]
                    _cut(known)
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate([pa.int64()] * 4 + [pa.float64()])], ["doc_id", "item_id", "n_shingles", "n_found", "containment"])

        part = docs.mapInArrow(lean(run), MATCHES)
        out = part if out is None else out.union(part)
    return out


def decontaminate(spark: SparkSession, df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose text contains an item; rows pass through
    unchanged, whatever their columns. A null or empty text contains nothing
    and stays, as do all rows where the benchmark is empty; repeated rows are
    judged each."""
    rows, blocks = _items(benchmark, "item_id", "text")
    if blocks > PASSES:
        key = fresh(df, "did")
        docs = stage(spark, df.withColumn(key, F.monotonically_increasing_id()), "documents")
        found = _joined(spark, docs.select(F.col(key).alias("did"), F.col(text_col).cast("string").alias("text")), rows)
        return docs.join(found.select(F.col("did").alias(key)).distinct(), key, "left_anti").drop(key)
    for index in index_blocks(spark, rows, blocks):

        def run(batches, index=index):
            known: dict[bytes, int] = {}
            for batch in batches:
                keep = []
                for t in batch[text_col].cast(pa.binary()):
                    keep.append(not index.value.match(t.as_py() or b"", known))
                    _cut(known)
                yield batch.filter(pa.array(keep, pa.bool_()))

        df = df.mapInArrow(lean(run), df.schema)
    return df
