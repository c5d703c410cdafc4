"""Substring removal over a sparse suffix array (bytes).

The suffixes kept are those that start at anchors (see ``anchors``): every
window of ``W`` bytes holds one, so no repeat is missed, while a full suffix
array of the corpus would need some 16 bytes of shuffle per byte of text.
Sampled splitters range-partition them by their leading bytes, and anchors of
one lead by their hash; equal anchors never part, so windows to compare never
lie across a boundary. Anchors that very many blocks hold are dealt by the
bytes beside them instead (``anchors.HOT``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import anchors, covered, find_repeats
from .blocks import Block, Exchange, make_blocks
from .shared import lean, mix64

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SAMPLED_BLOCKS, SAMPLED_PER_BLOCK = 64, 256


def _bytes(block: Block):
    return block.data, block.starts, block.ends


def sampled_splitters(blocks: DataFrame, W: int, k: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters of the anchors (leading bytes, hash), from at most 64 blocks
    chosen by hash and 256 anchors of each. They balance shards; results
    don't depend on them."""

    def run(batches):
        for batch in batches:
            for payload in batch["payload"]:
                block = Block(payload.as_py())
                pos, key = anchors(*_bytes(block), W, k)
                some = np.argsort(key)[:SAMPLED_PER_BLOCK]
                view = np.concatenate([block.data, np.zeros(8, np.uint8)])
                lead = np.lib.stride_tricks.sliding_window_view(view, 8)[pos[some]]
                lead = np.ascontiguousarray(lead).view(">u8").ravel().astype(np.uint64)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array([np.stack([lead, mix64(key[some])]).tobytes()], pa.binary())})

    some = blocks.select("block").orderBy(F.xxhash64("block")).limit(SAMPLED_BLOCKS)
    rows = blocks.select("block", "payload").join(some, "block", "left_semi").select("payload").mapInArrow(lean(run), "anchor binary").collect()
    lead, key = np.concatenate([np.zeros((2, 0), np.uint64), *(np.frombuffer(r.anchor, np.uint64).reshape(2, -1) for r in rows)], axis=1)
    if not len(lead):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    order = np.lexsort((key, lead))[np.arange(1, shards) * len(lead) // shards]
    return lead[order], key[order]


def dedup_substrings(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", W: int = 50, k: int = 20, block_bytes: int = 4 << 20, shard_bytes: int = 12 << 20, texts: bool = False) -> DataFrame:
    """Remove every byte covered by a W-byte string that also starts in a
    document with a smaller id.

    One row per document: ``SCHEMA``, and the kept bytes as ``kept`` with
    ``texts``. A null text is empty; a null id ranks after all others and
    stays null; rows with equal ids don't remove each other's bytes. Texts
    shorter than W stay. An empty table gives no rows. Only the two named
    columns are read.
    """
    blocks = make_blocks(spark, df, id_col, text_col, block_bytes)
    exchange = Exchange(blocks, shard_bytes)

    def finish(block, sym, starts, ends, dup):
        gone = covered(dup, W)
        total = np.concatenate([[0], np.cumsum(gone)])
        n_removed = total[ends] - total[starts]
        removed, spans, sums, kept = n_removed.tolist(), [], [], []
        for s, e, n in zip(starts.tolist(), ends.tolist(), removed):
            part = sym[s:e]
            if n:
                g = gone[s:e]
                spans.append(int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])))
                part = part[~g]
            else:
                spans.append(0)
            part = part.tobytes()
            sums.append(hashlib.sha256(part).hexdigest())
            if texts:
                kept.append(part)
        out = {"doc_id": block.id_column(), "n_bytes": pa.array(ends - starts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sums, pa.string())}
        if texts:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    return find_repeats(exchange, _bytes, W, k, "smaller", finish, SCHEMA + ", kept binary" * texts, sampled_splitters(blocks.df, W, k, exchange.shards))
