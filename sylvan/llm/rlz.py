"""Duplicate spans by relative Lempel-Ziv parsing (words).

A shard is a reference block. Its index holds, in words, the suffixes of every
document piece whose anchor falls to it and the reversed prefixes before the
anchors, both sorted with their common prefixes. Each piece is factored
against all pieces of the index greedily from the left: the factor at a place
is the longest match that starts there and runs through the anchor, with a
source other than the piece itself. A factor of W words or more is a
duplicate span. The greedy factor may end inside a repeat that another source
continues, so the parse goes on with the first window that crosses the
factor's end, not behind it: every window is either inside a long factor or
has been asked for at its own start, which makes the result exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .anchors import covered, find_repeats, sorted_lcp
from .blocks import Block, Exchange, make_blocks, word_hashes

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_symbols(block: Block):
    """A 64-bit symbol for each word, and the documents' bounds in words."""
    sym, ends = word_hashes(block)
    return sym, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)


def factors(ctx: np.ndarray, l: np.ndarray, r: np.ndarray, W: int, k: int) -> np.ndarray:
    """The greedy parse of all pieces: rows of (piece, start before the
    anchor, source, length), for each start that was asked for and has a
    factor of W words or more."""
    n, far = len(ctx), W - k
    none = np.zeros((0, 4), np.int64)
    if n < 2:
        return none
    after, before = ctx[:, far:], ctx[:, far - 1 :: -1] if far else np.zeros((n, 1), ctx.dtype)
    order_r, lcp_r = sorted_lcp(after)
    order_l, lcp_l = sorted_lcp(before)
    rank = np.empty(n, np.int64)
    rank[order_r] = np.arange(n)

    def longest(order, lcp):
        best = np.empty(n, np.int64)
        best[order] = np.maximum(lcp, np.append(lcp[1:], 0))
        return best

    # no other piece matches further to either side than the neighbours in order do
    now = np.minimum(longest(order_l, lcp_l), np.minimum(l, far))
    stop = np.maximum(0, W - np.minimum(longest(order_r, lcp_r), r))
    side, out = np.empty(n, np.int64), []
    for o in range(far, -1, -1):
        asked = (now == o) & (stop <= o)
        if not asked.any():
            continue
        side[order_l] = np.cumsum(lcp_l < o)  # class of the o words before the anchor
        wanted = np.zeros(n + 1, bool)
        wanted[side[asked]] = True
        pool = np.flatnonzero(wanted[side] & (l >= o) & (r >= W - o))
        pool = pool[np.lexsort((rank[pool], side[pool]))]
        match = np.zeros(len(pool) + 1, np.int64)  # with the one before in suffix order
        for a in range(1, len(pool), 1 << 15):
            x, y = pool[a : a + (1 << 15)], pool[a - 1 : a + (1 << 15) - 1][: len(pool[a : a + (1 << 15)])]
            same = after[x] == after[y]
            reach = np.where(same.all(axis=1), after.shape[1], np.argmin(same, axis=1))
            match[a : a + len(x)] = np.where(side[x] == side[y], np.minimum(reach, np.minimum(r[x], r[y])), 0)
        back = match[:-1] >= match[1:]
        reach = np.maximum(match[:-1], match[1:])
        place = np.arange(len(pool))
        source = pool[np.where(back, np.maximum(place - 1, 0), np.minimum(place + 1, len(pool) - 1))]
        mine = asked[pool]
        row, reach, source = pool[mine], reach[mine], source[mine]
        long = o + reach >= W
        out.append(np.stack([row[long], np.full(int(long.sum()), o), source[long], o + reach[long]], 1))
        now[asked] = o - 1
        now[row[long]] = W - reach[long] - 1
    return np.concatenate(out) if out else none


def greedy_spans(ctx: np.ndarray, l: np.ndarray, r: np.ndarray, ids: np.ndarray, groups: np.ndarray, W: int, k: int, rule: str) -> np.ndarray:
    """Masks of the windows inside long factors, as ``anchors.repeated``
    gives them for "any"."""
    mask = np.zeros(len(ctx), np.uint64)
    found = factors(ctx, l, r, W, k)
    if len(found):
        row, o, _, length = found.T
        low = np.maximum(0, W - (length - o))
        one = np.uint64(1)
        bits = ((one << (o - low + 1).astype(np.uint64)) - one) << low.astype(np.uint64)
        np.bitwise_or.at(mask, row, bits)
    return mask


def dedup_spans(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", W: int = 35, k: int = 8, block_bytes: int = 4 << 20, shard_bytes: int = 8 << 20, texts: bool = False) -> DataFrame:
    """Remove every word covered by a window of W words that also starts
    anywhere else, in the same document or another.

    One row per document: ``SCHEMA``, and the kept words as ``kept`` with
    ``texts``. A null text has no words; a null id stays null; repeated rows
    are separate documents and remove each other's windows. Texts of fewer
    than W words stay. An empty table gives no rows. Only the two named
    columns are read. Words are compared by 64 bits of hash, whole contexts in
    the first round by 128.
    """
    blocks = make_blocks(spark, df, id_col, text_col, block_bytes)

    def finish(block, sym, starts, ends, dup):
        gone = covered(dup, W)
        total = np.concatenate([[0], np.cumsum(gone)])
        sums, kept = [], []
        for s, e, text in zip(starts.tolist(), ends.tolist(), block.texts()):
            words = text.split()
            if total[e] > total[s]:
                words = [w for w, g in zip(words, gone[s:e].tolist()) if not g]
            part = b" ".join(words)
            sums.append(hashlib.sha256(part).hexdigest())
            if texts:
                kept.append(part)
        out = {"doc_id": block.id_column(), "n_words": pa.array(ends - starts, pa.int64()), "n_removed": pa.array(total[ends] - total[starts], pa.int64()), "kept_sha256": pa.array(sums, pa.string())}
        if texts:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    return find_repeats(Exchange(blocks, shard_bytes), word_symbols, W, k, "any", finish, SCHEMA + ", kept binary" * texts, judge=greedy_spans)
