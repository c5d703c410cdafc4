"""Documents packed into blocks, and blocks that ask keyed shards.

A block holds whole documents of a few MB. Operators that need facts about
keys of the whole corpus (does this n-gram occur elsewhere? how often?) let
each block send its sorted distinct keys to shards by key range, and each
shard answers every block with an array in the order of its keys. Only
blobs cross the shuffle: a hot key costs one entry per block, however often
it occurs, and no group of rows is ever gathered per key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, lean_group, lean_pair, mix64, ready_python, stage

NULL_ID = np.iinfo(np.int64).max
BLOCK_SCHEMA = "bundle long, block long, n_bytes long, payload binary"
BLOB_SCHEMA = "shard int, block long, blob binary"  # block: of the bundle
BUCKETS = 50_000  # files that a task reads as one, at most
LEAST_BLOB = 2048  # bytes of text for each byte of the product of a bundle and a shard


class Block:
    """ids (a null id is NULL_ID), groups, document starts and the bytes."""

    def __init__(self, payload: bytes):
        raw = zstandard.ZstdDecompressor().decompress(payload)
        n = int.from_bytes(raw[:8], "little")
        self.n = n
        self.ids = np.frombuffer(raw, np.int64, n, 8)
        self.null = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(bool)
        self.groups = np.frombuffer(raw, np.uint64, n, 8 + 9 * n)
        lengths = np.frombuffer(raw, np.int64, n, 8 + 17 * n)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.base = 8 + 25 * n
        self.raw = raw
        self.data = np.frombuffer(raw, np.uint8, int(lengths.sum()), self.base)

    def texts(self) -> Iterator[bytes]:
        view = memoryview(self.raw)
        for s, e in zip(self.starts.tolist(), self.ends.tolist()):
            yield bytes(view[self.base + s : self.base + e])

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null)


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_ODD = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    _BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_STRETCH = 1 << 20


def word_hashes(block: Block, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, from prefix sums of a polynomial of its
    bytes, some MB at a time, and the number of words before each document's
    end; A-Z lower-cased if asked."""
    data, n = block.data, len(block.data)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = block.ends > block.starts  # a document's bounds end words too
    first[block.starts[some]] |= inside[block.starts[some]]
    last[block.ends[some] - 1] |= inside[block.ends[some] - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), np.uint64)
    cut = np.append(np.searchsorted(start, np.arange(0, n, _STRETCH)), len(start))
    table = _BYTE[_LOWER] if lower else _BYTE
    up = down = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if i == j:
                continue
            lo, hi = int(start[i]), int(stop[j - 1])
            if hi - lo >= len(up):
                up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(hi - lo, _STRETCH), x, np.uint64))]) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data[lo:hi]] * up[: hi - lo], dtype=np.uint64)])
            a, b = start[i:j] - lo, stop[i:j] - lo
            out[i:j] = mix64((total[b] - total[a]) * down[a] ^ mix64((b - a).astype(np.uint64)))
    return out, np.searchsorted(start, block.ends)


def _payload(ids: list, groups: list, texts: list[bytes]) -> bytes:
    n = len(ids)
    parts = [
        n.to_bytes(8, "little"),
        np.array([NULL_ID if i is None else i for i in ids], np.int64).tobytes(),
        np.array([i is None for i in ids], np.uint8).tobytes(),
        np.array([g or 0 for g in groups], np.int64).view(np.uint64).tobytes(),
        np.array([len(t) for t in texts], np.int64).tobytes(),
        *texts,
    ]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


@dataclass
class Blocks:
    """Staged blocks, the bytes of all their source texts, and blocks a bundle."""

    df: DataFrame
    total: int
    size: int
    buckets: int


def make_blocks(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, block_bytes: int, group: F.Column | None = None, total: int | None = None) -> Blocks:
    """Stage ``df`` as blocks of about ``block_bytes`` of text (one document
    at least). A null text is an empty one; a null id is kept as null.
    ``group`` (a long) may tie documents, such as the pages of a host;
    ``total`` are the bytes of text, counted if not given.

    The table is bucketed by bundle, so blocks meet their answers where they
    lie: only the answers are shuffled."""
    if total is None:
        total = text_bytes(df, text_col)
    size = bundle_size(total, block_bytes)
    buckets = min(BUCKETS, max(1, total // (block_bytes * size)))

    def rows(batches):
        part, seq = TaskContext.get().partitionId() << 32, 0
        ids, groups, texts, n = [], [], [], 0
        for batch in batches:
            for i, g, t in zip(batch["id"].to_pylist(), batch["grp"].to_pylist(), batch["text"].cast(pa.binary())):
                t = t.as_py() or b""
                if texts and n + len(t) > block_bytes:
                    yield flush(part + seq, ids, groups, texts, n)
                    seq, ids, groups, texts, n = seq + 1, [], [], [], 0
                ids.append(i), groups.append(g), texts.append(t)
                n += len(t)
        if texts:
            yield flush(part + seq, ids, groups, texts, n)

    def flush(block, ids, groups, texts, n):
        return pa.RecordBatch.from_pydict({"bundle": [bundle_of(block, size)], "block": [block], "n_bytes": [n], "payload": pa.array([_payload(ids, groups, texts)], pa.binary())})

    ready_python(spark)
    source = df.select(
        F.col(id_col).cast("long").alias("id"),
        (group if group is not None else F.lit(0)).cast("long").alias("grp"),
        F.col(text_col).cast("string").alias("text"),
    )
    return Blocks(stage(spark, source.mapInArrow(lean(rows), BLOCK_SCHEMA), "blocks", ("bundle", buckets)), total, size, buckets)


def text_bytes(df: DataFrame, text_col: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]


def shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bounds in sorted unsigned ``keys`` of the ``shards`` equal key ranges."""
    owner = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(owner, np.arange(shards + 1, dtype=np.uint64))


def planes(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, byte by byte, so that zero bytes pack."""
    d = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)


def from_planes(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.T).view(np.uint64).ravel(), dtype=np.uint64)


def blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, block, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(block, pa.int64()), pa.array(blob, pa.binary())], ["shard", "block", "blob"])


def bundle_size(total: int, block_bytes: int) -> int:
    """Blocks whose blobs travel together. Blocks times shards grows with the
    square of the input, so both sides of the exchange grow with its root:
    1 up to some TB, some hundred at 100 TB."""
    return max(1, math.isqrt(total * LEAST_BLOB) // block_bytes)


def bundle_of(block: int, size: int) -> int:
    """Blocks of a partition, some in a row; negative ids stand alone."""
    return block if block < 0 else (block >> 32 << 32) | ((block & 0xFFFFFFFF) // size)


def _frame(parts: list[tuple[int, bytes]]) -> bytes:
    head = np.array([[b, len(x)] for b, x in parts], np.int64)
    return len(parts).to_bytes(4, "little") + head.tobytes() + b"".join(x for _, x in parts)


def unframe(raw: bytes) -> list[tuple[int, bytes]]:
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + 16 * n
    for b, size in np.frombuffer(raw, np.int64, 2 * n, 4).reshape(n, 2).tolist():
        out.append((b, raw[at : at + size]))
        at += size
    return out


def _framed(rows: dict[tuple[int, int], list[tuple[int, bytes]]]) -> pa.RecordBatch:
    return blobs([(shard, bundle, _frame(parts)) for (shard, bundle), parts in rows.items()])


class Exchange:
    """Questions of blocks, answers of shards, and blocks that go on with them."""

    def __init__(self, blocks: Blocks, shard_bytes: int):
        self.blocks, self.total, self.bundle, self.buckets = blocks.df.select("bundle", "block", "payload"), blocks.total, blocks.size, blocks.buckets
        self.shards = max(8, -(-self.total // max(shard_bytes, math.isqrt(self.total * LEAST_BLOB))))

    def ask(self, fn: Callable[[int, Block], list[tuple[int, bytes]]]) -> DataFrame:
        """``fn(block id, block)`` gives (shard, blob) questions."""
        size = self.bundle

        def run(batches):
            rows, now = {}, None
            for batch in batches:
                for b, payload in zip(batch["block"].to_pylist(), batch["payload"]):
                    own = bundle_of(b, size)
                    if rows and own != now:
                        yield _framed(rows)
                        rows = {}
                    now = own
                    for shard, blob in fn(b, Block(payload.as_py())):
                        rows.setdefault((shard, own), []).append((b, blob))
            if rows:
                yield _framed(rows)

        return self.blocks.select("block", "payload").mapInArrow(lean(run), BLOB_SCHEMA)

    def answer(self, questions: DataFrame, fn: Callable[[list[int], list[bytes]], list[tuple[int, bytes]]]) -> DataFrame:
        """``fn(block ids, blobs)`` of a shard gives (block id, blob) answers."""
        size = self.bundle

        def run(table: pa.Table) -> pa.Table:
            asked = [x for raw in table["blob"].to_pylist() for x in unframe(raw)]
            shard, rows = table["shard"][0].as_py(), {}
            for b, blob in fn([b for b, _ in asked], [x for _, x in asked]):
                rows.setdefault((shard, bundle_of(b, size)), []).append((b, blob))
            return pa.Table.from_batches([_framed(rows)])

        # a task for each shard: hashed over fewer partitions, some would hold several
        return questions.repartitionById(self.shards, F.col("shard")).groupBy("shard").applyInArrow(lean_group(run), BLOB_SCHEMA)

    def _meet(self, answers: DataFrame, run, schema: str) -> DataFrame:
        right = answers.select(F.col("block").alias("bundle"), "shard", "blob").repartition(self.buckets, "bundle")
        # answers exist only for blocks, so a left side is always there
        return self.blocks.groupBy("bundle").cogroup(right.groupBy("bundle")).applyInArrow(lean_pair(run), schema)

    def resume(self, answers: DataFrame, fn: Callable[[int, Block, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
        """Each block meets its answers by shard: ``fn(block id, block, answers)``
        gives rows of ``schema``."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            got = _by_block(right)
            return pa.concat_tables([fn(b, Block(p.as_py()), got.get(b, {})) for b, p in zip(left["block"].to_pylist(), left["payload"])])

        return self._meet(answers, run, schema)

    def ask_again(self, answers: DataFrame, fn: Callable[[int, Block, dict[int, bytes]], list[tuple[int, bytes]]]) -> DataFrame:
        """Further questions of blocks that have met their answers."""
        size = self.bundle

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            got, rows = _by_block(right), {}
            for b, p in zip(left["block"].to_pylist(), left["payload"]):
                for shard, blob in fn(b, Block(p.as_py()), got.get(b, {})):
                    rows.setdefault((shard, bundle_of(b, size)), []).append((b, blob))
            return pa.Table.from_batches([_framed(rows)])

        return self._meet(answers, run, BLOB_SCHEMA)


def _by_block(right: pa.Table) -> dict[int, dict[int, bytes]]:
    got: dict[int, dict[int, bytes]] = {}
    for shard, raw in zip(right["shard"].to_pylist(), right["blob"].to_pylist()):
        for b, blob in unframe(raw):
            got.setdefault(b, {})[shard] = blob
    return got
