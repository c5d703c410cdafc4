"""Language-model scores from an Elias-Fano n-gram trie.

Counts are gathered over the whole training corpus: every block of documents
sends its distinct n-grams (hashes, with its training counts) to shards by
key range, and gets the corpus counts of just these back. From them it
builds the slice of the trie that its own texts can touch: words at the
first level, each with its back-off weight and the pointers to its
successors, and below it the successors of each context in ascending order.
Pointers and successors are monotone and Elias-Fano coded, smoothed log
probabilities are quantised to 16 bits. A slice is one memory-mapped buffer,
and is searched as it is coded: a context-relative successor search selects
the bucket of the high bits by a directory of counts, then compares low bits
within it. No process ever holds the model of the corpus.

Smoothing is hierarchical: p1(w) = (c(w) + 1) / (N + V + 1) and
pn(w | h) = (c(hw) + mu_n p(w | h')) / (c(h) + mu_n).
"""

from __future__ import annotations

import math
import mmap
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blocks import Block, Exchange, from_planes, make_blocks, planes, shard_edges, unframe, word_hashes
from .shared import mix64, pack, stage, unpack

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Symbols that stand before and behind each text, beside the hashes of words.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
STEP = 1 / 1024  # of a quantised log10 probability
#: Weights of the lower order, for orders 2, 3, ...; the last holds for all beyond.
MU = (200.0, 20.0, 1.0)
#: Keys of n-grams have the bits of the corpus's size in bytes and so many more: about one in 2 ** ODDS (a byte being some sixth of an n-gram) shares its key with another.
ODDS = 12
_TOTALS = -1
_P = np.uint64(0x9E3779B97F4A7C15)
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").cumsum(axis=1).astype(np.uint8)
_U, _EACH, _TOPS = np.uint64, np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the j-th bit that is set in a byte.
_NTH = np.stack([np.argmax(_ONES > j, axis=1) for j in range(8)], 1).astype(np.int64)


def _bits(at: np.ndarray, values: np.ndarray, words: int) -> np.ndarray:
    """64-bit words with the values at these (ascending) bits, cut at the end of their word."""
    out = np.zeros(words, np.uint64)
    if len(at):
        word = at >> 6
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(values << (at & 63).astype(np.uint64), first)
    return out


class EliasFano:
    """A monotone sequence of integers: low bits packed, high bits in unary,
    and the ones before every 64 bits of these. ``high`` and ``low`` are
    whole 64-bit words."""

    def __init__(self, low: np.ndarray, high: np.ndarray, before: np.ndarray, bits: int, n: int):
        self.low, self.high, self.before, self.bits, self.n = low, high, before, bits, n

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        v = np.asarray(values, np.uint64)
        top = int(v[-1]) if n else 0
        bits = min(56, max(0, (max(top, 1) // max(n, 1)).bit_length() - 1))
        at = np.arange(n, dtype=np.int64)
        high = _bits((v >> np.uint64(bits)).astype(np.int64) + at, np.ones(n, np.uint64), ((top >> bits) + n) // 64 + 1)
        part, at = v & np.uint64((1 << bits) - 1), at * bits
        low = _bits(at, part, (n * bits) // 64 + 2)
        over = np.flatnonzero((at & 63) + bits > 64)  # the rest of a value goes to the next word
        low[(at[over] >> 6) + 1] |= part[over] >> (np.uint64(64) - (at[over] & 63).astype(np.uint64))
        ones = np.bitwise_count(high).astype(np.int64)
        return cls(low, high, (np.cumsum(ones) - ones).astype(np.uint32), bits, n)

    def _select(self, j: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the j-th one, or zero, of the unary bits."""
        before = self.before if ones else (np.arange(len(self.before), dtype=np.int64) * 64 - self.before)
        word = np.searchsorted(before, j, side="right") - 1
        x = self.high[word] if ones else ~self.high[word]
        rest = (j - before[word]).astype(np.uint64)
        with np.errstate(over="ignore"):
            # ones of each byte, then of the bytes up to it, in one word
            sums = x - ((x >> _U(1)) & _U(0x5555555555555555))
            sums = (sums & _U(0x3333333333333333)) + ((sums >> _U(2)) & _U(0x3333333333333333))
            upto = ((sums + (sums >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH
            # bytes that end before the wanted one
            shift = np.bitwise_count((((rest * _EACH) | _TOPS) - upto) & _TOPS).astype(np.uint64) << _U(3)
            rest -= ((upto << _U(8)) >> shift) & _U(255)
        return word * 64 + shift.astype(np.int64) + _NTH[((x >> shift) & _U(255)).astype(np.int64), rest.astype(np.int64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        x = self.low[word] >> off
        over = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return ((x | over) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __getitem__(self, i) -> np.ndarray:
        i = np.atleast_1d(np.asarray(i, np.int64))
        return ((self._select(i, True) - i) << self.bits) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place whose value is not less than x, of each x."""
        x = np.asarray(x, np.int64)
        high, low = x >> self.bits, x & ((1 << self.bits) - 1)
        zeros = len(self.high) * 64 - self.n
        beyond = high >= zeros
        h = np.where(beyond, 0, high)
        # values with smaller high bits, and with these
        a = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - np.maximum(h - 1, 0), 0)
        b = self._select(h, False) - h
        todo = np.flatnonzero(a < b)
        while len(todo):
            mid = (a[todo] + b[todo]) >> 1
            less = self._low(mid) < low[todo]
            a[todo[less]], b[todo[~less]] = mid[less] + 1, mid[~less]
            todo = todo[a[todo] < b[todo]]
        return np.where(beyond, self.n, a)


def quantise(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10p / STEP), 0, 65535).astype(np.uint16)


class Trie:
    """Levels of (pointers, successors, probabilities, back-off weights).

    Level 1 is indexed by word. A node of level n+1 is a pair of a node of
    level n and a word; ``pointers[node]`` is where the node's successors
    begin. Successors restart with each context, so they are stored relative
    to it: node * words + word, which is monotone."""

    def __init__(self, words: int, p1: np.ndarray, back1: np.ndarray):
        self.words, self.levels = words, [{"p": p1, "back": back1}]

    def add(self, parent: np.ndarray, word: np.ndarray, p: np.ndarray, back: np.ndarray) -> None:
        """Nodes of the next level, ascending by (parent, word)."""
        above = len(self.levels[-1]["p"])
        self.levels[-1]["pointers"] = EliasFano.encode(np.searchsorted(parent, np.arange(above + 1)))
        self.levels.append({"next": EliasFano.encode(parent.astype(np.int64) * self.words + word), "p": p, "back": back})

    def mapped(self) -> Trie:
        """The same trie on one memory-mapped buffer, beside nothing else."""
        arrays = [(level, name, x) for level in self.levels for name, x in level.items()]
        flat = [a for _, _, x in arrays for a in ((x.low, x.high, x.before) if isinstance(x, EliasFano) else (x,))]
        size = sum(-(-a.nbytes // 8) * 8 for a in flat)
        buffer, at, out = mmap.mmap(-1, max(size, 8)), 0, []
        for a in flat:
            buffer[at : at + a.nbytes] = np.ascontiguousarray(a).tobytes()
            out.append(np.frombuffer(buffer, a.dtype, len(a), at) if len(a) else a)
            at += -(-a.nbytes // 8) * 8
        found = iter(out)
        new = Trie(self.words, self.levels[0]["p"], self.levels[0]["back"])
        new.levels = [{name: EliasFano(next(found), next(found), next(found), x.bits, x.n) if isinstance(x, EliasFano) else next(found) for name, x in level.items()} for level in self.levels]
        return new

    def find(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Nodes of a level (0 is the first) by parent and word, -1 if none:
        the successor of the pair must lie between the parent's pointers.
        Pairs are asked for in their order, which keeps to the cache."""
        up, here = self.levels[level - 1]["pointers"], self.levels[level]["next"]
        out = np.full(len(parent), -1)
        if not here.n:
            return out
        ask = np.flatnonzero(parent >= 0)
        want = parent[ask].astype(np.int64) * self.words + word[ask]
        order = np.argsort(want)
        ask, want = ask[order], want[order]
        at = here.successor(want)
        ok = np.flatnonzero(at < up[parent[ask] + 1])
        ok = ok[here[at[ok]] == want[ok]]
        out[ask[ok]] = at[ok]
        return out


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def key_bits(total: int) -> int:
    """Bits of an n-gram's key in a corpus of so many bytes."""
    return min(64, max(total, 1).bit_length() + ODDS)


class Grams:
    """The n-grams of a block, by level: distinct keys (ascending), training
    counts in the block, and each position's n-gram (-1 where the document
    has too few tokens before). Words are numbered by their hashes."""

    def __init__(self, block: Block, order: int, bits: int = 64):
        words, upto = word_hashes(block, lower=True)
        self.n_tokens = np.diff(upto, prepend=0) + 1
        every = np.empty(len(words) + block.n, np.uint64)
        ends = np.cumsum(self.n_tokens) - 1
        own = np.ones(len(every), bool)
        own[ends] = False
        every[own], every[ends] = words, END
        self.hashes, number = np.unique(np.append(every, START), return_inverse=True)
        self.words = len(self.hashes)
        self.token, self.start = number[:-1].astype(np.int64), int(number[-1])
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        self.held = np.array([is_held_out(None if null else i) for i, null in zip(block.ids.tolist(), block.null.tolist())], bool)
        train = ~np.repeat(self.held, self.n_tokens)
        counts = np.bincount(self.token, train, self.words).astype(np.int64)
        counts[self.start] = int((~self.held).sum())
        self.keys, self.counts, self.at = [self.hashes], [counts], [self.token]
        self.before: list[np.ndarray] = [self.token]  # each position's context, of the level above
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        place = np.arange(len(self.token)) - np.repeat(self.first, self.n_tokens)
        cut = np.uint64(((1 << bits) - 1) << (64 - bits))
        key = self.hashes[self.token]
        for n in range(2, order + 1):
            before, own = np.empty(len(self.token), np.int64), np.empty(len(self.token), np.uint64)
            before[1:], own[1:] = self.at[-1][:-1], key[:-1]
            if n == 2:
                before[self.first], own[self.first] = self.start, self.hashes[self.start]
            real = place >= n - 2
            with np.errstate(over="ignore"):
                key = mix64(own * _P + self.hashes[self.token] + np.uint64(n))
            uniq, inv = np.unique(key[real] & cut, return_inverse=True)
            at = np.full(len(key), -1)
            at[real] = inv
            self.keys.append(uniq), self.at.append(at), self.before.append(before)
            self.counts.append(np.bincount(inv, train[real], len(uniq)).astype(np.int64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the n-grams of level n (0 are the words): the context and the
        same words without the first, in the level above, and the last word."""
        if n not in self.known:
            real = np.flatnonzero(self.at[n] >= 0)
            one = np.empty(len(self.keys[n]), np.int64)
            one[self.at[n][real]] = real
            self.known[n] = self.before[n][one], self.at[n - 1][one], self.token[one]
        return self.known[n]


def _slim(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, those of 255 or more apart."""
    return {"s": np.minimum(counts, 255).astype(np.uint8), "b": counts[counts >= 255].astype(np.uint64)}


def _full(x: dict[str, np.ndarray], name: str) -> np.ndarray:
    out = x[name + "s"].astype(np.int64)
    out[out == 255] = x[name + "b"].astype(np.int64)
    return out


def score_documents(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 4, mu: tuple[float, ...] = MU, block_bytes: int = 5 << 20, shard_bytes: int = 12 << 20) -> DataFrame:
    """One row per document (``SCHEMA``). Documents whose crc32(id as text)
    mod 7 is 2 are held out; the model learns from all others.

    A null text is empty and has the end alone; a null id is learned from;
    repeated rows count each time. An empty table gives no rows. Only the
    two named columns are read. Words are told apart by 64 bits of hash,
    longer n-grams by ``key_bits``.
    """
    blocks = make_blocks(spark, df, id_col, text_col, block_bytes)
    exchange = Exchange(blocks, shard_bytes)
    shards, bits = exchange.shards, key_bits(exchange.total)
    spare = [np.uint64(0), *[np.uint64(64 - bits)] * (order - 1)]

    def questions(b, block):
        g = Grams(block, order, bits)
        cuts = [shard_edges(k, shards) for k in g.keys]
        out = []
        for s in range(shards):
            x = {}
            for n, (keys, counts, cut) in enumerate(zip(g.keys, g.counts, cuts)):
                x[f"k{n}"] = planes(keys[cut[s] : cut[s + 1]] >> spare[n])
                x |= {f"c{n}{name}": a for name, a in _slim(counts[cut[s] : cut[s + 1]]).items()}
            out.append((s, pack(**x)))
        return out

    def totals(ids, got):
        parts = [unpack(x) for x in got]
        back = [{} for _ in parts]
        known = tokens = 0
        for n in range(order):
            counts = [_full(p, f"c{n}") for p in parts]
            keys = np.concatenate([from_planes(p.pop(f"k{n}")) for p in parts])
            uniq, inv = np.unique(keys, return_inverse=True)
            total = np.bincount(inv, np.concatenate(counts), len(uniq)).astype(np.int64)
            if n == 0:
                word = uniq != START
                known, tokens = int((total[word] > 0).sum()), int(total[word].sum())
            for out, part in zip(back, np.split(total[inv], np.cumsum([len(c) for c in counts])[:-1])):
                out |= {f"c{n}{name}": a for name, a in _slim(part).items()}
        return [*((i, pack(**x)) for i, x in zip(ids, back)), (_TOTALS, pack(sums=np.array([known, tokens])))]

    answers = stage(spark, exchange.answer(exchange.ask(questions), totals), "counts")
    sums = sum((unpack(x)["sums"] for r in answers.where(f"block = {_TOTALS}").select("blob").collect() for _, x in unframe(bytes(r.blob))), np.zeros(2, np.int64))  # two numbers a shard
    V, N = map(int, sums)

    def score(b, block, got):
        g = Grams(block, order, bits)
        counts = [np.zeros(len(k), np.int64) for k in g.keys]
        cuts = [shard_edges(k, shards) for k in g.keys]
        for s, blob in got.items():
            x = unpack(blob)
            for n, cut in enumerate(cuts):
                counts[n][cut[s] : cut[s + 1]] = _full(x, f"c{n}")
        logp = log10p(build(g, counts, N, V, mu).mapped(), g)
        c = counts[0][g.token]
        base = np.log10((c + 1) / (N + V + 1))
        add = lambda x: np.add.reduceat(x, g.first)
        return pa.table(
            {
                "doc_id": block.id_column(), "held_out": pa.array(g.held), "n_tokens": pa.array(g.n_tokens), "n_known": pa.array(add((c > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(block.n, N, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(logp)),
            }
        )

    return exchange.resume(answers.where(f"block <> {_TOTALS}"), score, SCHEMA)


def build(g: Grams, counts: list[np.ndarray], N: int, V: int, mu: tuple[float, ...]) -> Trie:
    """The slice of the trie that a block's n-grams span, from their counts
    in the corpus."""
    own = lambda n: mu[min(n, len(mu)) - 1]  # noqa: E731  of the level below a context of n words
    p = (counts[0] + 1) / (N + V + 1)
    weight = lambda c, n: quantise(np.log10(own(n) / (c + own(n))))
    trie = Trie(g.words, quantise(np.log10(p)), weight(counts[0], 1))
    nodes = np.arange(g.words)  # node of each n-gram of the level above, -1 if not seen in training
    for n in range(1, len(counts)):
        parent, shorter, word = g.grams(n)
        p = (counts[n] + own(n) * p[shorter]) / (counts[n - 1][parent] + own(n))
        seen = np.flatnonzero((counts[n] > 0) & (nodes[parent] >= 0))
        by = np.argsort(nodes[parent[seen]] * g.words + word[seen])
        seen = seen[by]
        trie.add(nodes[parent[seen]], word[seen], quantise(np.log10(p[seen])), weight(counts[n][seen], n + 1))
        nodes = np.full(len(parent), -1)
        nodes[seen] = np.arange(len(seen))
    return trie


def log10p(trie: Trie, g: Grams) -> np.ndarray:
    """log10 probability of every token, by descending from its context. Each
    distinct n-gram is searched once; one without a node takes the shorter
    one's probability and its context's back-off weight, if that has a node."""
    best = trie.levels[0]["p"][np.arange(g.words)].astype(np.float64)
    node = np.arange(g.words)
    out = best[g.token]
    for n in range(1, len(trie.levels)):
        parent, shorter, word = g.grams(n)
        above = node[parent]
        found = trie.find(n, above, word)
        back = np.where(above >= 0, math.nan, 0.0)
        back[above >= 0] = trie.levels[n - 1]["back"][above[above >= 0]]
        best, node = best[shorter] + back, found
        best[found >= 0] = trie.levels[n]["p"][found[found >= 0]]
        real = g.at[n] >= 0
        out[real] = best[g.at[n][real]]
    return -out * STEP
