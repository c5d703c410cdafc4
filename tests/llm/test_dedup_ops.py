"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash

from sylvan.llm import anchors, blocks, rlz, simhash, suffix_dedup

from .conftest import ODD


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Least member of each component of {id: fingerprint}."""
    ids, seen = sorted(fps), {}
    for i in ids:
        if i in seen:
            continue
        todo, seen[i] = [i], i
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in seen and (fps[a] ^ fps[b]).bit_count() <= 2:
                    seen[b] = i
                    todo.append(b)
    return seen


def test_simhash_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    comp = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark, docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


@pytest.mark.parametrize("dense", [32, 2])
def test_simhash_links(spark, monkeypatch, dense):
    """Random clusters and chains of fingerprints within few bits, by pairs and by shared values."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(5)
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.choice([1, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    fps |= {0, 1, (1 << 64) - 1, (1 << 63), rng.getrandbits(64)}
    want = brute_components({f: f for f in fps})
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    root = {r.node: r.root for r in simhash.components(spark, simhash.links(spark, df)).collect()}
    groups = lambda label: sorted(sorted(g) for g in _groups(label).values())
    assert groups({signed(f): root.get(signed(f), signed(f)) for f in fps}) == groups({signed(f): want[f] for f in fps})


def _groups(label):
    out = {}
    for k, v in label.items():
        out.setdefault(v, []).append(k)
    return out


def test_simhash_odd(spark, odd, empty):
    got = simhash.near_duplicates(spark, odd).collect()
    assert len(got) == len(ODD)
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {3: 3, 4: 3, 5: 3}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(spark, empty).count() == 0
    kept = simhash.keep_one(spark, odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 1 and kept.where("doc_id = 2").count() == 0
    assert simhash.keep_one(spark, empty).count() == 0


A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(3, A), (5, A), (5, B)], [(3, A), (5, B)]),
        ([(3, A), (None, A), (None, C)], [(3, A), (None, C)]),
        ([(7, A), (7, A), (7, A)], [(7, A)]),
        ([(None, B), (None, B), (4, None), (4, ""), (9, " ")], [(None, B), (4, None)]),
    ],
)
def test_one_row_of_each_group(spark, rows, want):
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = sorted(((r.doc_id, r.text or None) for r in simhash.keep_one(spark, df).collect()), key=repr)
    assert got == sorted(want, key=repr)


def brute_suffix(docs, W):
    """docs: (id, bytes) rows; null ids rank last."""
    big = 1 << 62
    low = {}
    for i, t in docs:
        i = big if i is None else i
        for p in range(len(t) - W + 1):
            w = t[p : p + W]
            low[w] = min(low.get(w, big), i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - W + 1):
            if low[t[p : p + W]] < (big if i is None else i):
                gone[p : p + W] = b"\1" * W
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(docs, W):
    seen = Counter(tuple(w[p : p + W]) for _, w in docs for p in range(len(w) - W + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - W + 1):
            if seen[tuple(w[p : p + W])] > 1:
                gone[p : p + W] = [True] * W
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def random_docs(seed, n=60):
    """Texts of few letters, so that repeats of all lengths meet and overlap."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 120))) for _ in range(8)]
    return [(i if rng.random() < 0.9 else None, "".join(rng.choice(pool)[rng.randint(0, 9) :] + rng.choice("xyz é") * rng.randint(0, 3) for _ in range(rng.randint(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("seed,bundle", [(1, 1), (2, 3), (3, 2)])
def test_suffix_dedup_random(spark, monkeypatch, seed, bundle):
    monkeypatch.setattr(blocks, "bundle_size", lambda *_: bundle)
    docs = random_docs(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.dedup_substrings(spark, df, W=20, k=8, block_bytes=600, shard_bytes=500).collect()
    assert sorted(map(tuple, got), key=repr) == brute_suffix([(i, t.encode()) for i, t in docs], 20)


@pytest.mark.parametrize("seed,bundle", [(4, 1), (5, 2), (6, 4)])
def test_substring_dedup_random(spark, monkeypatch, seed, bundle):
    monkeypatch.setattr(blocks, "bundle_size", lambda *_: bundle)
    docs = random_docs(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rlz.dedup_spans(spark, df, W=7, k=3, block_bytes=600, shard_bytes=500).collect()
    assert sorted(map(tuple, got), key=repr) == brute_words([(i, t.encode().split()) for i, t in docs], 7)


@pytest.mark.parametrize("seed", [7, 8])
def test_hot_anchors(spark, monkeypatch, seed):
    """Anchors of many blocks are dealt by what stands beside them."""
    monkeypatch.setattr(anchors, "HOT", 1)
    docs = random_docs(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.dedup_substrings(spark, df, W=20, k=8, block_bytes=600, shard_bytes=500).collect()
    assert sorted(map(tuple, got), key=repr) == brute_suffix([(i, t.encode()) for i, t in docs], 20)
    words = rlz.dedup_spans(spark, df, W=7, k=3, block_bytes=600, shard_bytes=500).collect()
    assert sorted(map(tuple, words), key=repr) == brute_words([(i, t.encode().split()) for i, t in docs], 7)


class InMemory:
    """The exchange, on lists."""

    def __init__(self, payloads, shards):
        self.payloads, self.shards = payloads, shards

    def ask(self, fn):
        return [(s, b, x) for b, p in self.payloads.items() for s, x in fn(b, blocks.Block(p))]

    def answer(self, asked, fn):
        out = []
        for s in sorted({s for s, _, _ in asked}):
            mine = [(b, x) for t, b, x in asked if t == s]
            out += [(s, b, x) for b, x in fn([b for b, _ in mine], [x for _, x in mine])]
        return out

    def _of(self, answers, b):
        return {s: x for s, c, x in answers if c == b}

    def ask_again(self, answers, fn):
        return [(s, b, x) for b, p in self.payloads.items() if (got := self._of(answers, b)) for s, x in fn(b, blocks.Block(p), got)]

    def resume(self, answers, fn, schema):
        return [fn(b, blocks.Block(p), self._of(answers, b)) for b, p in self.payloads.items()]


@pytest.mark.parametrize("unit", [b"x", b"ab", b"-=+ "])
def test_periodic_texts_take_bounded_memory(unit):
    """Two blocks of 4 MB that hold the same run: every position is an anchor."""
    text = unit * ((4 << 20) // len(unit))
    payloads = {b: blocks._payload([b], [0], [text]) for b in (1, 2)}
    gone = {}

    def finish(block, sym, starts, ends, dup):
        gone[int(block.ids[0])] = int(anchors.covered(dup, 50).sum())

    tracemalloc.start()
    anchors.find_repeats(InMemory(payloads, 4), suffix_dedup._bytes, 50, 20, "smaller", finish, "")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert gone == {1: 0, 2: len(text)}
    assert peak < 400 << 20


def test_contexts_are_compared_on_their_symbols(monkeypatch):
    """Equal hashes of other contexts don't join them."""
    rng = np.random.default_rng(2)
    sym = rng.integers(0, 2, 400).astype(np.uint8)
    pos = np.arange(20, 380)
    l, r = np.full(360, 4, np.int16), np.full(360, 6, np.int16)
    around = anchors.Contexts(sym, 4, 6)
    rep, order, at, size = anchors.context_classes(around, np.ones(360, np.uint64), pos, l, r, None, np.zeros(360, np.int64))
    got = {tuple(sorted(pos[order[i : i + n]])) for i, n in zip(at, size)}
    want = _groups({int(p): bytes(sym[p - 4 : p + 6]) for p in pos})
    assert got == {tuple(sorted(g)) for g in want.values()}


def test_words_by_arrays(monkeypatch):
    """Words and their bounds as split() gives them, equal words by equal hashes, whatever the stretches."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("aB é\n\t 漢") for _ in range(rng.randint(0, 60))).encode() for _ in range(200)] + [b"", b" ", b"x" * 5000, b"a", b"a"]
    block = blocks.Block(blocks._payload(list(range(len(texts))), [0] * len(texts), texts))
    for lower in (False, True):
        words = [w.lower() if lower else w for t in texts for w in t.split()]
        whole, upto = blocks.word_hashes(block, lower)
        monkeypatch.setattr(blocks, "_STRETCH", 64)
        parts, _ = blocks.word_hashes(block, lower)
        monkeypatch.undo()
        assert upto.tolist() == np.cumsum([len(t.split()) for t in texts]).tolist() and (whole == parts).all()
        assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words)) == len(set(zip(whole.tolist(), words)))


def test_greedy_parse():
    """Factors of pieces against a plain search: at each start that the parse asks for, the longest match with another piece."""
    rng = random.Random(3)
    W, k = 9, 3
    far = W - k
    text = [rng.randint(1, 2) for _ in range(400)]
    rows, l, r = [], [], []
    for at in sorted(rng.sample(range(len(text)), 120)):
        left, right = min(at, far, rng.randint(0, 9)), min(len(text) - at, W, rng.randint(k, 12))
        piece = [0] * (far - left) + text[at - left : at + right] + [0] * (W - right)
        if (piece, left, right) not in zip(rows, l, r):
            rows.append(piece), l.append(left), r.append(right)
    ctx, l, r = np.array(rows, np.uint32), np.array(l), np.array(r)

    def match(i, j, o):
        """Words that pieces i and j share from o before the anchor, if through it."""
        if min(l[i], l[j]) < o:
            return 0
        n = 0
        while n < o + min(r[i], r[j]) and rows[i][far - o + n] == rows[j][far - o + n]:
            n += 1
        return n

    want = []
    for i in range(len(rows)):
        o = min(far, int(l[i]))
        while o >= 0:
            best = max((match(i, j, o) for j in range(len(rows)) if j != i), default=0)
            if best >= W:
                want.append((i, o, best))
                o = W - (best - o) - 1
            else:
                o -= 1
    found = rlz.factors(ctx, l, r, W, k)
    assert sorted((i, o, n) for i, o, _, n in found.tolist()) == sorted(want) and want
    assert all(i != j and match(i, j, o) == n for i, o, j, n in found.tolist())


def test_passages_odd(spark, odd, empty):
    # the long runs of one symbol make brute force slow, so they stand alone
    rows = [(i, (t or "").encode()) for i, t in ODD if i not in (7, 8, 10)]
    part = odd.where("doc_id IS NULL OR doc_id NOT IN (7, 8, 10)")
    assert sorted(map(tuple, suffix_dedup.dedup_substrings(spark, part).collect()), key=repr) == brute_suffix(rows, 50)
    assert sorted(map(tuple, rlz.dedup_spans(spark, part).collect()), key=repr) == brute_words([(i, t.split()) for i, t in rows], 35)
    whole = {r.doc_id: r for r in suffix_dedup.dedup_substrings(spark, odd, texts=True).collect()}
    assert whole[7].n_removed == 0 and whole[8].n_removed == 0 and whole[2].n_removed == whole[2].n_bytes and bytes(whole[6].kept) == b"one"
    words = {r.doc_id: r for r in rlz.dedup_spans(spark, odd).collect()}
    assert words[8].n_removed == words[8].n_words == 6000 and words[10].n_removed == 0 and words[7].n_words == 1
    assert suffix_dedup.dedup_substrings(spark, empty).count() == 0 and rlz.dedup_spans(spark, empty).count() == 0


def test_anchors_cover_every_window():
    rng = np.random.default_rng(0)
    for W, k in ((50, 20), (35, 8), (6, 3)):
        sym = rng.integers(0, 3, 4000).astype(np.uint8)
        ends = np.sort(rng.choice(4000, 9, replace=False)).astype(np.int64)
        ends[-1] = 4000
        starts = np.concatenate([[0], ends[:-1]])
        pos, _ = anchors.anchors(sym, starts, ends, W, k)
        has = np.zeros(4000, bool)
        has[pos] = True
        for s, e in zip(starts, ends):
            for p in range(s, e - W + 1):
                assert has[p : p + W - k + 1].any()


def test_multikey_order():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = anchors.multikey_classes([a[:, j] for j in range(6)], 500)
    assert [tuple(r) for r in a[order]] == sorted(map(tuple, a))
    o, lcp = anchors.sorted_lcp(a)
    for x, y, n in zip(o, o[1:], lcp[1:]):
        want = next((j for j in range(6) if a[x][j] != a[y][j]), 6)
        assert n == want


def test_bundles():
    assert blocks.bundle_size(10**9, 4 << 20) == 1 and 50 < blocks.bundle_size(17 * 10**13, 4 << 20) < 1000
    part = 5 << 32
    assert blocks.bundle_of(part | 7, 3) == part | 2 and blocks.bundle_of(-1, 3) == -1
    assert blocks.unframe(blocks._frame([(1, b"a"), (part, b""), (3, b"xyz")])) == [(1, b"a"), (part, b""), (3, b"xyz")]


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    """Exploded cells and compressed ids look small to Spark: as broadcasts they filled the driver at 0.5 GB."""
    plans, whole = [], simhash.stage

    def seen(s, df, tag, *more):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return whole(s, df, tag, *more)

    monkeypatch.setattr(simhash, "stage", seen)
    monkeypatch.setattr(simhash, "BROADCAST", 0)
    df = spark.createDataFrame([(f,) for f in (0, 1, 3, 7, 1 << 40, (1 << 40) + 1)], "fp long")
    root = {r.node: r.root for r in simhash.components(spark, simhash.links(spark, df)).collect()}
    assert root == {0: 0, 1: 0, 3: 0, 7: 0, 1 << 40: 0, (1 << 40) + 1: 0}
    joins = [p for tag, p in plans if "Join" in p]
    assert len(joins) > 3 and not any("BroadcastExchange" in p for p in joins)
