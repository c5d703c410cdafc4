"""Windows of W symbols that occur again, found through shared anchors.

A window's anchor is the k-gram of least hash in it, chosen from the content
alone, so two equal windows have equal anchors at the same place. Anchors
are about one in (W - k + 2) / 2 positions. Two rounds follow:

1. every block sends its distinct anchor hashes; shards answer which of them
   occur more than once (a superset of what is needed, never less);
2. blocks send only those anchors, with the symbols of all windows that they
   can serve, to shards by range; each shard sorts the suffixes that start
   at the anchors, and the reversed prefixes before them, by multikey
   quicksort, takes the longest common prefixes of neighbours, and compares
   windows exactly through the classes that these give.

Equal contexts of a block are sent once, so a passage that a third of all
documents share costs one record per block. They are found by hash, some
thousand at a time, and compared on their symbols before any is copied: texts
of one symbol or of a short period, where every position is an anchor, cost
no more than a few numbers a position. An anchor that more than ``HOT``
blocks hold is dealt by what stands beside it, once for the windows that
reach right and once for those that reach left, so its contexts spread.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .blocks import NULL_ID, Block, Exchange, from_planes, planes, shard_edges
from .shared import mix64, pack, unpack

_CHUNK = 1 << 19
HOT = 64  # blocks that share an anchor, from which its contexts are dealt by their surroundings
_P = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _P)


def _gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k symbols, by doubling: length len(h) - k + 1."""
    with np.errstate(over="ignore"):
        out, n, power, size, mult = None, 0, h, 1, _P
        while k:
            if k & 1:
                if out is None:
                    out, n, out_mult = power, size, mult
                else:
                    m = len(out) - size
                    out, n, out_mult = out[:m] * mult + power[n : n + m], n + size, out_mult * mult
            k >>= 1
            if k:
                m = len(power) - size
                power, size, mult = power[:m] * mult + power[size:], size * 2, mult * mult
        return mix64(out)


def _slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w neighbours: length len(a) - w + 1."""
    size = 1
    while size * 2 <= w:
        a = op(a[: len(a) - size], a[size:])
        size *= 2
    return a if size == w else op(a[: len(a) - (w - size)], a[w - size :])


def anchors(sym: np.ndarray, starts: np.ndarray, ends: np.ndarray, W: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions of the anchors of all windows that lie in one
    document, and hashes of their k-grams."""
    n, w = len(sym), W - k + 1
    found, keys = [], []
    if n < W:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.ones(n, bool)  # whether a window that starts here stays in its document
    for s, e in zip(starts.tolist(), ends.tolist()):
        whole[max(s, e - W + 1) : e] = False
    for at in range(0, n - k + 1, _CHUNK):
        to = min(at + _CHUNK, n - k + 1)
        lo, hi = max(0, at - w + 1), min(n - k + 1, to + w - 1)  # k-grams that matter to [at, to)
        part = sym[lo : hi + k - 1]
        h = _gram_hash(_BYTE[part] if part.dtype == np.uint8 else mix64(part), k)
        h[h == 0] = 1
        if len(h) < w:
            continue
        least = _slide(h, w, np.minimum)  # of windows lo .. lo + len(least)
        least[~whole[lo : lo + len(least)]] = 0
        pad = np.zeros(w - 1, np.uint64)
        most = _slide(np.concatenate([pad, least, pad]), w, np.maximum)  # over the windows that hold a k-gram
        hit = np.flatnonzero(h[at - lo : to - lo] == most[at - lo : to - lo])
        found.append(hit + at)
        keys.append(h[at - lo : to - lo][hit])
    # anchors have small hashes; hashed again they spread evenly over the shards
    return np.concatenate(found).astype(np.int64), mix64(np.concatenate(keys) ^ _P)


def context_hashes(sym: np.ndarray, pos: np.ndarray, l: np.ndarray, r: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the symbols from l before each (ascending) position to r
    after it, from prefix sums of a polynomial, a stretch of symbols at a
    time; never 0. Other seeds give independent hashes."""
    out = np.empty(len(pos), np.uint64)
    if not len(pos):
        return out
    reach, salt = int(l.max()), mix64(np.array([seed], np.uint64) + _P)
    size = _CHUNK + reach + int(r.max())
    base = int(_P) if not seed else int(mix64(np.array([seed], np.uint64))[0]) | 1
    with np.errstate(over="ignore"):
        up, down = np.full(size + 1, base, np.uint64), np.full(size + 1, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        cut = np.searchsorted(pos, np.arange(0, int(pos[-1]) + _CHUNK + 1, _CHUNK))
        for at, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if i == j:
                continue
            lo = max(0, at * _CHUNK - reach)
            part = sym[lo : lo + size]
            part = _BYTE[part] if part.dtype == np.uint8 else mix64(part ^ salt)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)])
            here, a, b = pos[i:j] - lo, l[i:j].astype(np.int64), r[i:j].astype(np.int64)
            h = (total[here + b] - total[here - a]) * down[here - a]
            out[i:j] = mix64(h ^ mix64(a.astype(np.uint64) * np.uint64(1 << 20) + b.astype(np.uint64)))
    out[out == 0] = 1
    return out


class Contexts:
    """The symbols around positions, gathered some thousand at a time."""

    def __init__(self, sym: np.ndarray, far: int, W: int):
        padded = np.concatenate([np.zeros(far, sym.dtype), sym, np.zeros(W, sym.dtype)])
        self.view, self.far, self.place = np.lib.stride_tricks.sliding_window_view(padded, far + W), far, np.arange(far + W)
        self.zero, self.padded = sym.dtype.type(0), padded

    def take(self, pos: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Symbols beyond l and r read as 0."""
        inside = (self.place >= self.far - l[:, None]) & (self.place < self.far + r[:, None])
        return np.where(inside, self.view[pos], self.zero)

    def differ(self, pos, l, r, mate) -> np.ndarray:
        """Which rows have other symbols or extents than their mates."""
        out = np.zeros(len(mate), bool)
        for a in range(0, len(mate), 1 << 14):
            y = mate[a : a + (1 << 14)]
            x = np.arange(a, a + len(y))
            odd = (l[x] != l[y]) | (r[x] != r[y])
            todo = np.flatnonzero(~odd & (x != y))
            x, y = x[todo], y[todo]
            odd[todo] = (self.take(pos[x], l[x], r[x]) != self.take(pos[y], l[y], r[y])).any(axis=1)
            out[a : a + len(odd)] = odd
        return out


def context_classes(around: Contexts, h: np.ndarray, pos: np.ndarray, l: np.ndarray, r: np.ndarray, tags: np.ndarray | None, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows with equal contexts and tags, compared on their symbols: (one of
    each, all in order of class and id, where each class begins, sizes).
    ``h`` are hashes of the contexts; rows of one hash that differ part."""
    if tags is not None:
        h = mix64(h ^ mix64(tags))
    n = len(h)
    while True:
        order = np.lexsort((ids, h)).astype(np.int32)
        c = h[order]
        at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if n else np.zeros(0, np.int64)
        del c
        size = np.diff(np.append(at, n))
        rep = order[at]
        mate = np.empty(n, np.int32)
        mate[order] = np.repeat(rep, size)
        other = around.differ(pos, l, r, mate)
        if tags is not None:
            other |= tags != tags[mate]
        if not other.any():
            return rep, order, at, size
        with np.errstate(over="ignore"):
            h[other] = mix64(h[other] + np.uint64(1))


def multikey_classes(cols: list[np.ndarray], n: int) -> np.ndarray:
    """An order of n rows by their columns: sort by one, then only the rows
    that still tie by the next, as multikey quicksort does."""
    order = np.argsort(cols[0], kind="stable")
    x = cols[0][order]
    new = np.ones(n, bool)
    new[1:] = x[1:] != x[:-1]
    cls = np.cumsum(new)  # class of each place in the order
    for col in cols[1:]:
        lone = new & np.append(new[1:], True)
        act = np.flatnonzero(~lone)
        if not len(act):
            break
        rows = order[act]
        sub = np.lexsort((col[rows], cls[act]))
        order[act] = rows = rows[sub]
        c, v = cls[act], col[rows]
        more = np.ones(len(act), bool)
        more[1:] = (c[1:] != c[:-1]) | (v[1:] != v[:-1])
        new[act] = more
        cls = np.cumsum(new)
    return order


def _columns(ctx: np.ndarray) -> list[np.ndarray]:
    """Columns to sort by; bytes go eight at a time, big-endian."""
    if ctx.dtype != np.uint8:
        return [np.ascontiguousarray(ctx[:, j]) for j in range(ctx.shape[1])]
    wide = -(-ctx.shape[1] // 8) * 8
    full = np.zeros((len(ctx), wide), np.uint8)
    full[:, : ctx.shape[1]] = ctx
    words = full.view(">u8").astype(np.uint64)
    return [np.ascontiguousarray(words[:, j]) for j in range(wide // 8)]


def sorted_lcp(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the rows, and each row's common prefix with the one before."""
    n = len(ctx)
    order = multikey_classes(_columns(ctx), n)
    lcp = np.zeros(n, np.int16)
    for a in range(1, n, 1 << 15):
        b = min(n, a + (1 << 15))
        same = ctx[order[a:b]] == ctx[order[a - 1 : b - 1]]
        full = same.all(axis=1)
        lcp[a:b] = np.where(full, ctx.shape[1], np.argmin(same, axis=1))
    return order, lcp


def repeated(ctx: np.ndarray, l: np.ndarray, r: np.ndarray, ids: np.ndarray, groups: np.ndarray, W: int, k: int, rule: str, weight: np.ndarray | None = None) -> np.ndarray:
    """Bit o of the mask of a row is set if its window that starts o symbols
    before the anchor occurs again: in a smaller document ("smaller") or
    anywhere ("any"); or, for "enough", if the rows with the window in its
    group weigh as much as the row's id says."""
    n, far = len(ctx), W - k
    mask = np.zeros(n, np.uint64)
    if not n:
        return mask
    order_r, lcp_r = sorted_lcp(ctx[:, far:])
    order_l, lcp_l = sorted_lcp(ctx[:, far - 1 :: -1] if far else np.zeros((n, 1), ctx.dtype))
    _, gid = np.unique(groups, return_inverse=True)
    g = int(gid.max()) + 1
    cr, cl = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(far + 1):
        cr[order_r] = np.cumsum(lcp_r < W - o)
        ok = np.flatnonzero((l >= o) & (r >= W - o))
        if not len(ok):
            continue
        key = cr[ok] * g + gid[ok]
        if o:
            cl[order_l] = np.cumsum(lcp_l < o)
            _, key = np.unique(key, return_inverse=True)
            key = key * np.int64(n + 1) + cl[ok]
        order = np.argsort(key, kind="stable")
        x = key[order]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        size = np.diff(np.append(first, len(x)))
        if rule == "any":
            hit = np.repeat(size > 1, size)
        elif rule == "enough":
            hit = np.repeat(np.add.reduceat(weight[ok][order], first), size) >= ids[ok][order]
        else:
            mine = ids[ok][order]
            hit = mine > np.repeat(np.minimum.reduceat(mine, first), size)
        mask[ok[order[hit]]] |= np.uint64(1 << o)
    return mask


def _full_mask(l: np.ndarray, r: np.ndarray, W: int, far: int) -> np.ndarray:
    """All windows that an anchor with these extents can serve."""
    lo, hi = np.maximum(0, W - r), np.minimum(l, far)
    one = np.uint64(1)
    return np.where(hi >= lo, ((one << (hi - lo + 1).clip(0, 63).astype(np.uint64)) - one) << lo.clip(0, 63).astype(np.uint64), np.uint64(0))


def _own(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Copies, so that dropping the contexts frees them."""
    return {n: a.copy() for n, a in x.items()}


def _coded(ctx: np.ndarray) -> dict[str, np.ndarray]:
    """Bytes as they are; wider symbols as places in a list of those present."""
    if ctx.dtype == np.uint8:
        return {"ctx": ctx}
    names, codes = np.unique(ctx, return_inverse=True)
    return {"names": names, "ctx": codes.reshape(ctx.shape).astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)}


def _decoded(parts: list[dict[str, np.ndarray]]) -> np.ndarray:
    """The contexts of all blobs, with symbols that are equal if theirs are."""
    if "names" not in parts[0]:
        return np.concatenate([p.pop("ctx") for p in parts])
    names = np.unique(np.concatenate([p["names"] for p in parts]))
    out = np.empty((sum(len(p["ctx"]) for p in parts), parts[0]["ctx"].shape[1]), np.uint32)
    at = 0
    for p in parts:
        codes = p.pop("ctx")
        out[at : at + len(codes)] = np.searchsorted(names, p.pop("names")).astype(np.uint32)[codes]
        at += len(codes)
    return out


def find_repeats(exchange: Exchange, symbols, W: int, k: int, rule: str, finish, schema: str, splitters: tuple[np.ndarray, np.ndarray] | None = None, judge=repeated) -> DataFrame:
    """``symbols(block)`` gives (symbols, starts, ends) of a block;
    ``finish(block, symbols, starts, ends, dup)`` its result table, where dup
    marks the positions at which a repeated window starts. With
    ``splitters`` (leading eight bytes, and hash) anchors are dealt by ranges
    of the two, else by ranges of their hash. For "any", the first round also
    asks which whole contexts occur again, by hashes of 128 bits: all their
    windows do, and one of them only goes on, as a partner for others.
    ``judge`` compares the windows of a shard."""

    def last(b, block, got):
        sym, starts, ends = symbols(block)
        return finish(block, sym, starts, ends, repeat_starts(got.values(), len(sym), W, k))

    return exchange.resume(repeat_positions(exchange, symbols, W, k, rule, splitters, judge), last, schema)


def repeat_starts(blobs, n: int, W: int, k: int) -> np.ndarray:
    """Which of a block's n positions start a repeated window, from the
    answers of ``repeat_positions``."""
    dup = np.zeros(n + W, bool)
    for blob in blobs:
        x = unpack(blob)
        pos, mask = x["pos"], x["mask"]
        for o in range(W - k + 1):
            dup[pos[(mask >> np.uint64(o)) & np.uint64(1) > 0].astype(np.int64) - o] = True
    return dup[:n]


def repeat_positions(exchange: Exchange, symbols, W: int, k: int, rule: str, splitters: tuple[np.ndarray, np.ndarray] | None = None, judge=repeated) -> DataFrame:
    """The answers to blocks, as ``find_repeats`` uses them: anchors, and
    which windows that they serve are repeated."""
    far, shards = W - k, exchange.shards
    half = far // 2

    def anchored(block):
        sym, starts, ends = symbols(block)
        pos, key = anchors(sym, starts, ends, W, k)
        pos = pos.astype(np.int32)
        doc = np.searchsorted(ends, pos, side="right").astype(np.int32)
        return sym, starts, ends, pos, key, doc

    whole_contexts = rule == "any"

    def extents(pos, doc, starts, ends):
        return tuple(np.minimum(x, most).astype(np.int16) for x, most in ((pos - starts.astype(np.int32)[doc], far), (ends.astype(np.int32)[doc] - pos, W)))

    def first(b, block):
        sym, starts, ends, pos, key, doc = anchored(block)
        if not len(key):
            return []
        order = np.argsort(key, kind="stable")
        x, d = key[order], block.ids[doc][order]
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        many = np.diff(np.append(at, len(x))) > 1 if rule == "any" else np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
        keys = x[at]
        del order, x, d
        cut = shard_edges(keys, shards)
        out = [{"key": planes(keys[i:j]), "many": np.packbits(many[i:j])} for i, j in zip(cut[:-1], cut[1:])]
        if whole_contexts:
            ctx, proof, inv = whole(sym, pos, *extents(pos, doc, starts, ends))
            n = np.bincount(inv, minlength=len(ctx))
            cut = shard_edges(ctx, shards)
            for x, i, j in zip(out, cut[:-1], cut[1:]):
                x |= {"ckey": planes(ctx[i:j]), "proof": proof[i:j], "cmany": np.packbits(n[i:j] > 1)}
        return [(s, pack(**x)) for s, x in enumerate(out) if x["key"].size or x.get("ckey", x["key"]).size]

    def whole(sym, pos, l, r):
        """The distinct contexts by two hashes, and which is each position's."""
        h, proof = context_hashes(sym, pos, l, r), context_hashes(sym, pos, l, r, 1)
        order = np.lexsort((proof, h))
        x, y = h[order], proof[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, bool)
        inv = np.empty(len(x), np.int64)
        inv[order] = np.cumsum(new) - 1
        return x[new], y[new], inv

    def again(ids, parts, name, marks):
        """Of each block's keys: whether they are marked or come from more
        blocks, whether the block is the key's first, and whether more than
        HOT blocks hold it."""
        keys = [from_planes(p[name]) for p in parts]
        sizes = [len(k) for k in keys]
        many = np.concatenate([np.unpackbits(p[marks], count=n) for p, n in zip(parts, sizes)]).astype(bool)
        owner = np.repeat(np.array(ids, np.int64), sizes)
        keys = np.concatenate(keys)
        proof = np.concatenate([p["proof"] for p in parts]) if name == "ckey" else np.zeros(len(keys), np.uint64)
        order = np.lexsort((owner, proof, keys))
        x, y = keys[order], proof[order]
        new = np.concatenate([np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        size = np.diff(np.append(np.flatnonzero(new), len(x)))
        held = np.repeat(size, size)
        out = []
        for found in (many[order] | (held > 1), new, held > HOT):
            back = np.empty(len(x), bool)
            back[order] = found
            out.append(np.split(back, np.cumsum(sizes)[:-1]))
        return out

    def shared_keys(ids, got):
        parts = [unpack(x) for x in got]
        hit, _, hot = again(ids, parts, "key", "many")
        out = [{"bits": np.packbits(x), "hot": np.packbits(y)} for x, y in zip(hit, hot)]
        if whole_contexts:
            hit, lead, _ = again(ids, parts, "ckey", "cmany")
            for o, x, y in zip(out, hit, lead):
                o |= {"chit": np.packbits(x), "cfirst": np.packbits(y)}
        return [(i, pack(**o)) for i, o in zip(ids, out)]

    def spread(uniq, got, name):
        """The answers' bits, in the order of the keys that were asked for."""
        out, cut = np.zeros(len(uniq), bool), shard_edges(uniq, shards)
        for s, blob in got.items():
            i, j = cut[s], cut[s + 1]
            out[i:j] = np.unpackbits(blob[name], count=j - i)
        return out

    def second(b, block, got):
        sym, starts, ends, pos, key, doc = anchored(block)
        got = {s: unpack(x) for s, x in got.items()}
        uniq, inv = np.unique(key, return_inverse=True)
        sel = np.flatnonzero(spread(uniq, got, "bits")[inv]).astype(np.int32) if len(uniq) else np.zeros(0, np.int32)
        if not len(sel):
            return []
        hot = spread(uniq, got, "hot")[inv]
        del uniq, inv
        l, r = extents(pos, doc, starts, ends)
        around = Contexts(sym, far, W)
        sure_at = np.zeros(0, np.int64)
        if whole_contexts:
            ctxs, _, cinv = whole(sym, pos, l, r)
            hit, lead = spread(ctxs, got, "chit"), spread(ctxs, got, "cfirst")
            sure_at = sel[hit[cinv[sel]]]
            _, once = np.unique(cinv[sel], return_index=True)  # one place of each context
            once = sel[once]
            c = cinv[once]
            once = once[~hit[c] | lead[c]]
            rep, alone = once, ~hit[cinv[once]]
            at, size = np.cumsum(alone) - alone, alone.astype(np.int64)
            order, sure = once[alone], np.zeros(int(alone.sum()), bool)
        else:
            some = (pos[sel], l[sel], r[sel])
            rep, order, at, size = context_classes(around, context_hashes(sym, *some), *some, None, block.ids[doc[sel]])
            mine = block.ids[doc[sel[order]]]
            sure = mine > np.repeat(mine[at], size)
            rep, order = sel[rep], sel[order]
        q, rl, rr, deal = _deal(sym, around, pos, key, hot, l, r, rep)
        out, by = [], np.argsort(deal, kind="stable")
        edges = np.searchsorted(deal[by], np.arange(shards + 1))
        spare = b % shards if len(sure_at) else -1  # the shard that passes on what is sure
        for s in range(shards):
            mine = by[edges[s] : edges[s + 1]]
            if not len(mine) and s != spare:
                continue
            mine = mine[np.argsort(key[rep[q[mine]]], kind="stable")]
            m = q[mine]
            members = np.concatenate([np.zeros(0, np.int64), *(np.arange(i, i + n) for i, n in zip(at[m].tolist(), size[m].tolist()))])
            p, ll, lr = rep[m], rl[mine], rr[mine]
            more = {"sp": pos[sure_at].astype(np.uint32), "sl": l[sure_at].astype(np.uint8), "sr": r[sure_at].astype(np.uint8)} if s == spare else {}
            ctx = _coded(around.take(pos[p], ll, lr))
            out.append((s, pack(**ctx, l=ll.astype(np.uint8), r=lr.astype(np.uint8), ids=block.ids[doc[p]], groups=block.groups[doc[p]], size=size[m].astype(np.uint32), pos=pos[order[members]].astype(np.uint32), sure=np.packbits(sure[members]), **more)))
        return out

    def _deal(sym, around, pos, key, hot, l, r, rep):
        """(representative, l, r, shard) of each context to send. A hot
        anchor's are cut to the windows that start up to ``half`` before it,
        and to those that start further before, and dealt by what all of
        these hold beside the anchor."""
        where, own, ll, rr = pos[rep], key[rep], l[rep], r[rep]
        if splitters is not None:
            lead = np.lib.stride_tricks.sliding_window_view(around.padded, 8)[where + far]
            lead = np.ascontiguousarray(lead).view(">u8").ravel().astype(np.uint64)
            shard = between(splitters, lead, mix64(own))
        else:
            shard = (((own >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
        warm = hot[rep]
        if not warm.any():
            return np.arange(len(rep)), ll, rr, shard
        q, cl, cr, to = [np.flatnonzero(~warm)], [ll[~warm]], [rr[~warm]], [shard[~warm]]
        for right in (True, False):
            x = np.flatnonzero(warm & (rr >= W - half)) if right else np.flatnonzero(warm & (ll > half))
            x = x[np.argsort(where[x], kind="stable")]
            zero, one = np.zeros(len(x), np.int16), np.ones(len(x), np.int16)
            beside = context_hashes(sym, where[x], zero, one * (W - half)) if right else context_hashes(sym, where[x], one * (half + 1), one * k)
            q.append(x)
            cl.append(np.minimum(ll[x], half) if right else ll[x])
            cr.append(rr[x] if right else np.minimum(rr[x], W - half - 1))
            to.append((((mix64(own[x] ^ beside) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64))
        return np.concatenate(q), np.concatenate(cl), np.concatenate(cr), np.concatenate(to)

    def compare(ids, got):
        parts = [_own(unpack(x)) for x in got]
        ctx = _decoded(parts)
        cat = {n: np.concatenate([p[n] for p in parts]) for n in ("l", "r", "ids", "groups")}
        l, r = cat["l"].astype(np.int64), cat["r"].astype(np.int64)
        mask = judge(ctx, l, r, cat["ids"], cat["groups"], W, k, rule)
        full = _full_mask(l, r, W, far)
        out, at = [], 0
        for b, p in zip(ids, parts):
            n = len(p["l"])
            sure = np.unpackbits(p["sure"], count=len(p["pos"])).astype(bool)
            own = np.where(sure, np.repeat(full[at : at + n], p["size"]), np.repeat(mask[at : at + n], p["size"]))
            hit = np.flatnonzero(own)
            where, own = p["pos"][hit], own[hit]
            if "sp" in p:
                where = np.concatenate([where, p["sp"]])
                own = np.concatenate([own, _full_mask(p["sl"].astype(np.int64), p["sr"].astype(np.int64), W, far)])
            if len(where):
                out.append((b, pack(pos=where, mask=own)))
            at += n
        return out

    known = exchange.answer(exchange.ask(first), shared_keys)
    contexts = exchange.ask_again(known, second)
    return exchange.answer(contexts, compare)


def between(splitters: tuple[np.ndarray, np.ndarray], lead: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The range of each (lead, key) among sorted splitters of both."""
    leads, keys = splitters
    lo, hi = np.searchsorted(leads, lead, side="left"), np.searchsorted(leads, lead, side="right")
    tied = np.flatnonzero(lo < hi)
    for a, b in np.unique(np.stack([lo[tied], hi[tied]], 1), axis=0).tolist():
        same = tied[(lo[tied] == a) & (hi[tied] == b)]
        lo[same] = a + np.searchsorted(keys[a:b], key[same], side="right")
    return lo


def covered(dup: np.ndarray, W: int) -> np.ndarray:
    """Positions that some window of W from a marked start covers."""
    step = dup.astype(np.int8)
    delta = step.astype(np.int32)
    delta[W:] -= step[:-W] if len(step) > W else 0
    return np.cumsum(delta) > 0


__all__ = ["NULL_ID", "Block", "anchors", "covered", "find_repeats", "repeat_positions", "repeat_starts", "repeated"]
