"""Main text of web pages, with boilerplate found by host.

Pages are parsed once into blocks of text, each in a zone: article, main,
open, or boilerplate by its markup (menus, footers, forms, adverts,
comments). A page's text is its article's, else its main element's, else the
open blocks, less what its host repeats. For that the token streams of all
zones are searched for windows of ``W`` words that many texts of the host
have, by sorting suffixes as in ``anchors``: blocks count their anchors, ask
for the totals, and send the contexts of those that enough texts have, each
once with the number of its texts. Pages whose main text is the same are one
text, so syndicated text and copies are not taken for boilerplate; a text
counts in the first block that has it, so counts add up. Anchors that more
than ``HOT`` blocks hold would bring all of their contexts to one shard;
their windows are counted by hashes of 128 bits instead.

On pages that mark no article a window found on ``SHARE`` of the host's texts
goes, with the words that it covers, and a whole block goes already at
``WHOLE``; three texts at least must have it. Within a marked article both go
at ``INSIDE`` of the texts, ten at least: a line that many articles quote is
theirs, one that practically every page has is the host's. Unique runs stay,
and a page of which nothing would stay keeps its longest block.
"""

from __future__ import annotations

import html
import json
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import HOT, Contexts, _coded, _decoded, anchors, context_classes, context_hashes, covered, repeat_starts, repeated
from .blocks import Block, Exchange, from_planes, make_blocks, planes, shard_edges, text_bytes
from .shared import lean, mix64, pack, ready_python, stage, unpack

BLOCK_BYTES = 2 << 20
SHARD_BYTES = 8 << 20
SHARE = 0.3  # of a host's texts, that a repeat must be found on to be boilerplate
WHOLE = 0.01  # the same for whole blocks of pages without an article, such as adverts that take turns
LEAST = 3  # texts, at least
INSIDE, INSIDE_LEAST = 0.9, 10  # the same for windows and blocks of marked articles
_HOST, _BLOCK_KEY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SCHEMA = "page_id long, url string, text string, n_chars long"
with np.errstate(over="ignore"):
    _BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BLOCK_KEY)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|canvas|textarea|select|button|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<[!?/][^>]*>?|[^<]+|<",
    re.S | re.I,
)
#: Elements that begin and end a block of text.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_SPACED = frozenset(["br", "td", "th"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that nest, and so are followed on a stack.
_NEST = _BLOCK - frozenset("p li dt dd hr tr h1 h2 h3 h4 h5 h6 caption html body".split())
#: Blocks that the next block ends, whether they are closed or not.
_SHORT = frozenset("p h1 h2 h3 h4 h5 h6 caption dt".split())
_BOILER = frozenset("nav aside footer form menu dialog head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup "
    "modal newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer share sharing "
    "social related recommended comment comments disqus reply replies widget hidden pagination toolbar".split()
)
#: Parts that may stand beside these in a compound name (share-links, cookie-bar): others, such as no- or has-, give it another sense.
_BESIDE = frozenset("area bar block box bottom btn button buttons container form group icons inner item items label left link links list panel right section slot text title top unit wrap wrapper".split())
#: What readers or other pages wrote: an article within is one of theirs.
_THEIRS = frozenset("comment comments disqus reply replies related recommended".split())
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)(?=[\s/]|$)", re.I)
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
ARTICLE, MAIN, BOILER, THEIRS, OPEN = "a", "m", "b", "t", "o"  # THEIRS: boilerplate in which articles are too


def _named(value: str) -> set[str]:
    """The boilerplate names among whole class or id names."""
    out: set[str] = set()
    for name in value.lower().split():
        parts = {x for x in re.split(r"[_-]+", name) if x and not x.isdigit()}
        if parts & _NAMES and parts <= _NAMES | _BESIDE:
            out |= parts & _NAMES
    return out


def _zone_of(tag: str, attrs: str, zone: str) -> str:
    """The zone within an element that opens in ``zone``."""
    if zone == THEIRS or (zone == BOILER and tag not in ("article", "main")):
        return zone
    inside, names, role = zone in (ARTICLE, MAIN), set(), ""
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[5]:
            return BOILER
        if m[1].lower() == "role":
            role = value.lower()
        else:
            names |= _named(value)
    if names & _THEIRS:
        return THEIRS
    if tag == "article":
        return ARTICLE
    if tag == "main":
        return zone if zone == ARTICLE else MAIN
    if tag in _BOILER or (tag == "header" and not inside) or role in _ROLES or names:
        return BOILER
    return zone


def parse(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the blocks of a page, in order."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # nesting element, and the zone within
    zone, text = OPEN, []
    short = ""  # an open block that doesn't nest and is boilerplate
    inline: list[str] = []  # the same for elements within a block, such as a span of class ad

    def end():
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip(" ")
            if joined:
                out.append((BOILER if short else zone, joined))
            text.clear()

    for m in _TOKEN.finditer(page):
        whole = m[0]
        if whole[0] != "<" or whole == "<":
            if not inline:
                text.append(whole)
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _SPACED:
            text.append(" ")
            continue
        closed = m[4].endswith("/") or tag in _VOID
        if tag not in _BLOCK:
            if m[2]:
                if inline and inline[-1] == tag:
                    inline.pop()
            elif closed:
                continue
            elif inline:
                if tag == inline[-1]:
                    inline.append(tag)
            elif m[4] and _zone_of(tag, m[4], zone) in (BOILER, THEIRS) and zone not in (BOILER, THEIRS):
                inline.append(tag)
            continue
        end()
        inline.clear()
        if m[2]:
            if tag == short or tag in _NEST:
                short = ""
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            zone = stack[-1][1] if stack else OPEN
        elif tag in _NEST and not closed:
            if short in _SHORT:
                short = ""
            zone = _zone_of(tag, m[4], zone)
            stack.append((tag, zone))
        elif tag in ("html", "body"):
            stack.clear()
            zone, short = OPEN, ""
        else:
            if short == tag or short in _SHORT:
                short = ""
            if not closed and m[4] and not short and _zone_of(tag, m[4], zone) in (BOILER, THEIRS):
                short = tag
    end()
    return [(BOILER if z == THEIRS else z, t) for z, t in out]


def main_zone(found: list) -> str:
    """The zone of a page's main text: its article's, else main's, else what is open."""
    zones = {z for z, _ in found}
    return ARTICLE if ARTICLE in zones else MAIN if MAIN in zones else OPEN


def main_key(found: list) -> int:
    """A hash of the longest blocks that make up half of the main text."""
    zone = main_zone(found)
    own = sorted((t for z, t in found if z == zone), key=lambda t: (-len(t), t))
    total, size, some = sum(map(len, own)), 0, []
    for t in own:
        if 2 * size >= total:
            break
        some.append(t)
        size += len(t)
    return int(np.uint64(xxhash.xxh64_intdigest("\n".join(sorted(some)))).view(np.int64))


class Pages:
    """The pages of a block: their rows, and the symbols of their words, by
    hashes of the bytes between spaces. A word that no other text has ends
    each block of text."""

    def __init__(self, block: Block):
        self.rows = [json.loads(text) for text in block.texts()]
        parts, size, tags, self.cut = [], [], [], [0]
        for key, (_, _, found) in zip(block.ids.tolist(), self.rows):
            for i, (_, text) in enumerate(found):
                parts += [text, f"\x00{key}.{i}"]
                size.append(text.count(" ") + 2)
                tags.append(xxhash.xxh64_intdigest(text))
            self.cut.append(len(tags))
        #: symbols, where each block of text begins, where pages start and end
        self.sym = _word_hashes(" ".join([*parts, ""]).encode())
        self.tags, self.begin = np.array(tags, np.uint64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.starts, self.ends = self.begin[self.cut[:-1]], self.begin[self.cut[1:]]


def _word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word, from prefix sums of a polynomial; every word of
    ``raw`` is followed by one space."""
    data = np.frombuffer(raw, np.uint8)
    stop = np.flatnonzero(data == 32)
    start = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64)[: len(stop)]
    with np.errstate(over="ignore"):
        up, down = np.full(len(data) + 1, _HOST, np.uint64), np.full(len(data) + 1, np.uint64(pow(int(_HOST), -1, 1 << 64)), np.uint64)
        up[:1] = down[:1] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)])
        return mix64((total[stop] - total[start]) * down[start] ^ mix64((stop - start).astype(np.uint64)))


def needed(texts: int, marked: bool) -> tuple[int, int]:
    """Texts of a host, of so many, that windows and whole blocks of
    boilerplate are found on."""
    if marked:
        runs = max(INSIDE_LEAST, math.ceil(INSIDE * texts))
        return runs, runs
    runs = max(LEAST, math.ceil(SHARE * texts))
    return runs, min(runs, max(LEAST, math.ceil(WHOLE * texts)))


def kept_text(found: list, zone: str, gone: list[np.ndarray], whole: np.ndarray) -> str:
    """The main text without the blocks in ``whole`` and the words in ``gone``."""
    out = []
    for (z, text), words_gone, block_gone in zip(found, gone, whole.tolist()):
        if z != zone or block_gone:
            continue
        if words_gone.any():
            text = " ".join(w for w, g in zip(text.split(" "), words_gone.tolist()) if not g)
        if text:
            out.append(text)
    if not out:
        out = sorted((t for z, t in found if z == zone), key=len)[-1:]
    return "\n\n".join(out)


def extract(spark: SparkSession, df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", W: int = 16, k: int = 6) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    A null html is empty; null ids and urls are kept (pages without a url
    form one host); repeated rows are a row each, and copies count as one
    text when repeats are sought, so no page loses text to its own copies.
    An empty table gives no rows. Only the three named columns are read.
    """
    ready_python(spark)
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def parsed(batches):
        for batch in batches:
            rows = []
            for i, u, page in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"]):
                found = parse(page.as_py() or "")
                rows.append((main_key(found), _host_key(u), json.dumps([i, u, found], ensure_ascii=False)))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["main", "host", "page"])

    blocks = make_blocks(spark, pages.mapInArrow(lean(parsed), "main long, host long, page string"), "main", "page", BLOCK_BYTES, F.col("host"), total=text_bytes(pages, "html"))
    exchange = Exchange(blocks, SHARD_BYTES)
    shards, far = exchange.shards, W - k

    def by_shard(keys):
        cut = shard_edges(keys, shards)
        return [(s, i, j) for s, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if j > i]

    def back(got, layer, name, keys, kind):
        """The answers of one round, in the order of the keys that were asked for."""
        out = np.zeros(len(keys), kind)
        for s, i, j in by_shard(keys):
            x = unpack(got[layer * shards + s])[name]
            out[i:j] = np.unpackbits(x, count=j - i) if kind is bool else x
        return out

    def of_text(block):
        """A key for each page's main text on its host."""
        return mix64(block.ids.astype(np.uint64) ^ mix64(block.groups ^ _HOST))

    def ask_first(b, block):
        keys = _unique(of_text(block))
        return [(s, pack(key=planes(keys[i:j]))) for s, i, j in by_shard(keys)]

    def say_first(ids, got):
        """Which of a block's texts no block before it has."""
        parts = [from_planes(unpack(x)["key"]) for x in got]
        keys, owner = np.concatenate(parts), np.repeat(np.array(ids, np.int64), [len(p) for p in parts])
        order = np.lexsort((owner, keys))
        first = np.empty(len(keys), bool)
        first[order] = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        return [(i, pack(first=np.packbits(x))) for i, x in zip(ids, np.split(first, np.cumsum([len(p) for p in parts])[:-1]))]

    def counting(block, got):
        """Which pages count for their texts: those first met here."""
        texts = of_text(block)
        uniq, place = np.unique(texts, return_index=True)
        out = np.zeros(len(texts), bool)
        out[place[back(got, 0, "first", uniq, bool)]] = True
        return out

    def weighed(keys, page, counts):
        """Distinct keys, and the counting pages that have each."""
        uniq, inv = np.unique(keys, return_inverse=True)
        pair = _unique(inv.astype(np.int64) * len(counts) + page)
        return uniq, np.bincount(pair // len(counts), counts[pair % len(counts)], len(uniq)).astype(np.int64), inv

    def keyed(block):
        """The pages; keys of hosts and blocks of text; anchors with their keys and pages."""
        x = Pages(block)
        host = mix64(block.groups)
        page = np.repeat(np.arange(block.n), np.diff(x.cut))
        names = np.concatenate([mix64(host ^ _HOST), mix64(mix64(x.tags ^ _BLOCK_KEY) ^ host[page])])
        pos, key = anchors(x.sym, x.starts, x.ends, W, k)
        own = np.searchsorted(x.ends, pos, side="right")
        return x, names, np.concatenate([np.arange(block.n), page]), pos, mix64(key ^ host[own]), own

    def ask_counts(b, block, got):
        _, names, page, _, key, own = keyed(block)
        counts = counting(block, got)
        out: dict[int, dict] = {}
        for name, keys, pages in (("n", names, page), ("a", key, own)):
            uniq, n, _ = weighed(keys, pages, counts)
            for s, i, j in by_shard(uniq):
                out.setdefault(s, {}).update({name + "k": planes(uniq[i:j]), name + "c": n[i:j].astype(np.uint16 if n.max(initial=0) < 1 << 16 else np.uint32)})
        return [(s, pack(**x)) for s, x in out.items()]

    def totals(ids, got):
        parts = [unpack(x) for x in got]
        out = [{} for _ in parts]
        for name in "na":
            have = [i for i, p in enumerate(parts) if name + "k" in p]
            if not have:
                continue
            keys = [from_planes(parts[i][name + "k"]) for i in have]
            uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
            full = np.bincount(inv, np.concatenate([parts[i][name + "c"] for i in have]), len(uniq))[inv].clip(max=(1 << 32) - 1).astype(np.uint32)
            hot = (np.bincount(inv, minlength=len(uniq)) > HOT)[inv]
            cut = np.cumsum([len(x) for x in keys])[:-1]
            for i, x, h in zip(have, np.split(full, cut), np.split(hot, cut)):
                out[i] |= {name + "c": x, name + "h": np.packbits(h)}
        return [(i, pack(**x)) for i, x in zip(ids, out)]

    def wanted(block, got):
        """As ``keyed``, with the texts of each page's host and of its blocks,
        and which anchors are on enough texts, and which of them are hot."""
        x, names, page, pos, key, own = keyed(block)
        uniq, inv = np.unique(names, return_inverse=True)
        n = back(got, 1, "nc", uniq, np.int64)[inv]
        marked = np.array([main_zone(found) != OPEN for _, _, found in x.rows], bool)
        runs, few = (np.array([needed(t, m)[0] for t, m in zip(n[: block.n].tolist(), ms)], np.int64) for ms in (marked.tolist(), [False] * block.n))
        uniq, inv = np.unique(key, return_inverse=True)
        # all pages count for those of the host that need the fewest
        enough = back(got, 1, "ac", uniq, np.int64)[inv] >= few[own] if len(key) else np.zeros(0, bool)
        return x, n, runs, pos[enough], own[enough], back(got, 1, "ah", uniq, bool)[inv][enough] if len(key) else enough, key[enough]

    def hot_windows(x, block, pos, own):
        """Where windows around these anchors start, their pages and keys."""
        some = np.zeros(len(x.sym) + 1, bool)
        for o in range(far + 1):
            at = pos - o
            some[at[(at >= x.starts[own]) & (at + W <= x.ends[own])]] = True
        at = np.flatnonzero(some)
        page = np.searchsorted(x.ends, at, side="right")
        zero, full = np.zeros(len(at), np.int16), np.full(len(at), W, np.int16)
        salt = mix64(block.groups)[page]
        return at, page, mix64(context_hashes(x.sym, at, zero, full) ^ salt), mix64(context_hashes(x.sym, at, zero, full, 1) ^ salt)

    def ask_contexts(b, block, got):
        x, _, runs, pos, own, hot, key = wanted(block, got)
        counts, out = counting(block, got), {}
        if hot.any():
            _, page, h, proof = hot_windows(x, block, pos[hot], own[hot])
            pair = np.stack([h, proof], 1)
            uniq, inv = np.unique(pair, axis=0, return_inverse=True)
            _, n, _ = weighed(inv.ravel().astype(np.int64), page, counts)
            for s, i, j in by_shard(uniq[:, 0]):
                out.setdefault(s, {}).update(wk=planes(uniq[i:j, 0]), wp=uniq[i:j, 1].copy(), wc=n[i:j].astype(np.uint32))
        pos, own, key = pos[~hot], own[~hot], key[~hot]
        if len(pos):
            around = Contexts(x.sym, far, W)
            l, r = np.minimum(pos - x.starts[own], far).astype(np.int16), np.minimum(x.ends[own] - pos, W).astype(np.int16)
            rep, order, at, size = context_classes(around, context_hashes(x.sym, pos, l, r), pos, l, r, block.groups[own] ^ mix64(runs[own].astype(np.uint64)), own)
            cls = np.repeat(np.arange(len(at)), size)
            new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (own[order][1:] != own[order][:-1])])
            weight = np.bincount(cls, new & counts[own[order]], len(at)).astype(np.uint32)
            deal = (((key[rep] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
            for s in np.unique(deal).tolist():
                m = np.flatnonzero(deal == s)
                q = rep[m]
                members = np.concatenate([order[i : i + n] for i, n in zip(at[m].tolist(), size[m].tolist())])
                out.setdefault(s, {}).update(_coded(around.take(pos[q], l[q], r[q])) | dict(l=l[q].astype(np.uint8), r=r[q].astype(np.uint8), group=block.groups[own[q]], need=runs[own[q]].astype(np.uint32), weight=weight[m], size=size[m].astype(np.uint32), pos=pos[members].astype(np.uint32)))
        return [(s, pack(**x)) for s, x in out.items()]

    def compare(ids, got):
        parts = [{n: a.copy() for n, a in unpack(x).items()} for x in got]
        out = [{} for _ in parts]
        have = [p for p in parts if "ctx" in p]
        if have:
            ctx = _decoded(have)
            cat = {n: np.concatenate([p[n] for p in have]).astype(np.uint64 if n == "group" else np.int64) for n in ("l", "r", "group", "need", "weight")}
            mask = repeated(ctx, cat["l"], cat["r"], cat["need"], cat["group"], W, k, "enough", cat["weight"])
            at = 0
            for p, o in zip(parts, out):
                if "l" in p:
                    own = np.repeat(mask[at : at + len(p["l"])], p["size"])
                    at += len(p["l"])
                    o |= {"pos": p["pos"][own > 0], "mask": own[own > 0]}
        have = [i for i, p in enumerate(parts) if "wk" in p]
        if have:
            keys = [np.stack([from_planes(parts[i]["wk"]), parts[i]["wp"]], 1) for i in have]
            uniq, inv = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
            full = np.bincount(inv.ravel(), np.concatenate([parts[i]["wc"] for i in have]), len(uniq))[inv.ravel()].clip(max=(1 << 32) - 1).astype(np.uint32)
            for i, x in zip(have, np.split(full, np.cumsum([len(x) for x in keys])[:-1])):
                out[i]["wc"] = x
        return [(i, pack(**o)) for i, o in zip(ids, out) if o]

    def decide(b, block, got):
        x, n, runs, pos, own, hot, _ = wanted(block, got)
        masks = {s: blob for s, blob in got.items() if s >= 2 * shards}
        dup = repeat_starts([blob for blob in masks.values() if "mask" in unpack(blob)], len(x.sym), W, k)
        if hot.any():
            at, page, h, proof = hot_windows(x, block, pos[hot], own[hot])
            uniq, inv = np.unique(np.stack([h, proof], 1), axis=0, return_inverse=True)
            found = back(masks, 2, "wc", uniq[:, 0], np.int64)[inv.ravel()]
            dup[at[found >= runs[page]]] = True
        out, texts = [], n[: block.n].tolist()
        counts = n[block.n :]
        for i, (page, url, found) in enumerate(x.rows):
            zone, a, z = main_zone(found), x.cut[i], x.cut[i + 1]
            gone = covered(dup[x.starts[i] : x.ends[i]], W)
            first = (x.begin[a : z + 1] - x.starts[i]).tolist()
            text = kept_text(found, zone, [gone[s : e - 1] for s, e in zip(first, first[1:])], counts[a:z] >= needed(texts[i], zone != OPEN)[1])
            out.append((page, url, text, len(text)))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.Table.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], ["page_id", "url", "text", "n_chars"])

    beside = lambda answers, layer: answers.withColumn("shard", (F.col("shard") + layer * shards).cast("int"))
    firsts = exchange.answer(exchange.ask(ask_first), say_first)
    counts = exchange.answer(exchange.ask_again(firsts, ask_counts), totals)
    known = stage(spark, firsts.union(beside(counts, 1)), "counts")
    masks = exchange.answer(exchange.ask_again(known, ask_contexts), compare)
    return exchange.resume(known.union(beside(masks, 2)), decide, SCHEMA)


def _unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _host_key(url: str | None) -> int:
    host = re.sub(r"^[a-z]+://", "", (url or "").lower()).split("/")[0].split("?")[0].split("#")[0]
    return int(np.uint64(xxhash.xxh64_intdigest(host)).view(np.int64))
