"""Scoring, rules, extraction, tokens, mixing, search and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.llm import blocks, contain, html_hosts, mixing, ngram_trie, quality_ledger, queries, secrets_rf, simple8b

from .conftest import ODD


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, duck, same_rows, name):
    same_rows(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


# ---- language-model scores


def brute_scores(docs, order, mu):
    """docs: (id, text) rows."""
    toks = [(i, (t or "").encode().lower().split() + [b" "]) for i, t in docs]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in toks]
    grams = Counter()
    for (_, ws), h in zip(toks, held):
        if not h:
            full = [b"\n", *ws]
            grams.update(tuple(full[e - n : e]) for e in range(1, len(full) + 1) for n in range(1, min(order, e) + 1))
    uni = Counter({g[0]: n for g, n in grams.items() if len(g) == 1 and g != (b"\n",)})
    n, v = sum(uni.values()), len(uni)

    def p(g):
        if len(g) == 1:
            return (uni[g[0]] + 1) / (n + v + 1)
        m = mu[min(len(g) - 1, len(mu)) - 1]
        return (grams[g] + m * p(g[1:])) / (grams[g[:-1]] + m)

    out = []
    for (i, ws), h in zip(toks, held):
        full = [b"\n", *ws]
        score = sum(math.log10(p(tuple(full[max(0, e - order) : e]))) for e in range(2, len(full) + 1))
        out.append((i, h, len(ws), sum(uni[w] > 0 for w in ws), n, sum(math.log10(p((w,))) for w in ws), score))
    return out


def same_scores(got, want, order):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert r[:5] == w[:5] and r[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(r[6] - w[6]) <= w[2] * ngram_trie.STEP * order / 2


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scores(spark, sf_dir, monkeypatch, order):
    monkeypatch.setattr(blocks, "bundle_size", lambda *_: 2)
    monkeypatch.setattr(ngram_trie, "ODDS", 40)  # no key is shared by chance
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mu = (50.0, 5.0, 1.5)
    got = ngram_trie.score_documents(spark, df, order=order, mu=mu, block_bytes=90_000, shard_bytes=90_000).collect()
    same_scores(got, brute_scores([(r.doc_id, r.text) for r in df.collect()], order, mu), order)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_odd(spark, odd, empty):
    got = ngram_trie.score_documents(spark, odd).collect()
    same_scores(got, brute_scores(ODD, 4, ngram_trie.MU), 4)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert ngram_trie.score_documents(spark, empty).count() == 0


def test_elias_fano():
    """Values and successors, searched in the coded form."""
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 0), (1, 2**62), (5, 3), (1000, 10**12), (1000, 500), (70, 2**57), (4000, 4000)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = ngram_trie.EliasFano.encode(v)
        assert e[np.arange(n)].tolist() == v.tolist() if n else e.n == 0
        x = np.concatenate([rng.integers(0, top + 2, 50), v[:50], v[:50] + 1])
        assert e.successor(x).tolist() == np.searchsorted(v, x).tolist()


def test_trie_is_coded():
    """A mapped trie takes few bits a node and finds what is there, and only that."""
    rng = np.random.default_rng(5)
    words, n = 5000, 40_000
    pair = np.sort(rng.choice(words * words, n, replace=False))
    zero = np.zeros(words, np.uint16)
    trie = ngram_trie.Trie(words, zero, zero)
    trie.add(pair // words, pair % words, np.zeros(n, np.uint16), np.zeros(n, np.uint16))
    trie = trie.mapped()
    assert trie.find(1, pair // words, pair % words).tolist() == list(range(n))
    other = np.setdiff1d(rng.choice(words * words, 1000), pair)
    assert (trie.find(1, other // words, other % words) == -1).all() and (trie.find(1, np.full(3, -1), np.arange(3)) == -1).all()
    e = trie.levels[1]["next"]
    assert 8 * (e.low.nbytes + e.high.nbytes + e.before.nbytes) / n < np.log2(words * words / n) + 5


# ---- quality rules


def test_quality_ledger(spark, odd, empty):
    got = {r.doc_id: r for r in quality_ledger.assess(odd).collect()}
    assert got[3].n_words == 0 and not got[3].kept and got[3].base_failed
    assert got[8].n_dup_lines == 2999 and got[8].n_repeat_words == 6000 and got[8].base_failed
    assert got[10].n_words == 30_000 and got[10].n_repeat_words == 0 and got[10].kept
    assert quality_ledger.assess(empty).count() == 0
    kept = quality_ledger.keep(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_repeats_are_compared_exactly(spark, monkeypatch):
    """Hashes that agree by chance make no repeat."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality_ledger.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c x a b c y z"), (3, "a b")], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality_ledger.ledger(df).collect()} == {1: 0, 2: 6, 3: 0}


@pytest.mark.parametrize("words", [150_000, 4_000_000])
def test_long_texts_are_counted_exactly(spark, words):
    """Distinct words make no repeats, however many; known repeats are all found."""
    some = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.conv(i.cast("string"), 10, 36)), " ").alias("text"))
    again = some.select(F.lit(2).cast("long").alias("doc_id"), F.concat("text", F.lit(" 1 2 3 4 . 1 2 3 . 9 9 9 9")).alias("text"))
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality_ledger.ledger(some.union(again)).collect()}
    assert got == {1: (words, 0), 2: (words + 13, 4 + 7 + 4)}


def test_only_rule(spark, sf_dir):
    led = quality_ledger.assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    alone = {r.rule: r.alone for r in quality_ledger.ablation(led).collect()}
    assert Counter(r.only_rule for r in led.collect() if r.only_rule) == Counter({r: n for r, n in alone.items() if n})


def test_ablation(spark, sf_dir):
    led = quality_ledger.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    fails = [r.failures for r in led.collect()]
    for r in quality_ledger.ablation(led).collect():
        bit = 1 << list(quality_ledger.RULES).index(r.rule)
        assert (r.fails, r.alone, r.kept_without) == (sum(f & bit > 0 for f in fails), sum(f == bit for f in fails), sum(f in (0, bit) for f in fails))


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><article>no</article>";</script></head><body>
<header><p>site name</p></header><nav><ul><li><a href="/">home</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">buy</div><main>
<article><h1>Big &amp; small</h1><p>one
  two<br>three <b>four</b><p>five &lt;six&gt;<aside>side</aside><div class="share-links">share</div><form><p>mail</p></form><ul><li>a</li><li>b</li></ul>
<section id="comments"><article class="comment">reader</article></section><span class="advert">spam</span>tail</article></main><footer>&copy; x</footer></body></html>"""


def test_article(spark):
    df = spark.createDataFrame([(1, "http://a.example/x", PAGE), (2, None, None), (None, "http://a.example/y", ""), (4, "u", "<article></article>")], "page_id long, url string, html string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_hosts.extract(spark, df).collect()}
    text = "Big & small\n\none two three four\n\nfive <six>\n\na\n\nb\n\ntail"
    assert got == {1: ("http://a.example/x", text, len(text)), 2: (None, "", 0), None: ("http://a.example/y", "", 0), 4: ("u", "", 0)}


def test_host_boilerplate(spark):
    """Pages that mark no article lose what their host repeats, and keep unique runs."""
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    page = lambda i: f"<body><div>Welcome to the best site of all sites</div><div>{words(40 * i, 40 * i + 30)}</div><div>Call us now or write to us today</div></body>"
    rows = [(i, f"https://h{i // 4}.example/{i}", page(i)) for i in range(8)] + [(9, "https://lone.example/", page(9))]
    got = {r.page_id: r.text for r in html_hosts.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == words(40 * i, 40 * i + 30) for i in range(8))
    assert got[9].split("\n\n") == ["Welcome to the best site of all sites", words(360, 390), "Call us now or write to us today"]


@pytest.fixture(params=["cold", "hot", "many blocks"])
def ways(request, monkeypatch):
    """Contexts sorted in shards, windows counted by hashes, and pages over many blocks."""
    if request.param != "cold":
        monkeypatch.setattr(html_hosts, "HOT", 0 if request.param == "hot" else 2)
    if request.param == "many blocks":
        monkeypatch.setattr(html_hosts, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(html_hosts, "SHARD_BYTES", 500)


def test_host_keeps_what_few_pages_share(spark, ways):
    """Copies of a page, quotes, reposted paragraphs and common phrases on a large host stay; its boilerplate goes."""
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    top, phrase, post = "Welcome to the best site of all sites", "as every one of us well knows", "p " + words(9000, 9030)
    long = words(8000, 8020)
    body = lambda i: f"{words(40 * i, 40 * i + 15)} {phrase if i % 2 else 'and'} {words(40 * i + 15, 40 * i + 30)}"
    page = lambda i: f"<body><div>{top}</div><div>{body(i)} {long}</div>{f'<p>{post}</p>' if i < 2 else ''}</body>"
    rows = [(i, f"https://big.example/{i}", page(i)) for i in range(40)] + [(100 + i, f"https://big.example/{i}", page(i)) for i in range(40)]
    rows += [(200 + i, f"https://twin.example/{i}", page(7)) for i in range(3)]
    got = {r.page_id: r.text for r in html_hosts.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(40):
        assert got[i] == got[100 + i] == body(i) + (f"\n\n{post}" if i < 2 else "")
    assert {got[200 + i] for i in range(3)} == {f"{top}\n\n{body(7)} {long}"}


def texts_of(spark, pages, host="a.example"):
    rows = [(i, f"http://{host}/{i}", page) for i, page in enumerate(pages)]
    got = {r.page_id: r.text for r in html_hosts.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(pages))]


@pytest.mark.parametrize(
    "page,text",
    [
        ('<div class="page no-sidebar"><article><p>one two</p></article></div>', "one two"),
        ('<div class="content has-sidebar"><main><p>one two</p></main></div>', "one two"),
        ('<article class="post comment-open"><p>one two</p></article>', "one two"),
        ('<article><p>one</p><p class="advert">buy<b>!</b><p>two</p><h2 class="ad">more</h2>three</article>', "one\n\ntwo\n\nthree"),
        ('<article><ul><li>one</li><li class="share">tell <b>all</b></li><li>two</li></ul>and <em class="ad">buy</em>three</article>', "one\n\ntwo\n\nand three"),
        ("<article><p>extra<wbr>ordinary</p></article>", "extraordinary"),
        ('<div class="sidebar"><p>menu</p></div><div class="ad-slot">buy</div><main>one<div class="share-links">x</div></main>', "one"),
        ('<div class="cookie-bar">take</div><p>one</p><div id="comments"><article>reader</article></div>', "one"),
        ('<aside><main><article>one</article></main></aside><footer>f</footer>', "one"),
        ('<article>one<section class="related"><article>other</article></section>two<img class="ad" src="x">three</article>', "one\n\ntwothree"),
        ("<p>a &lt;b&gt; &eacute;&#8211;&amp;amp;</p>\n<p>  two\tthree\n</p>", "a <b> é–&amp;\n\ntwo three"),
    ],
)
def test_markup(page, text):
    found = html_hosts.parse(page)
    zone = html_hosts.main_zone(found)
    assert "\n\n".join(t for z, t in found if z == zone) == text


def test_host_repeats_decide_inside_articles(spark, ways):
    """What a host repeats goes from marked articles too; copies and syndicated text lose nothing."""
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    notice, long = "Read all of our offers of the week", " ".join(f"n{i}" for i in range(18))
    page = lambda i: f"<nav>n{i}</nav><article><h1>{words(90 * i, 90 * i + 4)}</h1><p>{words(90 * i + 4, 90 * i + 40)} {long} {words(90 * i + 40, 90 * i + 50)}</p><p>{notice}</p><p>{words(90 * i + 50, 90 * i + 80)} that at the end of the day we won</p></article><footer>f{i}</footer>"
    got = texts_of(spark, [page(i) for i in range(12)])
    want = lambda i: f"{words(90 * i, 90 * i + 4)}\n\n{words(90 * i + 4, 90 * i + 50)}\n\n{words(90 * i + 50, 90 * i + 80)} that at the end of the day we won"
    assert got == [want(i) for i in range(12)]
    quoted = [f"<article><p>{words(90 * i, 90 * i + 40)}</p>{f'<p>{notice}</p>' if i % 2 else ''}</article>" for i in range(12)]  # by half of the articles
    assert texts_of(spark, quoted) == [words(90 * i, 90 * i + 40) + (f"\n\n{notice}" if i % 2 else "") for i in range(12)]
    same = [f"<div>menu {i} of {i}</div><p>{words(0, 30)}</p><p>{words(30, 70)}</p>" for i in range(5)]
    assert all(text == f"menu {i} of {i}\n\n{words(0, 30)}\n\n{words(30, 70)}" for i, text in enumerate(texts_of(spark, same)))
    two = [f"<article><p>{words(0, 30)}</p></article>"] * 2 + [f"<article><p>{words(50 * i, 50 * i + 30)}</p></article>" for i in (1, 2)]
    assert texts_of(spark, two) == [words(0, 30), words(0, 30), words(50, 80), words(100, 130)]
    only = [f"<article><p>{notice}</p></article><p>{words(50 * i, 50 * i + 30)}</p>" for i in range(4)]
    assert texts_of(spark, only) == [notice] * 4


def test_odd_pages(spark):
    """Repeated rows, null ids and urls, a very long page, an empty table, and columns whose names clash."""
    long = "<article>" + "".join(f"<p>{' '.join(f'x{i}_{j}' for j in range(9))}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://a.example/1", "<p>one</p>", 1, "m"), (1, "http://a.example/1", "<p>one</p>", 1, "m"), (None, None, "<p>two</p>", 2, "m"), (3, "http://a.example/2", long, 3, "m"), (4, "x", "<<p <a href='>'>&nbsp; </p", 4, "m")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, block int, main string")
    got = html_hosts.extract(spark, df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = Counter((r.page_id, r.text) for r in got.collect() if r.page_id not in (3, 4))
    assert out == Counter({(1, "one"): 2, (None, "two"): 1})
    three = got.where("page_id = 3").first()
    assert three.text.split("\n\n")[-1].startswith("x19999_0 ") and three.n_chars == len(three.text) and three.text.count("\n\n") == 19_999
    assert html_hosts.extract(spark, df.limit(0)).count() == 0


def test_pages_of_the_tables(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    import html as h

    for r in queries.op7_html_extraction(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"[ \t\n\r\f\v]+", " ", h.unescape(re.sub(r"</?b>", "", x).replace("<br>", " "))).strip(" ") for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)


# ---- tokens


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 3000):
        for top in (2, 49_408, 2**31, 2**64 - 1):
            x = rng.integers(0, top, n, dtype=np.uint64, endpoint=top > 2**60)
            x[: n // 3] = 0
            words, offsets = simple8b.encode(x)
            assert (simple8b.decode(words, offsets, n) == x).all()
            docs, null, lengths, ids = simple8b.read_section(simple8b.pack_section([None, 5][: min(n, 2)], [1, n - 1][: min(n, 2)], x))
            assert (ids == x).all() and len(docs) == min(n, 2) and null.tolist() == [True, False][: min(n, 2)]


def test_word_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    model, own = Tokenizer.from_file(path), simple8b.WordTokenizer(path)
    rng = random.Random(4)
    letters = "abZÉé×÷Š’…“”.,;:!?'sdtlvemr()<|>[]{}#$%&*+-/=_`~^\\\"0129 \t\n 　́‍eİıKΣς漢字😀\x01\x00\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + [t or "" for _, t in ODD]
    for t in [*texts, "<|endoftext|>x <|EndOfText|> I'll don't.", "\x01 \x01\x01 a"]:
        assert np.frombuffer(own.encode(t.encode()), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids


def brute_tokens(rows):
    from tokenizers import Tokenizer

    model, at, out = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_output(spark, sf_dir, odd, empty):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op8_token_output(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(brute_tokens(docs))
    got = simple8b.tokenize(spark, odd, queries.tokenizer_path()).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_tokens(ODD), key=repr)
    assert simple8b.tokenize(spark, empty, queries.tokenizer_path()).count() == 0


def test_token_files_stay(spark, tmp_path):
    """A table at a path of the caller's reads again as it was written; one id of many rows lies in several parts."""
    rows = [(None if i % 3 else i, f"some words of text {i} " * 40) for i in range(400)]
    path = str(tmp_path / "tokens")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = simple8b.tokenize(spark, df, queries.tokenizer_path(), path).collect()
    table = spark.read.parquet(path)
    again = simple8b.read_tokens(spark, table).collect()
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, again), key=repr) and len(first) == 400
    with_null = {r.part for r in table.collect() if simple8b.read_section(bytes(r.section))[1].any()}
    assert len(with_null) > 1


# ---- mixing


def test_targets(spark):
    """Closed form against resharing until none is above its cap."""
    rng = random.Random(6)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 10, 100, 1000, 5000]) for _ in range(9)]
        names = [f"s{i}" for i in range(8)] + [None]
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
        weights = [(5, 2, 1)[i % 3] for i in range(9)]
        want, open_ = {}, set(range(9))
        while open_:
            left = 1.5 * sum(sizes) - sum(want.values())
            share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
            over = [i for i in open_ if share[i] > 2 * sizes[i]]
            if not over:
                want |= share
                break
            want |= {i: 2.0 * sizes[i] for i in over}
            open_ -= set(over)
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert all(got[n] == pytest.approx(want[i]) for i, n in enumerate(names))


def test_mix_is_near_and_nested(spark, monkeypatch, odd, empty):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(800)], "doc_id long, text string, source string")
    small, large = (mixing.mix(spark, df, share=x).select("doc_id", "size", "taken", "target", F.col("doc_id") % 4).collect() for x in (0.5, 1.0))
    for s in range(4):
        mine = [r for r in small if r[4] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 7 and all(r.taken <= 2 * r.size for r in mine)
    more = {r.doc_id: r.taken for r in large}
    assert all(more[r.doc_id] >= r.taken for r in small)
    got, all_ = mixing.mix(spark, odd).collect(), mixing.mix(spark, df).collect()
    assert len(got) == len(ODD) and sum(r.size for r in got if r.doc_id == 3) == 0
    assert mixing.mix(spark, empty).count() == 0
    with monkeypatch.context() as m:  # more sources than are broadcast
        m.setattr(mixing, "SOURCES", 0)
        key = lambda rows: sorted(map(tuple, rows), key=repr)
        assert key(mixing.mix(spark, odd).collect()) == key(got) and key(mixing.mix(spark, df).collect()) == key(all_)
    taken = mixing.take(spark, odd)
    assert taken.columns == odd.columns
    times = {r.doc_id: r.times for r in got if r.doc_id is not None}
    assert Counter(r.doc_id for r in taken.collect() if r.doc_id not in (None, 6)) == Counter({i: n for i, n in times.items() if n and i != 6})


# ---- benchmark search


def brute_found(docs, items):
    out = []
    for i, text in docs:
        words = (text or "").lower().split()
        for item, it in items:
            iw = (it or "").lower().split()
            m = min(5, len(iw))
            want = {tuple(iw[j : j + m]) for j in range(len(iw) - m + 1)} if iw else set()
            have = {tuple(words[j : j + m]) for j in range(len(words) - m + 1)}
            if want and 5 * len(want & have) >= 4 * len(want):
                out.append((i, item, len(want), len(want & have)))
    return sorted(out, key=repr)


def test_benchmark_search(spark, monkeypatch, odd, empty):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 6, 12, 40, 90])))) for i in range(40)] + [(90, None), (91, ""), (92, "A"), (93, "a")]
    docs = []
    for i in range(120):
        w = rng.choices(vocab, k=rng.randint(0, 300))
        for _ in range(rng.randint(0, 2)):
            x = rng.choice(items[:40])[1].split()
            for _ in range(rng.randint(0, max(1, len(x) // 12))):
                x[rng.randrange(len(x))] = "CHANGED"
            at = rng.randint(0, len(w))
            w[at:at] = x
        docs.append((i, " ".join(w).upper() if i % 9 == 0 else " ".join(w)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_found(docs, items)
    cut = lambda rows: sorted((tuple(r)[:4] for r in rows), key=repr)
    assert cut(contain.find_items(spark, df, bench).collect()) == want and want
    monkeypatch.setattr(contain, "ITEMS", 9)  # more than one block of items
    twice = bench.union(bench.where("item_id % 3 = 0")), df.union(df.where("doc_id % 4 = 0"))  # repeated items and documents
    again = brute_found(docs + [d for d in docs if d[0] % 4 == 0], items + [i for i in items if i[0] % 3 == 0])
    assert cut(contain.find_items(spark, df, bench).collect()) == want
    assert cut(contain.find_items(spark, twice[1], twice[0]).collect()) == again
    with monkeypatch.context() as m:  # more blocks than documents pass, and a small filter
        m.setattr(contain, "PASSES", 2), m.setattr(contain, "SEGMENTS", 8), m.setattr(contain, "SEGMENT_BITS", 256), m.setattr(contain, "SLICE", 3)
        assert cut(contain.find_items(spark, df, bench).collect()) == want
        assert cut(contain.find_items(spark, twice[1], twice[0]).collect()) == again
        joined = contain.decontaminate(spark, odd.union(odd), bench)
        assert joined.columns == odd.columns and joined.count() == 2 * contain.decontaminate(spark, odd, bench.limit(0)).count() - 2 * len({x[0] for x in brute_found(ODD, items)})
        assert {r.doc_id for r in contain.decontaminate(spark, df, bench).collect()} == {i for i, _ in docs} - {x[0] for x in want}
        assert contain.find_items(spark, empty, bench).count() == 0
    clean = contain.decontaminate(spark, df, bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {x[0] for x in want}
    assert contain.find_items(spark, df, bench.limit(0)).count() == 0 and contain.find_items(spark, empty, bench).count() == 0
    kept = contain.decontaminate(spark, odd, bench)
    assert kept.columns == odd.columns and kept.count() > 0


# ---- secrets


def test_secrets(spark, empty):
    rng = random.Random(8)
    hexed = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    words = "the quick brown fox jumps over lazy dogs and other animals".split()
    prose = lambda: " ".join(rng.choices(words, k=40))
    rows, secret = [], set()
    for i in range(200):
        t = prose()
        if i % 4 == 0:
            t += f' token = "{hexed(40)}" '
            secret.add(i)
        elif i % 4 == 1:
            t += f" 4{rng.randint(10**14, 10**15 - 1)} "
        elif i % 4 == 2:
            t += " the_quick_brown_fox_2019 "
        rows.append((i, t + prose(), None if i % 5 else "src/main"))
    rows.append((None, None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets_rf.find_secrets(spark, df).collect()
    found = {r.doc_id for r in got}
    assert len(found & secret) >= 0.95 * len(secret) and len(found - secret) <= 2
    text = dict((r[0], r[1]) for r in rows)
    assert all(text[r.doc_id].encode()[r.start : r.start + 4].decode() + "..." == r.preview for r in got)
    assert secrets_rf.find_secrets(spark, empty).count() == 0


def test_short_secrets(spark):
    """Short passwords, secrets with signs and URL credentials are candidates, and are found among prose."""
    for text, value in [(b'password = "Tr0ub4dor&3x"', b"Tr0ub4dor&3x"), (b"password: Xk9#mQ2$vL7!pR4@", b"Xk9#mQ2$vL7!pR4@"), (b"postgres://svc:s3cr3tPass9@db.local/x", b"s3cr3tPass9"), (b"pwd hY7$kq", b"hY7$kq")]:
        got = list(secrets_rf.candidates(b"so " + text + b" on"))
        assert [(x[0], x[1]) for x in got] == [((b"so " + text).index(value), value)]
    rng = random.Random(3)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&*"
    words = "the quick brown fox jumps over lazy dogs and other animals".split()
    rows, secret = [], set()
    for i in range(160):
        t, value = " ".join(rng.choices(words, k=30)), "".join(rng.choices(signs, k=12))
        if i % 2:
            secret.add(i)
            t += rng.choice([f' password = "{value}" ', f" pwd: {value} ", f" postgres://svc:{value}@db.local/x "])
        else:
            t += rng.choice([" seen: animals2019 ", " total = 1234509 ", " see https://fox.example/dogs?page=lazy12 "])
        rows.append((i, t + " ".join(rng.choices(words, k=30)), "src/main"))
    found = {r.doc_id for r in secrets_rf.find_secrets(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(found & secret) >= 0.9 * len(secret) and len(found - secret) <= 2


WORDS = [w.encode() for w in "the quick brown fox jumps over lazy dogs and other animals of every kind".split()]


def test_forest_is_held_out_accurate(spark):
    """A forest fitted on findings made for some documents judges those made for others."""
    language = secrets_rf.Language([(w.decode(), 9) for w in WORDS if len(w) > 2])

    def rows(seeds):
        found = [(float(y), language.features(None, v, b, a)) for s in seeds for v, b, a, y in secrets_rf.made_up(s, WORDS)]
        return spark.createDataFrame(found, "label double, features array<double>")

    model = secrets_rf._fit(rows(range(400)), 40, 8)
    from pyspark.ml.functions import array_to_vector

    judged = model.transform(rows(range(1000, 1200)).withColumn("features", array_to_vector("features")))
    cells = Counter((r.label, r.prediction) for r in judged.select("label", "prediction").collect())
    assert cells[1, 1] / (cells[1, 1] + cells[1, 0]) > 0.95 and cells[1, 1] / (cells[1, 1] + cells[0, 1]) > 0.95
    assert len(secrets_rf.FEATURES) == len(language.features(None, b"abc", b"", b""))


def test_planted_secrets_of_unseen_kinds(spark):
    """Precision and recall where neither values, lengths nor leads were made for training."""
    rng = random.Random(12)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    prose = lambda n: " ".join(w.decode() for w in rng.choices(WORDS, k=n))
    secrets = [
        lambda: f" ghp_{pick(lower + lower.upper() + digits, 36)} ",
        lambda: f" Authorization: Bearer {pick(lower + lower.upper() + digits, 52)} ",
        lambda: f" access_key = '{pick(lower.upper() + digits, 20)}' ",
        lambda: f" private={pick('0123456789abcdef', 48)} ",
    ]
    others = [
        lambda: f" {pick(digits, 17)} ",
        lambda: f" /usr/{'/'.join(w.decode() for w in rng.choices(WORDS, k=4))}{rng.randint(1, 9)} ",
        lambda: f" {'_'.join(w.decode() for w in rng.choices(WORDS, k=4))}_{rng.randint(1, 99)} ",
        lambda: f" token = example_{'_'.join(w.decode() for w in rng.choices(WORDS, k=2))}_1 ",
    ]
    rows, planted = [], set()
    for i in range(320):
        one = (secrets if i % 2 else others)[i // 2 % 4]()
        planted |= {i} if i % 2 else set()
        rows.append((i, prose(30) + one + prose(30), "src/main"))
    found = {r.doc_id for r in secrets_rf.find_secrets(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(found & planted) >= 0.9 * len(planted) and len(found & planted) >= 0.9 * len(found)


def brute_runs(text):
    """Candidates by their own length, by looking at each character."""
    allowed = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.~-")
    names = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-")
    cues = [b"token", b"secret", b"password", b"passwd", b"pwd", b"auth", b"credential", b"bearer", b"private"] + [x + y + b"key" for x in (b"api", b"access") for y in (b"", b"_", b"-")]
    word = lambda c: chr(c).isalnum() and c < 128 or c == 95
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in allowed:
            j += 1
        if j - i >= 16:
            start, end = i, j
            while end > start and text[end - 1] == 46:
                end -= 1
            h = start
            while h < end and text[h] in names:
                h += 1
            e = h
            while e < end and text[e] == 61:
                e += 1
            head = 2 <= h - start <= 25 and not 48 <= text[start] <= 57 and text[start] != 45 and e > h and end - e >= 8
            if head:
                start = e
            before = text[max(0, start - 48) : start]
            bare = before
            while bare and len(before) - len(bare) < 12 and not word(bare[-1]):
                bare = bare[:-1]
            cued = any(before[: len(before) - k].lower().endswith(c) for k in range(len(before) - len(bare) + 1) for c in cues)
            value = text[start:end]
            mixed = any(97 <= x <= 122 and 65 <= y <= 90 for x, y in zip(value, value[1:]))
            if len(value) >= (8 if head else 16) and (any(48 <= c <= 57 for c in value) or mixed or cued):
                out.append((start, value, before, text[end : end + 48]))
        i = max(j, i + 1)
    return out


def test_candidates_against_a_plain_scan():
    rng = random.Random(21)
    pieces = ["token", " = ", '"', "abcDEF", "0123456789", "_", "-", ".", "/", " ", " ", "api_key", ":", "x" * 14, "the quick brown", "=", "é", "\n", "AKIA", "Bearer ", "((", "zz9"]
    n = 0
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))).encode()
        got = list(secrets_rf._runs(text))
        assert got == brute_runs(text), text
        every = list(secrets_rf.candidates(text))
        assert [x for x in every if x in got] == got
        spans = sorted((x[0], x[0] + len(x[1])) for x in every)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:])) and all(text[s : s + len(v)] == v and len(v) >= 6 for s, v, _, _ in every)
        n += len(got)
    assert n > 500


def test_labelled_documents_are_bounded(spark, monkeypatch, odd):
    """No more distinct documents than said, whatever ids they have; equal ones count once."""
    monkeypatch.setattr(secrets_rf, "LABELLED", 20)
    rows = [(None if i % 2 else 7, f"words of a document {i} token = \"{i:040x}\"", "a") for i in range(300)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets_rf.scan(spark, df, "doc_id", "text", "source").where("value IS NOT NULL")
    got = secrets_rf._labelled(spark, df, found, "doc_id", "text", "source").collect()
    known = [r for r in got if bytes(r.before).endswith(b'token = "') and len(bytes(r.value)) == 40 and bytes(r.value).startswith(b"0" * 30)]
    assert len(got) - len(known) == 6 * 20 and len(known) == 20
    assert len({bytes(r.value) for r in known}) == 20
    assert secrets_rf.find_secrets(spark, odd).columns == ["doc_id", "start", "length", "preview", "probability"]


# ---- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    from .test_dedup_ops import brute_components, brute_fingerprint

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {r.doc_id for r in quality_ledger.assess(spark.createDataFrame(list(docs.values()))).where("kept").collect()}
    comp = brute_components({i: brute_fingerprint(docs[i].text) for i in kept})
    kept = {i for i in kept if comp[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept -= {x[0] for x in brute_found([(i, docs[i].text) for i in kept], items)}
    times = {r.doc_id: r.times for r in mixing.mix(spark, spark.createDataFrame([docs[i] for i in sorted(kept)])).collect()}
    want = brute_tokens([(i, docs[i].text) for i in kept for _ in range(times[i])])
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(want)


def test_pipeline_of_nothing(spark, tmp_path, sf_dir):
    import corpus_pipeline

    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_odd(spark, tmp_path, sf_dir):
    """Nulls, empty and long texts, repeats, ties and clashing names through all stages."""
    import corpus_pipeline

    long = " ".join(f"u{i} v{i % 977}" for i in range(40_000))
    rows = [(i, t, "x", f"s{(i or 0) % 2}" if i != 2 else None) for i, t in ODD] + [(20, long, "x", None), (20, long, "x", None), (None, long + " end", "x", "s1"), (21, long.upper(), "x", "s0")]
    names = "doc_id long, text string, lang string, source string"
    extra = ["row", "row_key", "row_n", "mix_s", "place", "did", "id", "fp", "key", "h", "own"]
    df = spark.createDataFrame(rows, names).select("*", *[F.lit(1).alias(c) for c in extra])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, step(spark, docs, str(tmp_path))
        assert docs.columns == before.columns, name
    # of the long text, its repeats and its upper-case twin one row stays; the one with a further word has its own fingerprint or joins them
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    assert (10, dict(ODD)[10]) in kept and len([i for i, t in kept if t.lower().startswith("u0 v0")]) <= 2 and (21, long.upper()) not in kept
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = Counter(r.doc_id for r in docs.collect())
    assert Counter(r.doc_id for r in out) == times and len(out) > 0
