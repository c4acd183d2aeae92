"""Operators over embeddings and pages, and the pipeline, against plain versions."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import html, topk, urls
from chunkloom.llm import queries as Q
from chunkloom.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"


def brute(vectors, ids, k=10):
    out = {}
    for q in ids:
        rows = [(-int(np.floor(1024 * np.array(v)) @ np.floor(1024 * np.array(vectors[q]))), i) for i, v in vectors.items() if i != q]
        out[q] = [(i, -s) for s, i in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize(("n", "block"), [(5, 8192), (300, 64), (300, 8192)])
def test_top_k(spark, monkeypatch, n, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    r = np.random.default_rng(1)
    base = r.normal(size=(7, 6))
    vectors = {i: [float(np.float32(x)) for x in (base[i % 7] if i % 3 else r.normal(size=6))] for i in range(n)}
    vectors[3] = [0.0] * 6
    odd = [(9000, None), (9100, [1.0, None]), (9200, [float("nan")] * 6), (9300, [float("inf")] * 6)]
    d = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>")
    ids = [i for i in vectors if i % 100 == 0 or i == 3]
    got = defaultdict(list)
    for x in sorted(topk.top_k(d, d.where("vec_id % 100 = 0 OR vec_id = 3")).collect()):
        assert x.rank == len(got[x.query_id]) + 1
        got[x.query_id].append((x.vec_id, x.score))
    assert dict(got) == {q: x for q, x in brute(vectors, ids).items() if x}


def test_top_k_large_values_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    d = spark.createDataFrame([(0, [1e15, 1.0]), (1, [3.0, 1.0]), (2, [3.0, 2.0]), (3, [1e300, 0.0]), (4, [])], schema)
    got = [(x.vec_id, x.score) for x in sorted(topk.top_k(d, d.where("vec_id = 0")).collect())]
    assert got == [(1, 2**63 - 1), (2, 2**63 - 1), (3, 2**63 - 1), (4, 0)]  # clipped, so ties
    e = spark.createDataFrame([], schema)
    assert topk.top_k(e, e).collect() == [] and topk.top_k(d, e).collect() == [] and topk.top_k(e, d).collect() == []
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [2.0]), (2, [3.0]), (2, [3.0]), (None, [9.0]), (3, None)], schema)
    for c in ("block", "asks", "query", "rank", "score"):
        odd = odd.withColumn(c, F.lit("clash"))
    got = [tuple(x) for x in topk.top_k(odd, odd.where("vec_id = 1 or vec_id is null"), scale=1).collect()]
    assert sorted(got) == [(1, 1, 2, 3), (1, 1, 2, 6), (1, 2, 2, 3), (1, 2, 2, 6)]


URLS = ["http://A.org/x", "https://example.org/es/1?q", "https://m.example.org/en/12#t", "https://example.org/en/2", "http://a.com/fr/", "http://a.com/de/x", "http://com/fr/", "http://free-bets.example.net/en", "http://x.net", "mailto:a", None, "", "http://a.org", "http://alphabets.net/", "a://b://c/d", "http://notexample.org/es/", "ftp://bets.org/"]


def test_url_rules(spark):
    d = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    out = {r.page_id: r for r in urls.judge_urls(d).collect()}
    scopes = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in scopes if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if "bets" in host.replace("-", ".").split(".") else "allow")
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, rule, verdict), u
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_url_rules_stand_odd_rows(spark):
    rows = [(1, "http://a.org/" + "x" * 200_000), (1, "http://a.org/"), (1, "http://a.org/"), (None, None), (2, ""), (3, "http://" + "casino-" * 9000)]
    d = spark.createDataFrame(rows, "page_id long, url string")
    for c in ("host", "path", "rule", "verdict", "t", "n"):
        d = d.withColumn(c, F.lit("clash"))
    got = urls.judge_urls(d).collect()
    assert len(got) == 6 and sorted(str(r.page_id) for r in got if r.rule == "org/") == ["1"] * 3
    other = d.select(F.col("url").alias("link")).select(urls.host_of(F.col("link")).alias("h"), urls.path_of(F.col("link")).alias("p")).collect()
    assert ("a.org", "/") in {(r.h, r.p) for r in other}


def test_index_fetches_only_candidates():
    rules = tuple(urls.pattern("block", f"word{i}") for i in range(500))
    index = urls.RuleIndex(rules, {"word7": 1})
    assert [r.tokens for _, r in index.candidates("word7.net/a")] == [("word7",)]
    place = "x.word7.net/word9"
    assert index.judge(place, "allow") == (None, "block")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site name</header>
<nav><ul><li><a href="/">Home</a></li><li><a>About</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>{open}<h1>{n} &amp; title</h1>
<p>First&nbsp;para {n}<br>goes  on.<p>Second <b>bold</b> &#233;<script>x</script></p><form><p>Sign up</p></form><div class="comments"><p>Nice!</p></div><ul><li>one<li>two</ul>{close}
<aside>Side</aside><footer>&copy; x</footer></body></html>"""
WANT = "{n} & title\nFirst para {n} goes on.\nSecond bold é\none\ntwo"


@pytest.mark.parametrize(("a", "b"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="story-body">', "</div>"), ("<article>", "")])
def test_main_text(spark, a, b):
    rows = [(i, f"http://h{i % 2}.net/{i}", PAGE.format(open=a, close=b, n=f"page {i} " + "words " * (5 + i))) for i in range(12)]
    rows += [(100, None, None), (101, "http://h0.net/", ""), (102, "x", "only text"), (103, "http://h1.net", "<p>a<p>b")]
    out = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        n = " ".join((f"page {i} " + "words " * (5 + i)).split())
        assert out[i].text == WANT.format(n=n) and out[i].n_chars == len(out[i].text)
    assert [out[i].text for i in (100, 101, 102, 103)] == ["", "", "only text", "a\nb"]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_markup_that_is_not_tidy():
    page = """<article title=it's><p data-x="a > b">one<p hidden>no</p><p class='x' style="display: none">no<p>two &lt; three <a href="u'v">four</a><!-- no -->"""
    assert html.main_text(page, None) == "one\ntwo < three four"


def test_wrapper_generalises():
    pages = [f"<html><body><article><h1>t{i}</h1>{'<p>x' + str(i) + '</p>' * 1}{'<p>more</p>' * i}{'<table><tr><td>z</td></tr></table>' if i % 2 else ''}</article></body></html>" for i in range(4)]
    w = html.infer([html.texts(p) for p in pages])
    assert w.container == ("html", "body", "article")
    assert w.expression.startswith("<html><body><article><h1>#</>(<p>#</>)+") and ")?" in w.expression


def test_page_queries_against_plain_versions(spark):
    import re

    from chunkloom.storage import table

    pages = {r.page_id: r for r in table(spark, SF, "pages").collect()}
    for r in Q.op8_html_text(spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        blocks = (" ".join(html.entities.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)


def test_shingles_of_slices():
    import pyarrow as pa

    t = pa.array(["skip", "A b c d e", None, "", "a B C d E", "x y", "x  Y"])[1:]
    s = [x.tobytes() for x in shingle_sets(t, 4)]
    assert s[0] == s[3] and s[1] == s[2] == b"" and s[4] == s[5] and len(s[0]) == 16


def test_pipeline(spark):
    import corpus_pipeline as P
    from chunkloom.llm import jaccard, pii, toxic
    from chunkloom.storage import staged, table

    docs = table(spark, SF, "documents")
    kept, at = [docs], docs
    for _, stage in P.STAGES:
        at = staged(stage(spark, at, SF), "test")
        kept.append(at)
    for d in kept[:-1]:
        assert d.columns == list(P.COLUMNS)
    before, calm, single, masked, mixed = ({r.doc_id: r.text for r in d.collect()} for d in kept[:5])
    scores = {r.doc_id: r.predicted for r in toxic.score(docs, table(spark, SF, "labels")).collect()}
    assert set(calm) == {i for i in before if not scores[i]}
    groups = {r.doc_id: r.component_id for r in jaccard.join(kept[1], 5, 80).collect()}
    assert set(single) == set(groups.values())
    assert set(masked) == set(single) and set(mixed) <= set(masked)
    assert not any(r.n_email + r.n_ip + r.n_card + r.n_phone for r in pii.digest(kept[3]).collect())
    assert all(len(masked[i]) == r for i, r in ((x.doc_id, x.n_chars) for x in kept[3].collect()))
    words = defaultdict(int)
    for r in kept[4].collect():
        assert r.text == masked[r.doc_id]
        words[r.source] += len(r.text.split())
    pieces = kept[5].collect()
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p.doc_id] += p.length
    copies = defaultdict(int)
    for r in kept[4].collect():
        copies[r.doc_id] += 1
    full = {p.doc_id: p.doc_tokens for p in pieces}
    assert tokens == {i: n * full[i] for i, n in copies.items()} and max(copies.values()) <= 2


def test_pipeline_stands_odd_rows(spark):
    import corpus_pipeline as P
    from chunkloom.storage import staged

    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three four five six", "en", "a", 27), (3, "one two three four five six", "en", "a", 27), (None, "lost words", "en", "b", 10), (None, "lost words", "en", "b", 10), (7, "mail a@b.co", "en", "b", 11)]
    for data in (rows, []):
        at = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in P.STAGES:
            at = staged(stage(spark, at, SF), "test")
        ids = {r.doc_id for r in at.collect()}
        assert ids <= {1, 2, 3, None, 7}


def test_no_group_is_lost_to_an_id_that_two_texts_share(spark):
    import corpus_pipeline as P

    x, y = "one two three four five six seven", "seven eight nine ten eleven twelve one"
    rows = [(i, t, "en", "a", len(t)) for i, t in ((1, x), (3, x), (3, y), (4, y), (None, y), (None, "lost words"))]
    got = P.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, x), (3, y), (None, "lost words")}


def test_no_text_of_an_article_is_lost(spark):
    """Alike pages of a host, headings that recur, names inside the container, small articles in a long main, frames of bare bodies."""
    say = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, f"http://same.net/{i}", f'<title>{i}</title><div class="content"><p>Same body of all pages<p>and more of it</div><div class="footer">{i}</div>') for i in range(9)]
    rows += [(100 + i, f"http://head.net/{i}", f'<div class="content"><h2>Summary</h2><p>{say(i, 30)}<p>{say(-i, 9)}</div>') for i in range(5)]
    named = '<article><p>one<div class="related-work"><p>two</div><div class="side">three</div><p class="notice">four<div class="ad">no</div><div class="comments"><p>no</div></article>'
    rows += [(200, "http://n.net/", named), (201, "http://n.net/", f'<main><p>{say(1, 50)}<article class="card">teaser</article></main>')]
    rows += [(202, "http://n.net/", f"<main><h1>title</h1><article><p>{say(2, 50)}</article></main>"), (203, "http://n.net/", '<div class="side"><article>only this</article></div>')]
    rows += [(204, "http://n.net/", f"<article>small</article><article class='b'><p>{say(3, 40)}</article>")]
    rows += [(300 + i, f"http://bare.net/{i}", f"<body><div>Our site</div><p>{say(i, 30)}<p>Summary<p>{say(-i, 30)}<div>All rights kept</div></body>") for i in range(6)]
    rows += [(400, None, "<div>" * 5000 + f"<p>{say(4, 5)}" + "</b>" * 5000), (None, "http://n.net/", "<p>no id"), (401, "http://n.net/", named), (401, "http://n.net/", named)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "layout", "text", "container", "constants", "path", "value"):
        d = d.withColumn(c, F.lit("clash"))
    got = html.extract(d).collect()
    out = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and {out[i] for i in range(9)} == {"Same body of all pages\nand more of it"}
    assert all(out[100 + i] == "\n".join(("Summary", say(i, 30), say(-i, 9))) for i in range(5))
    assert out[200] == out[401] == "one\ntwo\nthree\nfour" and out[201] == f"{say(1, 50)}\nteaser" and out[202] == say(2, 50)
    assert out[203] == "only this" and out[204] == say(3, 40) and out[400] == say(4, 5) and out[None] == "no id"
    assert all(out[300 + i] == "\n".join((say(i, 30), "Summary", say(-i, 30))) for i in range(6))


def test_long_sequences_stay_whole():
    many = [html.Item(f"k{i}", [html.Item("#", value="x", chars=1)]) for i in range(500)]
    both = html.align(many, many[::-1])
    assert sum(map(html._chars, both)) == 1000


def test_sequences_follow_the_position(spark):
    """Several files of unequal size between mixing and packing: the later positions' are the larger ones."""
    import corpus_pipeline as P
    from chunkloom.llm import mix
    from chunkloom.storage import staged

    rows = [(i, f"{'long' if i % 3 == 0 else 'short'} {i} " + " ".join(f"w{i * j % 997}" for j in range(900 if i % 3 == 0 else 5)), "en", f"s{i % 3}", 0) for i in range(1200)]
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "test")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        mixed = staged(P.mix_sources(spark, docs, SF), "test")
        pieces = P.pack_sequences(spark, mixed, SF).collect()
    finally:
        spark.conf.unset(key)
    assert len(mixed.inputFiles()) > 2
    places = defaultdict(list)
    for r in sorted(mix.copies(docs).collect(), key=lambda r: r.position):
        places[r.doc_id].append(r.position)
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    assert len(order) == sum(map(len, places.values()))
    at = [places[i].pop(0) for i in order]
    assert at == sorted(at)


def test_each_layout_of_a_host_has_its_wrapper(spark):
    """A rare layout shares the path of the common one, which holds a teaser there; one host has copies and a template line."""
    say = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    common = lambda i: f'<div class="content"><h1>t{i}</h1><p>{say(i, 30)}<p>{say(-i, 9)}</div>'
    rare = lambda i: f'<div class="content"><p>teaser {i}</div><div class="story"><p>{say(i, 40)}<p>{say(-i, 8)}</div>'
    rows = [(i, f"http://a.net/{i}", rare(i) if i % 20 == 7 else common(i)) for i in range(100)]
    rows += [(200 + i, f"http://b.net/{i}", f'<div class="content"><h1>Heading</h1><p>{say(1, 20)}<p>{say(2, 9)}</div>') for i in range(30)]
    rows += [(300 + i, f"http://c.net/{i}", f'<div class="content"><h2>Template</h2><h1>t{i}</h1><p>{say(i, 20)}<p>{say(-i, 9)}</div>') for i in range(30)]
    rows += [(400, "http://a.net/400", f"<article><p>{say(400, 3)}</article>{common(400)}")]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(100):
        assert out[i] == "\n".join((say(i, 40), say(-i, 8)) if i % 20 == 7 else (f"t{i}", say(i, 30), say(-i, 9)))
    assert {out[200 + i] for i in range(30)} == {"\n".join(("Heading", say(1, 20), say(2, 9)))}
    assert all(out[300 + i] == "\n".join(("Template", f"t{i}", say(i, 20), say(-i, 9))) for i in range(30))
    assert out[400] == say(400, 3)


def test_wrappers_are_aligned_from_all_pages(spark, monkeypatch):
    """Pages with and without an article get the expression of all pages of their layout, in one group and in many; a fragment is whole."""
    say = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    story = lambda i: f"<html><body><div>Our site</div><article><h1>t{i}</h1><p>{say(i, 9)}{'<p>more' * (i % 3)}{'<h2>x</h2><p>last' if i == 17 else ''}</article></body></html>"
    bare = lambda i: f"<html><body><div>Our site</div><p>{say(i, 30)}{f'<div>x{i}</div><p>y' if i % 2 else ''}<div>All rights kept</div></body></html>"
    rows = [(i, f"http://a.net/{i}", story(i)) for i in range(40)] + [(100 + i, f"http://b.net/{i}", bare(i)) for i in range(40)]
    rows += [(200, "http://c.net/", f"<div>{say(1, 3)}</div><p>{say(2, 40)}<ul><li>one</ul>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (1024, 4):
        monkeypatch.setattr(html, "GROUP", group, raising=False)
        found = {(r.host, tuple(r.container)): r for r in html.wrappers(pages.unionAll(pages)).collect()}
        assert len(found) == 3
        assert found["a.net", ("html", "body", "article")].expression.startswith("<html><body><div>Our site</><article><h1>#</>(<p>#</>)+(<h2>x</>)?")
        assert found["b.net", ("html", "body")].expression == "<html><body><div>Our site</>(<p>#</>)(<div>#</>)?(<p>y</>)?<div>All rights kept</></></>".replace("(<p>#</>)(", "<p>#</>(")
        assert sorted(found["b.net", ("html", "body")].constants) == ["All rights kept", "Our site"]
        out = {r.page_id: r.text for r in html.extract(pages).collect()}
        assert out[17] == "\n".join(("t17", say(17, 9), "more", "more", "x", "last"))
        assert out[101] == f"{say(1, 30)}\nx1\ny" and out[102] == say(2, 30) and out[200] == "\n".join((say(1, 3), say(2, 40), "one"))


def test_wrappers_stay_small():
    """Elements that one page each has become one optional item, and constants before and behind them stay; long sequences keep both ends."""
    page = lambda i, n: html.texts("<body><div>Top</div>" + "".join(f"<p class='{chr(97 + i)}{chr(97 + j // 26)}{chr(97 + j % 26)}'>t" for j in range(n)) + "<div>End</div></body>")
    for n in (40, 600):
        w = html.infer([page(i, n) for i in range(20)])
        assert w.constants == {"Top", "End"} and len(w.expression) < 20_000 and f"(<{html.ANY}>" in w.expression
