import random
import time

import pytest

from tessera.llm import html_extract as H


def page(k, body, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T {k}</title><style>p{{x}}</style><script>var a='</p>';</script></head><body>"
            f"<header>Site name</header><nav><ul><li><a href='/'>Home<li><a href='/n'>News {k}</ul></nav>{extra}"
            f"{body}<aside>Side {k}</aside><form><input value=x><label>Mail</label></form>"
            f"<footer>&copy; site {k}</footer></body></html>")


ARTICLES = [f"<h1>Title {k} &amp; more</h1><p><b>Lead {k}<br><p>Body&nbsp;of  article\n number {k}.<p>Last &lt;words&gt; {k}" * 2 for k in range(8)]
WANT = [" ".join([f"Title {k} & more Lead {k} Body of article number {k}. Last <words> {k}"] * 2) for k in range(8)]


@pytest.mark.parametrize("open_,close", [
    ("<article>", "</article>"), ("<main><div class='post'>", "</div></main>"), ("<div class='content'>", "</div>"),
    ("<article><div class='has-sidebar'>", "</div></article>"), ("<ARTICLE>", "")])
def test_wrapper_finds_the_article(open_, close):
    notice = "<div class='cookie-notice'>We use cookies</div><div class=ad>Buy now</div>"
    comments = "<section id='comments'><p>Nice read, said a reader at length, and more than the article itself has to say.</section>"
    pages = [page(k, open_ + ("<div class='advert'>Ad</div>" + a if "sidebar" not in open_ else a) + close + comments, notice)
             for k, a in enumerate(ARTICLES)]
    wrapper = H.induce(pages)
    wrapper["constant"] = {tuple(x) for x in wrapper["constant"]}
    for html, want in zip(pages, WANT):
        assert H.extract(html, wrapper) == want


def test_template_texts_inside_the_article_are_dropped_but_copies_are_kept():
    pages = [page(k, f"<article><p>Follow our channel</p>{a}</article>") for k, a in enumerate(ARTICLES)]
    wrapper = H.induce(pages)
    wrapper["constant"] = {tuple(x) for x in wrapper["constant"]}
    assert H.extract(pages[3], wrapper) == WANT[3]
    copies = [page(1, f"<article>{ARTICLES[1]}</article>")] * 6
    wrapper = H.induce(copies)
    assert wrapper["constant"] == [] and H.extract(copies[0], wrapper) == WANT[1]


def test_simple_tree_matching():
    a, b = H.parse("<div><p>1</p><p>2</p><ul><li>3</ul></div>"), H.parse("<div><p>x</p><ul><li>y<li>z</ul></div>")
    pairs = []
    assert H.align(a, b, pairs) == 5  # root, div, p, ul, li
    assert sorted(x.tag for x, _ in pairs) == ["#root", "div", "li", "p", "ul"]
    assert H.align(a, a) == sum(1 for _ in H.elements(a))


def test_pages_of_every_kind(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", page(k, f"<article>{a}</article>"), 1) for k, a in enumerate(ARTICLES)]
    rows += [(20, None, None, 1), (21, "no url", "", 1), (22, "http://x.example", "plain text only", 1),
             (23, "http://y.example", "<" * 50, 1), (24, None, "<p>" * 3000 + "deep", 1), (0, rows[0][1], rows[0][2], 1),
             (25, "http://z.example", "<p>" + "long " * 50000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = H.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert [texts[k] for k in range(8)] == WANT
    assert (texts[20], texts[21], texts[22], texts[24]) == ("", "", "plain text only", "deep")
    assert texts[25] == ("long " * 50000).strip()
    assert H.extract_pages(df.limit(0)).collect() == []


def site(spark, sources, host="h.example"):
    rows = [(k, f"http://{host}/{k}", s) for k, s in enumerate(sources)]
    return {r.page_id: r.text for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_do_not_hide_the_template_of_a_host(spark):
    sources = [page(k, f"<article><p>Follow our channel</p>{a}</article>") for k, a in enumerate(ARTICLES)]
    hashes = spark.createDataFrame(enumerate(sources), "k int, html string").selectExpr("k", "xxhash64(html) as h").collect()
    first = min(hashes, key=lambda r: r.h).k
    got = site(spark, sources + [sources[first]] * 20)
    assert [got[k] for k in range(8)] == WANT


def test_every_layout_of_a_host_has_its_template(spark):
    sources = [page(k, f"<article class='{'news' if k % 2 else 'blog'}'><p>{'Follow us' if k % 2 else 'Join here'}</p>{a}</article>")
               for k, a in enumerate(ARTICLES)]
    got = site(spark, sources)
    assert [got[k] for k in range(8)] == WANT


def test_large_and_deep_pages_take_part(spark):
    filler = ["<br>" * 2500, "<div>" * 400]
    for f in filler:
        got = site(spark, [page(k, f"<article><p>Follow our channel</p>{a}{f}</article>") for k, a in enumerate(ARTICLES)])
        assert [got[k] for k in range(8)] == WANT


def test_unclosed_quotes_and_huge_tags_end_at_the_next_bracket():
    def text(source):
        return H.extract(source, None)
    for tag in ('<p title="' + "x" * 100_000 + ">", "<p title='" + "y z=" * 25_000 + ">", "<p " + 'a="b" ' * 20_000 + ">",
                "<p " + "'\"" * 50_001 + ">"):
        start = time.perf_counter()
        assert text(f"<html><body><article>{tag}Told words stay here.</p></article></body></html>") == "Told words stay here."
        assert time.perf_counter() - start < 1


def test_all_pages_of_a_layout_choose_the_path(spark):
    # The dozen pages with the smallest hashes hold their article in the box itself, twenty others in a quote with a line below.
    def inner(k):
        return f"<div class=box><p>Story {k} {'word ' * 40}end {k}.</p><p>Second {k} {'more ' * 40}end.</p></div>"

    def quoted(k):
        return (f"<div class=box><blockquote><p>Story {k} {'word ' * 40}end {k}.</p><p>Second {k} {'more ' * 40}end.</p>"
                f"</blockquote><p>Printed {k} in town</p></div>")
    made = [(k, f(k)) for k, f in [(k, inner) for k in range(60)] + [(100 + k, quoted) for k in range(60)]]
    rows = spark.createDataFrame(made, "k int, html string").selectExpr("k", "html", "xxhash64(html) as h").orderBy("h").collect()
    few = [r for r in rows if r.k < 100][:12]
    many = [r for r in rows if r.k >= 100 and r.h > few[-1].h][:20]
    assert len(many) == 20
    df = spark.createDataFrame([(r.k, "http://h.example/", r.html) for r in few + many], "page_id long, url string, html string")
    for r in H.extract_pages(df).collect():
        k = r.page_id
        assert r.text == f"Story {k} {'word ' * 40}end {k}. Second {k} {'more ' * 40}end."


def test_alignment_of_trees_is_the_largest():
    def plain(x, y):
        if x.name != y.name:
            return 0
        p, q = ([c for c in n.children if not isinstance(c, str)] for n in (x, y))
        table = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, c in enumerate(p):
            for j, d in enumerate(q):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + plain(c, d))
        return table[-1][-1] + 1
    rng = random.Random(3)

    def tree(depth):
        return "".join(f"<div class={rng.choice('abc')}>{tree(depth - 1)}</div>" for _ in range(rng.randint(0, 3))) if depth else "x"
    for _ in range(100):
        a, b, pairs = H.parse(tree(4)), H.parse(tree(4)), []
        assert H.align(a, b, pairs) == plain(a, b) == len(pairs)


def test_the_operator_finds_the_wrapper_of_pages_in_memory(spark):
    sources = [page(k, f"<article><p>Follow our channel</p>{a}</article>") for k, a in enumerate(ARTICLES)]
    wrapper = H.induce(sources)
    wrapper["constant"] = {tuple(x) for x in wrapper["constant"]}
    assert site(spark, sources) == {k: H.extract(s, wrapper) for k, s in enumerate(sources)}


def test_the_blocks_of_a_page_are_decoded_together(monkeypatch):
    calls, unescape = [], H.html.unescape
    monkeypatch.setattr(H.html, "unescape", lambda s: calls.append(s) or unescape(s))
    page = H.parse("<body>" + "".join(f"<p>a{i} &am</p><div class='x{i % 3}'>p; b&lt;\u00a0</div>" for i in range(40)))
    assert H.text_of(page).split() == [w for i in range(40) for w in (f"a{i}", "&am", "p;", "b<")]
    assert len(calls) == 1
