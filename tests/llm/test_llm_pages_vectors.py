"""Operators on pages and vectors against brute force."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from cashweave.llm import html_text, topk_search, warc

PAGES = "page_id long, url string, html string, text string, host string, slots string, kind int, digest string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], PAGES)


ARTICLE = ("<html><head><title>t</title><script>var a='</p><p>no';</script></head><body><header><a href=/>Site</a></header>"
           "<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class='cookie-notice'>We use cookies</div>"
           "<main><article><h1>Title {k}</h1><p>First &amp; best <b>para</b>graph\n of {k}.<p>Second.<ul><li>one<li>two</ul>"
           "<div class='ad-box ad'>Buy</div><form><input><button>Go</button>Sign up</form>"
           "<section class='comments'><p>A reader says</p></section></article><aside>Related</aside></main>"
           "<footer>&copy; Site</footer></body></html>")


def test_main_text_of_a_template(spark):
    rows = [(k, f"http://a.example/{k}", ARTICLE.replace("{k}", str(k))) for k in range(6)]
    got = {r.page_id: r.text for r in html_text.main_text(pages(spark, rows)).collect()}
    assert got == {k: f"Title {k}\n\nFirst & best paragraph of {k}.\n\nSecond.\n\none\n\ntwo" for k in range(6)}


def test_regions_differ_by_host(spark):
    rows = [(1, "http://a/1", "<body><div id=sidebar>side</div><div class='post-content'><p>Alpha<p>Beta</div></body>"),
            (2, "http://a/2", "<body><div id=sidebar>side</div><div class='post-content'><p>Gamma</div><p>loose</body>"),
            (3, "http://b/1", "<body><main><p>Main text</main><p>loose</body>"),
            (4, "http://c/1", "<body><p>Plain words here.</p><p><a href=x>link only</a></p>tail"),
            (5, "http://b/2", "<body><p>no main on this one</body>")]
    got = {r.page_id: r.text for r in html_text.main_text(pages(spark, rows)).collect()}
    assert got == {1: "Alpha\n\nBeta", 2: "Gamma", 3: "Main text", 4: "Plain words here.\n\ntail", 5: "no main on this one"}


def test_main_text_of_nulls_repeats_broken_and_long_pages(spark):
    long = "<body><article>" + "<p>word word</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "http://a/", ""), (None, "http://a/", "<p>x<p>"), (4, "u", "a < b &lt; c <b"), (5, "http://a/", long),
            (6, "http://d/", deep), (7, "http://a/", "<p>x<p>"), (7, "http://a/", "<p>x<p>"), (8, "http://e/", "<article><p title=\"a>b\">q</p><!-- <p>no</p> ")]
    got = {(r.page_id, r.url): r.text for r in html_text.main_text(pages(spark, rows)).collect()}
    assert got[(1, None)] == "" and got[(2, "http://a/")] == "" and got[(None, "http://a/")] == "x" == got[(7, "http://a/")]
    assert got[(4, "u")] == "a < b < c" and got[(5, "http://a/")] == "\n\n".join(["word word"] * 20_000)
    assert got[(6, "http://d/")] == "deep" and got[(8, "http://e/")] == "q"
    assert html_text.main_text(pages(spark, [])).count() == 0
    assert html_text.main_text(pages(spark, rows)).count() == len(rows)


def _texts(html):
    return [(text, kind) for _, text, _, kind in html_text.blocks_of(html)[1]]


def test_all_words_and_ancestors_count():
    assert _texts("<body><div class='col xs col md hidden print sidebar'>side</div><div class='a b c d e f g content'><p>text</div>") == [("side", 0), ("text", 3)]
    deep = "".join(f"<div class=c{chr(97 + k % 26)}>" for k in range(60))
    assert _texts(f"<article>{deep}in</article>") == [("in", 1)] and _texts(f"<nav>{deep}menu</nav>") == [("menu", 0)]


def test_foreign_elements_swallow_no_text():
    page = ("<article><p>one <svg viewBox='0'/> two <svg><g><svg><text>no</text></svg></g><text>no</text></svg> three</p>"
            "<p>sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math></p><object data=x><p>four</p><video src=y><p>five</p><iframe src=z /><p>six</p></article>")
    assert [t for t, _ in _texts(page)] == ["one two three", "sum x+1", "four", "five", "six"]
    assert [t for t, _ in _texts("<p>a<object>no<object>no</object>no</object>b<p>c<script>no")] == ["ab", "c"]


def test_boilerplate_words_lose_no_article_text(spark):
    page = ("<body><nav>menu</nav><article><div class='post-header'><h1>Title</h1></div><h2 id='popular-culture'>Culture</h2><p class=share>p</p>"
            "<section id='related-work'><p>work</section><section id='discussion'><p>talk</section><div id='side-effects'>effects</div>"
            "<h2 id='Copyright_law'>law</h2><div class='ad-box'>Buy</div><ul class='comment-list'><li>me too</ul><aside>x</aside></article></body>")
    assert [t for t, kind in _texts(page) if kind] == ["Title", "Culture", "p", "work", "talk", "effects", "law"]
    loose = "<body><div class='cookie-notice'>c</div><div id=site-header>h</div><div id='side-effects'>e</div><section id=discussion>d</section></body>"
    assert [t for t, kind in _texts(loose) if kind] == ["e", "d"]
    rows = [(1, "http://a/", "<main><p>The whole long story.</p><article>teaser</article></main><p>loose"),
            (2, "http://b/", "<article>one</article><article>two</article><div class=content>three</div>"),
            (3, "http://c/", "<article>teaser</article><p>The whole long story is outside.</p>")]
    got = {r.page_id: r.text for r in html_text.main_text(pages(spark, rows)).collect()}
    assert got == {1: "The whole long story.\n\nteaser", 2: "one\n\ntwo\n\nthree", 3: "teaser\n\nThe whole long story is outside."}


def test_equal_text_is_template_and_varying_text_a_slot(spark):
    page = "<body><p>We use biscuits.</p><div><p>Story {k} is long enough.</p></div><p>Note {k}.</p><div>Imprint of the site</div></body>"
    rows = [(k, "http://a/", page.replace("{k}", str(k))) for k in range(6)]
    rows += [(6, "http://a/", "<body><p>We use biscuits.</p></body>")]
    rows += [(10 + k, "http://copies/", page.replace("{k}", "x")) for k in range(5)]                     # one page five times
    rows += [(20 + k, "http://main/", f"<main><div>Join us today</div><p>Text {k}</p></main>") for k in range(4)]
    frame = pages(spark, rows)
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    assert [got[k] for k in range(6)] == [f"Story {k} is long enough.\n\nNote {k}." for k in range(6)]
    assert got[6] == "We use biscuits."
    assert {got[10 + k] for k in range(5)} == {"We use biscuits.\n\nStory x is long enough.\n\nNote x.\n\nImprint of the site"}
    assert [got[20 + k] for k in range(4)] == [f"Text {k}" for k in range(4)]
    wrapper = {r.host: r.wrapper for r in html_text.wrappers_of(html_text.folded_pages(frame, html_text.template_texts(frame))).collect()}
    assert wrapper["a"].count('"=') == 2 and '"=' not in wrapper["copies"]


def test_folding_and_alignment():
    fold = html_text.Folder().fold
    assert fold("<ul <li # >li <li # >li <li # >li >ul".split()) == ["<ul", "(<li # >li)+", ">ul"]
    one = [[t, False] for t in fold("<b <p # >p <p # >p >b".split())]
    two = [[t, False] for t in fold("<b <p # >p <x # >x >b".split())]
    merged = html_text.align(one, two)
    assert merged == [["<b", False], ["(<p # >p)+", False], ["<x", True], ["#", True], [">x", True], [">b", False]]
    assert html_text.slots_of(merged) == {"b p", "b x"}


def test_wrappers_of_many_expressions_merge_in_groups(spark, monkeypatch):
    monkeypatch.setattr(html_text, "MERGE", 2)
    rows = [(k, "http://a/", "<body>" + "".join(f"<h{1 + (k >> b & 1)}>t{b}</h{1 + (k >> b & 1)}>" for b in range(3)) + "<p>x") for k in range(8)]
    wrappers = html_text.wrappers_of(html_text.folded_pages(pages(spark, rows))).collect()
    assert len(wrappers) == 1


def test_warc_matches_brute_force(spark):
    rng = random.Random(2)
    bodies = [f"<p>{k}é</p>\r\n\r\nWARC/1.1\r\n" * rng.randint(0, 3) for k in range(20)] + [None, "", "x" * 400_000]
    rows = [(k, f"http://www.h{k % 3}.example/a?b={k % 4}#x", rng.choice(bodies)) for k in range(120)]
    got = warc.archive(pages(spark, rows)).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} \
        == brute.warc_rows([(i, h) for i, _, h in rows])
    by = {}
    for r in sorted(got, key=lambda r: (r.url_key, r.capture_no)):
        by.setdefault(r.url_key, []).append((r.capture_no, r.page_id))
    assert all([n for n, _ in v] == list(range(1, len(v) + 1)) and [i for _, i in v] == sorted(i for _, i in v) for v in by.values())


def test_warc_of_nulls_repeats_and_nothing(spark):
    rows = [(None, None, "same"), (3, "u\r\nv", "same"), (3, "u", "same"), (4, "u", "same"), (None, None, "alone"), (None, "u", "alone"), (5, None, None)]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.archive(pages(spark, rows)).collect())
    assert got == sorted([(0, "revisit", 3), (3, "response", 0), (3, "response", 0), (4, "revisit", 3), (0, "response", 0), (0, "response", 0), (5, "response", 0)])
    assert warc.archive(pages(spark, [])).count() == 0
    small = warc.archive(pages(spark, [(1, "u", "ab"), (2, "u", "ab")]), min_bytes=3).collect()
    assert {r.record_type for r in small} == {"response"}


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 5, 8])
def test_loser_tree_merges(runs):
    rng = random.Random(runs)
    data = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(runs)]
    assert list(warc.LoserTree(data, lambda x: x)) == sorted(x for run in data for x in run)


VECTORS = "vec_id long, embedding array<float>, label int, v string, rank int, score long"


def vectors(spark, rows):
    return topk_search.integer_vectors(spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], VECTORS))


def _search(spark, rows, **kw):
    vs = vectors(spark, rows)
    out = {}
    for r in sorted(topk_search.top_k(vs, vs.filter("vec_id % 100 = 0"), **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard,block", [(4096, 1024), (50, 2), (7, 1)])
def test_top_k_matches_brute_force(spark, shard, block):
    rng = np.random.default_rng(4)
    data = rng.normal(0, 0.2, (400, 12))
    data[200:300] = data[7]                                     # a hot vector, ties
    data[300:320] = 0
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    assert _search(spark, rows, shard=shard, query_block=block) == brute.top_k({i: [np.float32(x) for x in v] for i, v in rows})


def test_top_k_leaves_out_what_takes_no_part(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [9.0, 9.0]),
            (5, [1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (100, None), (0, [1.0, 0.5]), (7, [0.5, 0.25, 8.0]), (8, [])]
    assert _search(spark, rows) == {0: [(6, 1572864), (6, 1572864), (5, 1048576), (7, 655360), (8, 0)]}
    assert _search(spark, []) == {} and _search(spark, [(0, [1.0])]) == {}


def test_top_k_meets_blocks_without_the_driver(spark):
    """Blocks of queries were copied to every shard and broadcast for it."""
    rng = np.random.default_rng(5)
    vs = vectors(spark, [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (600, 6)))])
    found = topk_search.top_k(vs, vs.filter("vec_id % 100 = 0"), shard=20, query_block=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and "values" not in plan
    assert found.count() == 60


def test_nra_with_scores_known_from_other_shards():
    rng = np.random.default_rng(6)
    for n, scale in ((300, 9), (300, 1 << 40), (8, 9)):
        values, queries = rng.integers(-scale, scale, (n, 5)), rng.integers(-scale, scale, (12, 5))
        values[:40] = values[0]
        ids, order = np.arange(n), np.argsort(values, axis=0, kind="stable").astype(np.int32)
        q_ids = np.arange(-12, 0)
        whole = {(q, i): s for q, i, s in topk_search.nra(q_ids, queries, ids, values, order)}
        known = [sorted(s for (q, _), s in whole.items() if q == query)[-3] if query % 2 else None for query in q_ids]
        some = {(q, i): s for q, i, s in topk_search.nra(q_ids, queries, ids, values, order, few=0, known=known)}
        assert some.items() <= whole.items()
        assert all((q, i) in some for (q, i), s in whole.items() if known[q + 12] is None or s >= known[q + 12])


def test_top_k_of_large_numbers_stays_exact(spark):
    rows = [(0, [2.0e6, 1.0])] + [(k, [2.0e6, float(k)]) for k in range(1, 40)]
    got = _search(spark, rows)[0]
    assert [i for i, _ in got] == list(range(39, 29, -1)) and got[0][1] == (2_000_000 * 1024) ** 2 + 1024 * 39 * 1024
