import random

import numpy as np
import pytest

from linewright.llm import html_extract
from linewright.llm.html_extract import candidates, extract_text, page_blocks, repeated_runs

SCHEMA = "page_id long, url string, html string, text string, host string, level string, open int"


def run(spark, rows, **kw):
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_text(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **kw).collect()}


def test_marked_articles(spark):
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></li></ul></nav><!-- no <p>no</p> --><div class="ad box">Buy</div>
    <div id="cookie-notice">We use cookies</div><article><h1>A &amp; B &eacute;&nbsp;x &am</h1><p><b>one
      two<br><p>three <i>four</i>&lt;p&gt;</p><div class="share">Share</div><ul><li>five</li><li>six</ul><aside>Side</aside>
      <form><input>Sign up</form><p hidden>secret</p><table><tr><td>c1</td><td>c2</td></tr></table><section id="comments"><p>Reader says</p></section></article>
    <footer>&copy; end</footer></body>"""
    want = "A & B é x &am\none two\nthree four<p>\nfive\nsix\nc1\nc2"
    rows = [(1, "http://a.b/", page, "", ""), (2, None, None, "", ""), (3, "u", "", "", ""), (None, "u", page, "", ""), (5, "u", "<main><p>m</p></main><p>out</p>", "", ""), (6, "u", "a < b <b>c</b> <", "", ""), (7, "u", "<p>x<!-- never closed", "", ""), (8, "u", "<article>" + "w " * 50000 + "</article>", "", "")]
    got = run(spark, rows + rows[:1])
    assert got[1] == got[None] == (want, len(want))
    assert [got[k][0] for k in (2, 3, 5, 6, 7)] == ["", "", "m", "a < b c <", "x"]
    assert got[8][1] == 99999


def test_repeated_runs_of_a_host_go(spark):
    rng = random.Random(3)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    template = "welcome to our site please enjoy your long stay here"
    bodies = [own(30) for _ in range(12)]
    rows = [(k, "http://h.x/p", f"<div>{template} {b}</div><div>{template}</div>", "", "") for k, b in enumerate(bodies)]
    rows += [(100, "http://other.x/", f"<div>{template} alone</div>", "", ""), (101, "http://copy.x/", f"<p>{bodies[0]}</p>", "", ""), (102, "http://copy.x/2", f"<p>{bodies[0]}</p>", "", "")]
    got = run(spark, [tuple(r) for r in rows])
    assert [got[k][0] for k in range(12)] == bodies
    assert got[100][0] == template + " alone" and got[101][0] == got[102][0] == bodies[0]


def brute_runs(streams, least, min_run):
    """Maximal runs on ``least`` pages, by counting every run of every length."""
    pages = {}
    for p, x in enumerate(streams):
        for a in range(len(x)):
            for b in range(a + min_run, len(x) + 1):
                pages.setdefault(tuple(x[a:b].tolist()), set()).add(p)
    frequent = {r for r, on in pages.items() if len(on) >= least}
    longest = set()
    for x in streams:
        x, before = tuple(x.tolist()), 0
        for a in range(len(x)):
            size = max((n for n in range(min_run, len(x) - a + 1) if x[a : a + n] in frequent), default=0)
            if size and size != before - 1:
                longest.add(x[a : a + size])
            before = size
    return longest


@pytest.mark.parametrize("seed", range(25))
def test_runs_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    streams = [rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint64) for _ in range(rng.integers(1, 7))]
    template = rng.integers(0, 3, 21).astype(np.uint64)
    streams = [np.concatenate([x, template[rng.integers(0, 5) :], x[:5]]) if rng.random() < 0.7 else x for x in streams]
    for least, min_run in ((2, 3), (3, 4), (2, 8), (4, 5)):
        got = [tuple(streams[p][a : a + n].tolist()) for p, a, n in repeated_runs(streams, least, min_run)]
        assert len(got) == len(set(got)) and set(got) == brute_runs(streams, least, min_run)


WORDS = "welcome to our site please enjoy your long stay here"


def bodies_of(n, size=40, seed=3):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(size)) for _ in range(n)]


@pytest.mark.parametrize("part_pages", [1000, 5])
def test_the_array_alone_removes_boilerplate_inside_articles(spark, part_pages):
    bodies = bodies_of(14)
    rows = [(k, "http://h.x/p", f"<article><p>{WORDS}</p><p>{b}</p><div class='zzz'>{WORDS} again</div></article>", "", "") for k, b in enumerate(bodies)]
    rows += [(50, "http://h.x/p", rows[0][2], "", ""), (60, None, rows[1][2], "", "")]
    got = run(spark, rows, part_pages=part_pages)
    assert [got[k][0] for k in range(14)] == bodies and got[50] == got[0]
    assert got[60][0] == f"{WORDS}\n{bodies[1]}\n{WORDS} again"


def test_copies_and_quoted_passages_stay(spark):
    bodies = bodies_of(12, 60)
    near = [b for b in bodies[:1] for b in (b, b + " changed", "other " + b)]
    quote = " ".join(f"q{k}" for k in range(55))
    quoting = [f"{bodies[k]} {quote} {bodies[k + 3]}" for k in (1, 2)]
    own = near + quoting + bodies[6:]
    for mark in ("<article><p>{}</p></article>", "<div>{}</div>"):
        got = run(spark, [(k, "http://n.x/", mark.format(b), "", "") for k, b in enumerate(own)])
        assert [got[k][0] for k in range(len(own))] == own


def test_wrappers_do_not_eat_articles():
    real = lambda html: candidates(html)[1]
    assert real('<div class="content-with-sidebar"><article><p>Real article</p></article></div>') == ["Real article"]
    assert real('<div class="layout has-sidebar"><p>page</p></div>') == ["page"]
    assert real('<article><p>some <b class="alert">note</b> inside</p></article>') == ["some note inside"]
    assert real('<article><div class="related-work">kept</div></article>') == ["kept"]
    assert real('<div class="sidebar"><article>only here</article></div>') == ["only here"]
    assert real('<div class="sidebar"><article>teaser</article></div><article>text</article>') == ["text"]
    assert real('<article>text</article><section class="comments"><article>reader</article></section>') == ["text"]
    assert real('<article>a<div class="share-buttons">Share</div><div id="cookie-notice">c</div></article>') == ["a"]
    assert real("<nav><article>menu</article></nav>out") == ["out"]


def test_odd_markup():
    assert page_blocks("<p>a</p></p></div>b") == [(0, "a"), (0, "b")]
    assert page_blocks("<script>x<p>y") == [] and page_blocks("<") == [(0, "<")]
    assert page_blocks("<" * 20000)[0][1] == "<" * 20000


def test_empty(spark):
    assert run(spark, []) == {}


def test_pages_stay_where_they_are_for_few_templates(spark, monkeypatch):
    """Few templates go to the pages without a shuffle of these; many are joined by host, with the same texts."""
    menu = " ".join(f"menu{k}" for k in range(12))
    rows = [(k, f"http://h{k % 3}.org/{k}", f"<body><p>{menu}</p><p>{' '.join(f'w{k}x{j}' for j in range(200))}</p></body>") for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = html_extract.extract_text(pages)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        few = {r["page_id"]: r["text"] for r in out.collect()}
        monkeypatch.setattr(html_extract, "FEW_RUNS", 0)
        many = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert few == many and len(few) == 30 and not any("menu" in t for t in few.values())


def test_pages_are_shuffled_once_for_the_arrays(spark, monkeypatch):
    """Hosts of one part and of several: no join shuffles the pages by host before they are dealt, and all parts find the same."""
    plans, keep = [], html_extract.stored

    def noted(df, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, **kw)

    monkeypatch.setattr(html_extract, "stored", noted)
    menu = [" ".join(f"menu{k}of{h}" for k in range(12)) for h in range(4)]
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(k, f"http://h{h}.org/{k}", f"<body><p>{menu[h]}</p><p>{own(k)}</p></body>", "", "") for k, h in enumerate([0] * 40 + [1] * 9 + [2] * 3 + [3] * 2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [run(spark, rows, part_pages=size) for size in (400, 10)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in plans if "\n+- MapInArrow runs(" in x]
    assert len(dealt) == 2 and not any("SortMergeJoin" in x or "ShuffledHashJoin" in x for x in dealt)
    assert got[0] == got[1] and all(got[0][k][0] == (own(k) if k < 52 else f"{menu[3]}\n{own(k)}") for k in range(54))
