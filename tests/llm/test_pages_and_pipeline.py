"""HTML extraction, the pipeline's stages, and the registered queries."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _dom, decontamination, html_text, queries, simhash

from .conftest import DOCS, ODD

PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='x'><header><h1>Site</h1></header>"
        "<nav><ul><li><a href=/a>A</a></ul></nav><div class='cookie-notice'>We use cookies</div><main><article><header><h2>Head &amp; line</h2></header>"
        "<p>One <b>bold<br>text</p><p>Two\n\n  three<p>Four &lt;x&gt;<form><input><button>Go</button></form><div class=ad>Buy</div><!-- no --><ul><li>a<li>b</ul>"
        "<section id=comments><p>First!</p></section></article></main><aside>Side</aside><footer>&copy;</footer>")


def test_blocks_of_a_page():
    assert html_text.main_text(PAGE).split("\n\n") == ["Head & line", "One bold text", "Two three", "Four <x>", "a", "b"]


def test_names_of_wrappers_and_parts():
    page = ("<body><div class='content-sidebar-wrap'><div id=topnav>Menu</div><article class=post><h1>T</h1><p>Story</p><div class=adsbygoogle>Buy</div></article>"
            "<div class='sidebar widget'>Side</div></div><section class=comments><article><p>Nice!</p></article></section><div class=sitefooter>End</div>")
    assert html_text.main_text(page) == "T\n\nStory"
    plain = "<div class=site-header>Site</div><div id=content><h2>Head</h2>Text one<br>two<table><tr><td>cell</td></tr></table></div><div class='cookie-banner'>OK?</div>"
    assert html_text.main_text(plain) == "Head\n\nText one two\n\ncell"


@pytest.mark.parametrize("text", [None, "", "<", "<p", "plain", "<div>" * 5000 + "deep" + "</div>" * 10, "<script>x", "</p></b>a", "<p>x<!-- never closed", "&#0; &bogus; a"])
def test_malformed_pages_are_read(text):
    got = html_text.main_text(text)
    assert got == {None: "", "plain": "plain"}.get(text, got)
    if text and "deep" in text:
        assert got == "deep"


def test_elements_below_the_depth_bound_close_themselves():
    page = "<body><div><article><p>One</p>" + "<div>" * 160 + "deep<nav><ul><li>Menu</li></ul></nav>" + "</div>" * 160 + "<p>Two</p></article></div></body>"
    got = html_text.main_text(page)
    assert "One" in got and "deep" in got and got.endswith("Two") and "Menu" not in got


def test_matching_is_the_largest():
    a, b = _dom.skeleton_tree("a(b(c()),d(),b())"), _dom.skeleton_tree("a(b(),x(),d(),b(c()))")
    pairs = _dom.match(a, b)
    assert pairs[0] == 0 and len(pairs) == 4 and _dom.match(a, _dom.skeleton_tree("z()")) == {}


def test_template_of_a_host_goes(table):
    def page(k):
        return f"<body><div class=top>Welcome to the site</div><div class=text><h1>Title {k}</h1><p>Body {k} of the story.</p></div><div class=end>All rights</div></body>"

    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(6)] + [(90, "http://one.org/x", page(1)), (91, None, page(2)), (92, "http://h.org/n", None)]
    rows += [(100 + k, f"http://copy.org/{k}", page(7)) for k in range(5)]
    got = {r.page_id: r for r in html_text.extract(table(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Title 3\n\nBody 3 of the story." and got[92].text == "" and got[92].n_chars == 0
    assert got[90].text.startswith("Welcome") and got[101].text.endswith("All rights") and len(got) == len(rows)
    assert got[3].n_chars == len(got[3].text)


def test_copies_are_no_template(table):
    """A block that only copies of one page hold stays in their text."""
    def page(k, more=""):
        return f"<body><div class=text><h1>Title {k}</h1><p>Body {k} of the story.</p>{more}</div></body>"

    rows = [(k, f"http://h.org/{k}", page(9, "<blockquote>Quoted</blockquote>")) for k in range(5)] + [(10 + k, f"http://h.org/o{k}", page(k)) for k in range(4)]
    got = {r.page_id: r.text for r in html_text.extract(table(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "Title 9\n\nBody 9 of the story.\n\nQuoted" for k in range(5)) and got[12] == "Title 2\n\nBody 2 of the story."


def soup(k):
    """A page without an article, a heading or a telling name: only comparison finds its text."""
    words = " ".join(f"w{k}x{j}" for j in range(60))
    return (f"<body><div class=a1><ul><li>go {k}</li><li>to {k + 1}</li></ul></div><div class=a2><div class=b><p>start {k} {words}</p><blockquote>said {k}</blockquote>"
            f"<p>end {words}</p></div></div><div class=a3><div>seen {k * 7} times</div><p>tail {k}</p></div><div class=a4>Always here</div></body>")


def test_region_comes_from_the_wrapper(table):
    pages = {k: soup(k) for k in range(12)}
    got = {r.page_id: r.text for r in html_text.extract(table([(k, f"http://soup.org/{k}", p) for k, p in pages.items()], "page_id long, url string, html string")).collect()}
    for k, p in pages.items():
        assert got[k].split("\n\n")[0].startswith(f"start {k} ") and got[k].split("\n\n")[1] == f"said {k}" and len(got[k].split("\n\n")) == 3
        assert html_text.main_text(p) != got[k]  # without the wrapper, menus and tails would be text


def test_edited_copies_are_one_story(table):
    """Pages of one heading must not make that heading look like template."""
    def page(k):
        return f"<body><div class=text><h1>One title</h1><p>The body, edited {k} times.</p><p>Second</p></div></body>"

    got = html_text.extract(table([(k, f"http://c.org/{k}", page(k)) for k in range(6)], "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"One title\n\nThe body, edited {k} times.\n\nSecond" for k in range(6)}


def test_formulas_and_inner_names():
    page = ("<article><p>Let <math><mi>x</mi><annotation>\\x</annotation></math> be <svg><title>no</title><text>five</text></svg></p><div class=related-work>Kept</div>"
            "<div class=search>Kept too</div><div class=cookie-notice>Gone</div></article>")
    assert html_text.main_text(page) == "Let x be five\n\nKept\n\nKept too"


def test_tree_matching_equals_enumeration():
    rng = random.Random(4)

    def tree(depth):
        return (rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])

    def sig(t):
        return f"{t[0]}({','.join(map(sig, t[1]))})"

    def largest(x, y):
        """Most pairs of an order-keeping match, tried over every way to skip children."""
        if x[0] != y[0]:
            return 0

        def rows(p, q):
            if not p or not q:
                return 0
            return max(rows(p[1:], q), rows(p, q[1:]), largest(p[0], q[0]) + rows(p[1:], q[1:]))

        return 1 + rows(x[1], y[1])

    for _ in range(300):
        x, y = tree(3), tree(3)
        assert len(_dom.match(_dom.skeleton_tree(sig(x)), _dom.skeleton_tree(sig(y)))) == largest(x, y)


def test_pages_with_clashing_columns_and_long_text(table):
    long = "word " * 200_000
    rows = [(1, "http://l.org/1", f"<article><p>{long}</p></article>", "x", "y", "z"), (None, None, None, None, None, None), (2, "http://l.org/2", "", "x", "y", "z")]
    got = {r.page_id: r for r in html_text.extract(table(rows, "page_id long, url string, html string, host string, text string, wrapper string")).collect()}
    assert got[1].text == long.strip() and got[1].n_chars == 999_999 and got[None].text == "" and got[2].n_chars == 0


def test_no_pages(table):
    assert html_text.extract(table([], "page_id long, url string, html string")).count() == 0


def test_stages_take_effect(spark, table):
    """Junk, copies and benchmark passages go; clean documents stay until the mix."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.written(corpus_pipeline.drop_low_quality(spark, docs, sf), "t")
    judged = kept.join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert judged > 0.98 and kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.98 * labels.where("quality = 1").count()
    unique = corpus_pipeline.written(corpus_pipeline.drop_near_duplicates(spark, kept, sf), "t")
    parts = simhash.near_copies(kept)
    assert unique.count() == parts.select("component").distinct().count()
    assert {r.doc_id for r in unique.collect()} == {r.m for r in parts.groupBy("component").agg(F.min("doc_id").alias("m")).collect()}
    clean = corpus_pipeline.written(corpus_pipeline.drop_contaminated(spark, unique, sf), "t")
    dirty = decontamination.contamination(unique, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count()
    assert clean.count() == unique.count() - dirty and dirty > 0
    mixed = corpus_pipeline.written(corpus_pipeline.mix_sources(spark, clean, sf), "t")
    most = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 2 and mixed.columns == docs.columns
    last = corpus_pipeline.deal_shards(spark, mixed, sf)
    assert last.count() == mixed.count() and last.select("shard", "slot").distinct().count() == mixed.count()


def test_pipeline_of_odd_rows(spark, tmp_path, table, labels):
    for name, rows in (("odd", ODD), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "le chat noir dort sur la chaise près du feu")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        assert all(r.doc_id != 7 for r in got) and (rows or not got)


@pytest.mark.parametrize("name", sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])))
def test_queries_return_all_rows(spark, name):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, sf)
    n = got.count()
    if name.startswith("op5"):
        assert n == 50
    else:
        assert n == spark.read.parquet(f"{sf}/{'pages' if name.startswith('op10') else 'documents'}.parquet").count()
