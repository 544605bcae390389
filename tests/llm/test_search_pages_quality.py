"""Vector search, page extraction and the quality classifier."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import documents, edge_rows, prose, same_rows
from zonepulse.llm import html_extract, quality, vector_search

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label string, row_id string, cell string, vec string, rank string"


def vector_rows():
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # copies of one vector
    rows += [rows[7], rows[7], (50, rows[9][1]), (None, rows[2][1]), (2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8)]
    rows += [(2150, [float("inf")] + [0.0] * 7), (2200, []), (2250, [1.0, -2.0]), (2300, [0.5] * 11), (2350, [0.0] * 8)]
    return rows


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * 5) for i, v in rows], VECTORS)


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 16, "block_queries": 1, "n_pivots": 7}, {"n_pivots": 1, "k": 600}])
def test_top_k(spark, options):
    rows = vector_rows()
    found = vector_search.top_k(vectors(spark, rows), **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    same_rows(found.collect(), brute.top_k(rows, options.get("k", 5), 50))


def test_top_k_of_large_components(spark):
    rows = [(i, [float(10**5 * (i + 1)), -3.5 * i]) for i in range(60)]
    same_rows(vector_search.top_k(vectors(spark, rows)).collect(), brute.top_k(rows, 5, 50))


def test_top_k_of_a_cell_larger_than_a_batch(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=3).astype(np.float32)]) for i in range(2600)]
    found = vector_search.top_k(vectors(spark, rows), n_pivots=1, chunk_rows=10_000, query_every=500)
    same_rows(found.collect(), brute.top_k(rows, 5, 500))


def test_top_k_of_no_rows(spark):
    for rows in ([], [(50, None)], [(50, [1.0])]):
        assert vector_search.top_k(vectors(spark, rows)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x}</style><script>var a = "</p><p>no</p>";</script></head><body class="with-sidebar">
<header><h1>Site</h1><p>Slogan of the site.</p></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, really, all the time.</p></div>
%s
<aside><p>Related, maybe longer than the text, with commas, and more of them, and more.</p></aside>
<form><label>Mail</label><input><button>Go</button></form>
<div class="ad">Buy this, now, today!</div>
<footer>&copy; us</footer></body></html>"""

BODIES = [
    (
        "<article><h1>The &amp; title</h1><p>First  <b>bold</b>\n text, with marks; enough of them.</p><p>Short</p><ul><li>item</li></ul><p>A&nbsp;&lt;b&gt;&#x41;</p></article>"
        '<div id="comments"><p>Nice text, thank you, really, a lot of praise here, more than the text has itself.</p></div>',
        "The & title\nFirst bold text, with marks; enough of them.\nShort\nitem\nA <b>A",
    ),
    (
        '<div class="content"><h2>Heading</h2><p>Unclosed <b>paragraph one, with marks.<br><p>Paragraph two, with more of them; yes.<p>Three.</div><div><a href="x">link one</a> <a href="y">link two</a></div>',
        "Heading\nUnclosed paragraph one, with marks.\nParagraph two, with more of them; yes.\nThree.",
    ),
    ("<main><header><h1>Inside</h1></header><p>Text, of the main part; with marks.</p></main>", "Inside\nText, of the main part; with marks."),
    (
        '<main><div class="post-header"><h1>Title</h1></div><p>Text, of some length; with marks.</p><div class="cookiebar"><p>Cookies, again, and again.</p></div>'
        '<section id="readerComments"><article class="comment"><p>A comment, longer than the text of the page, with marks; and more.</p></article></section></main>',
        "Title\nText, of some length; with marks.",
    ),
    (
        '<article><h1>Head</h1><p>Opening, of some length; with marks.</p><section id="discussion"><h2>Discussion</h2><p>What it means, at length; with marks.</p></section>'
        '<h2 id="related-work">Related work</h2><p>Others did it, too; with marks.</p><h2 id="search-methods">Search methods</h2><p class="menu">Soup, bread, and salt; a full menu.</p>'
        '<div class="legal-notice-law"><p>The law asks for a notice, in writing; always.</p></div><h2>Sources</h2><ul><li><a href="a">First source</a></li><li><a href="b">Second source</a></li></ul>'
        '<div class="notice"><p>Our terms changed, please read them, all of them.</p></div><div class="related-posts"><p>Another post, as long as this one; really.</p></div></article>',
        "Head\nOpening, of some length; with marks.\nDiscussion\nWhat it means, at length; with marks.\nRelated work\nOthers did it, too; with marks.\nSearch methods\n"
        "Soup, bread, and salt; a full menu.\nThe law asks for a notice, in writing; always.\nSources\nFirst source\nSecond source",
    ),
    (
        "<article><p>One, with marks; here. <button><div>Buy now!</div></button> Two.</p><p>Three, with marks. <noscript><div>No script</div></noscript></p><p>Four, yes. <svg><text>Label</text><p>x</p></svg></p>"
        '<p>Five, too. <object><p>Plug-in</p></object></p><p>Six, with marks; <span class="ad"><div>Cheap!</div></span> end.</p><select><option>Pick<p>one</select><p>Seven, at last.</p></article>',
        "One, with marks; here.\nTwo.\nThree, with marks.\nFour, yes.\nFive, too.\nSix, with marks;\nend.\nSeven, at last.",
    ),
    ("<article></article>", ""),
    ("<article><p>One</p></article>", "One"),
]

NAMES = [
    ("p", 'class="menu"', True), ("h2", 'id="comments-on-kant"', True), ("section", 'id="commentary"', True), ("section", 'id="recommendations"', True), ("div", 'class="related-work"', True),
    ("section", 'id="cookie-recipes"', True), ("div", 'class="notice"', False), ("div", 'class="site-notice notice--warning"', False), ("div", 'class="cookie-notice"', False), ("p", 'class="notice"', False),
    ("section", 'id="comments"', False), ("div", 'id="disqus_thread"', False), ("div", 'class="newsletter-signup"', False), ("div", 'class="ad"', False), ("div", 'class="comment-list"', False),
    ("div", 'role="navigation"', False), ("ul", 'class="tags"', False), ("div", 'class="related-links"', False),
]


@pytest.mark.parametrize(("tag", "names", "kept"), NAMES)
def test_names_inside_an_article(tag, names, kept):
    page = PAGE % f"<article><p>Before it, with marks; some.</p><{tag} {names}>Inside, of some length; with marks.</{tag}><p>After it, with marks; some.</p></article>"
    assert ("Inside" in html_extract.main_text(page)) == kept
    assert html_extract.main_text(page).replace("Inside, of some length; with marks.\n", "") == "Before it, with marks; some.\nAfter it, with marks; some."


def test_pages(spark):
    rows = [(n, f"http://x/{n}", PAGE % body) for n, (body, _) in enumerate(BODIES)]
    want = [(n, f"http://x/{n}", text, len(text)) for n, (_, text) in enumerate(BODIES)]
    odd = [(90, None, None), (91, "u", ""), (92, "u", "   "), (93, "u", "plain words, no tags at all"), (None, None, "<p>x</p>"), (94, "u", "<article><p>cut &am"), (95, "u", "<article><p>cut <b"), (96, "u", "<<>><p/></div>"), (97, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (98, "u", "<article><p>" + "long text, " * 50_000)]
    texts = ["", "", "", "plain words, no tags at all", "x", "cut &am", "cut", None, "deep", ("long text, " * 50_000).strip()]
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows + odd + rows[:1]], "page_id long, url string, html string, text string, n_chars string")
    found = html_extract.extract(frame).collect()
    assert len(found) == len(rows) + len(odd) + 1
    known = [(i, u, t, len(t)) for (i, u, _), t in zip(odd, texts, strict=True) if t is not None]
    same_rows([r for r in found if r["page_id"] != 96], want + known + want[:1])


def test_pages_of_an_empty_table(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_body_outside_of_article_cards():
    body = [f"Paragraph {n} of the body, with marks, and a good length; enough to tell it from cards." for n in range(4)]
    cards = "".join(f'<article class="card"><h3>Card {n}</h3><p>Short words</p></article>' for n in range(3))
    text = "".join(f"<p>{b}</p>" for b in body)
    for page in (f'<div class="story">{text}</div><section>{cards}</section>', f"<section>{cards}</section><div>{text}</div>", f"<div>{text}{cards}</div>"):
        assert html_extract.main_text(PAGE % page) == "\n".join(body)
    assert html_extract.main_text(PAGE % f"<article>{text}</article><div><p>Short words</p></div>") == "\n".join(body)


def test_path_scores_favour_text_over_links():
    blocks, _ = html_extract.read_blocks(PAGE % BODIES[0][0])
    scores = html_extract.path_scores(blocks)
    by_text = {b.text: scores[b.element.path] for b in blocks}
    assert by_text["One"] == 0 < by_text["First bold text, with marks; enough of them."]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")
def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"), most_labelled=150, most_pool=100)
    assert isinstance(model, quality.Model)
    scored = quality.classify(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    right, n = scored.agg(F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert right / n >= 0.97
    kept = quality.kept_documents(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality.classify(docs, model).where("kept").count()


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, text string")


def test_quality_of_edge_cases(spark, edge_docs, no_docs):
    n = len(edge_rows())
    for rows, share in (([], 1.0), ([(0, 1, 0), (1, 1, 0)], 1.0), ([(0, 0, 0)], 0.0), ([(None, 1, 0), (0, None, 0)], 1.0), ([(999, 0, 0)], 1.0)):
        found = quality.quality_scores(edge_docs, labelled(spark, rows))
        assert [(r["score"], r["kept"]) for r in found.collect()] == [(share, True)] * n
    labels = [(i, int(i % 3 > 0), 0) for i in range(25)] + [(0, 1, 0), (0, 1, 1), (4, None, None)]
    found = quality.quality_scores(edge_docs, labelled(spark, labels)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((i is None, i or 0) for i, _ in edge_rows())
    assert all(0 <= r[c] <= 1 for r in found for c in ("score_text", "score_meta", "score"))
    assert quality.quality_scores(no_docs, labelled(spark, labels)).collect() == []
    assert quality.kept_documents(no_docs, quality.train(edge_docs, labelled(spark, labels))).collect() == []


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = (rng.random(60) < 0.5).astype(float)
    truth = (rng.random(400) < 0.5).astype(float)
    view = lambda t, noise: np.stack([t + rng.normal(0, noise, len(t)), rng.normal(size=len(t))], 1).astype(np.float32)
    text, meta, pool_text, pool_meta = view(y, 0.1), view(y, 0.6), view(truth, 0.1), view(truth, 0.6)
    alone = quality.cotrain(text, meta, y, pool_text, pool_meta, 0, 50)
    taught = quality.cotrain(text, meta, y, pool_text, pool_meta, 3, 50)
    fresh = (rng.random(2000) < 0.5).astype(float)
    seen = view(fresh, 0.1), view(fresh, 0.6)
    right = lambda model, v: ((model.scores(*seen)[v] > 0.5) == (fresh > 0.5)).mean()
    assert right(taught, 1) >= right(alone, 1) - 0.02 and right(taught, 2) > 0.95
    assert [h[:2] for h in taught.handed] == [(n, v) for n in range(3) for v in ("text", "meta")]
    assert all(good > 0 and bad > 0 and weight > 0 for *_, good, bad, weight in taught.handed)


def test_a_view_that_knows_nothing_teaches_nothing_wrong():
    rng = np.random.default_rng(1)
    y, truth = (rng.random(300) < 0.8).astype(float), (rng.random(500) < 0.8).astype(float)
    view = lambda t: np.stack([t + rng.normal(0, 0.2, len(t)), rng.normal(size=len(t))], 1).astype(np.float32)
    noise = lambda t: rng.normal(size=(len(t), 3)).astype(np.float32)
    model = quality.cotrain(view(y), noise(y), y, view(truth), noise(truth), 3, 60)
    fresh = (rng.random(2000) < 0.8).astype(float)
    for v in (0, 2):
        assert ((model.scores(view(fresh), noise(fresh))[v] > 0.5) == (fresh > 0.5)).mean() > 0.95


def test_calibration_of_separated_margins():
    y = np.array([0.0] * 5 + [1.0] * 40)
    slope, shift = quality.platt(np.where(y > 0, 25.0, -25.0), y)
    p = quality.sigmoid(slope * np.array([-25.0, 25.0]) + shift)
    assert slope > 0 and p[0] < 0.3 and p[1] > 0.9
    slope, shift = quality.platt(np.tile([-3.0, 3.0], 50), np.tile([0.0, 1.0, 1.0, 1.0], 25))
    assert abs(quality.sigmoid(slope * -3.0 + shift) - 0.5) < 0.05


def test_text_features_see_the_worst_line():
    clean, junk = prose(1, 200), prose(1, 200) + "\n" + "BUY!! " * 12
    a, b = (quality.text_features(np.frombuffer(t.encode(), np.uint8)) for t in (clean, junk))
    assert np.isfinite(a).all() and np.isfinite(b).all()
    worst = quality.N_KINDS**3 + quality.LINE_FEATURES + 2
    assert b[worst] > a[worst] + 0.5


def test_one_document_frames(spark):
    assert documents(spark, [(1, "x")]).count() == 1
