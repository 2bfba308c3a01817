import time

import numpy as np
import pytest

from cloakframe.llm import crf
from cloakframe.llm import html_extract as he


@pytest.fixture(scope="module")
def model():
    return he.train(400)


def test_blocks():
    html = """<html><head><title>no</title><script>var a="<p>x</p>"</script></head><body><div>before<p>one <b>two</b>
      three&amp;&nbsp;four<br>five<p>six<ul><li>a<li>b <a href=x>link</a></ul></div>tail<!-- <p>gone</p> --></body>"""
    assert [t for _, t, _ in he.blocks(html)] == ["before", "one two three& four five", "six", "a", "b link", "tail"]
    assert he.blocks(html)[4][2] == len("link")
    own, names = he.blocks(html)[3][0]
    assert own == "li" and names == {"in=html", "in=body", "in=div", "in=ul", "in=li"}
    for broken in ("", "<", "<p", "</p></div>", "&#xZZ;", "<p>a<table><tr><td>b<td>c</table>d", "<![CDATA[x]]>", "<style>p{", "<!--"):
        he.blocks(broken)


def test_held_out_accuracy(model):
    right = total = 0
    for html, labels in he.labelled_pages(150, seed=5):
        found = he.blocks(html)
        scores = np.array([model.bias + sum(model.weights.get(f, 0.0) for f in fs) for fs in he.features(found)])
        y = crf.decode(scores[:, None], np.array([len(scores)]), model.chain)[:, 0]
        right += int((y == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.98


PAGE = """<!DOCTYPE html><html><head><title>Storm</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site. <button>OK</button></div><form action="/s"><input name="q"><button>Search</button></form>
<article><h1>Storm over the coast</h1><p>The storm came in the night. It took many roofs &amp; trees.<p>Nobody was hurt, the mayor said in the morning.</p>
<div class="advert">Buy new roofs here today!</div><p>Work on the roads begins today.</p></article>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I was there and saw it all. It was bad.</p></div></div>
<footer>&copy; The Paper</footer></body></html>"""


def test_a_page(spark, model):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<nav><a href=x>Home</a></nav>"), (3, "w", "<nav><a href=x>Home</a></nav>")], "page_id long, url string, html string").selectExpr("*", "1 text", "2 n_chars")
    got = he.extract(df, model).collect()
    assert len(got) == 5
    main = next(r for r in got if r.page_id == 1)
    assert main.text == "Storm over the coast\n\nThe storm came in the night. It took many roofs & trees.\n\nNobody was hurt, the mayor said in the morning.\n\nWork on the roads begins today."
    assert all(r.n_chars == len(r.text) for r in got) and all(r.text == "" for r in got if r.page_id is None or r.page_id > 1)
    assert he.extract(df.limit(0), model).collect() == []


ODD = ["<![foo[x]]>", "<![ x]>", "<![foo x", "<![CDATA[a]]>", "<![", "<!", "<!x", "<!--", "<!-->", "<!--->", "<!-- a --!>", "<!DOCTYPE", "<![endif]>", "<?", "<? a", "</", "</ a", "</>", "<a b='", '<a b="x>', "<p/", "&#xffffffff;", "&#55296;", "&#", "<script>", "</p></div>", "</unknown>"]


@pytest.mark.parametrize("odd", ODD)
def test_odd_markup_never_fails(odd):
    assert [t for _, t, _ in he.blocks(f"<p>before</p>{odd}")][0] == "before"
    after = [t for _, t, _ in he.blocks(f"<p>before</p>{odd}<p>after</p>")]
    # an open comment or script holds the rest of the page, as in browsers
    assert after[0] == "before" and (after[-1] == "after" or odd in ("<!--", "<script>"))


@pytest.mark.parametrize(
    "page, n",
    [("<div>a" * 100_000, 100_000), ("<a " * 100_000, 0), ("<li><ul>" + "<span>" * 50_000 + "<li></li>" * 50_000, 0), ("<div>" * 50_000 + "</x>" * 50_000 + "z", 1), ("<p>x<!>" * 50_000, 50_000), ("<a b='" * 100_001, 0)],
)
def test_deep_and_broken_pages_are_linear(page, n):
    began = time.time()
    found = he.blocks(page)
    assert time.time() - began < 8 and len(found) == n


def test_all_ancestors_count_however_far_out():
    own, names = he.blocks("<article class='post x'><section>" + "<b>" * 300 + "x")[0][0]
    assert own == "section" and names == {"in=article", "w=post", "w=x", "in=section", "in=b"}
    assert he.blocks("<article class='post x'><b>y", {"in=article", "w=post"})[0][0][1] == {"in=article", "w=post"}
    # words without a weight are not gathered on the way inwards
    began = time.time()
    assert len(he.blocks("".join(f"<div class='{'abcdefghij'[k % 10] * (k % 500)}'>z" for k in range(50_000)), {"in=div"})) == 50_000
    assert time.time() - began < 8


PARAGRAPHS = ["The river rose by two metres in one night.", "Most houses near the bridge were empty by then.", "The council will meet again on Tuesday to talk about a new wall.", "Nobody knows yet what it will cost.", "Volunteers carried sand until the morning came."]


@pytest.mark.parametrize("deep", [0, 5, 11, 15, 30, 80])
def test_deep_layouts(model, deep):
    o, c = "<div>" * deep, "</div>" * deep
    nav = f'<nav>{o}<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul>{c}</nav>'
    aside = f'<aside class="sidebar">{o}<h3>Most read</h3><p><a href="/1">Council votes on bridge</a></p><p>Send us your own pictures of the river today.</p>{c}</aside>'
    article = f"<article>{o}" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + f"{c}</article>"
    page = f'<html><body>{nav}{article}{aside}<footer>{o}<p>&copy; River Post. All rights reserved.</p>{c}</footer></body></html>'
    assert he.main_text([page], model)[0].split("\n\n") == PARAGRAPHS


# Pages written by hand, main blocks marked by a star.
BY_HAND = [
    """<html><body><div id="top"><a href="/">Harbour Times</a> <a href="/x">Sport</a> <a href="/y">Money</a></div><div class="content"><h1>*Ferry fares rise in spring</h1><p>*The harbour board has agreed to raise all fares by a tenth.</p>
    <p>*It says that fuel costs have doubled since last year, and that no route will close.</p><h2>*What it means</h2><ul><li>*A day ticket will cost six crowns.</li><li>*Children under ten travel free.</li></ul></div>
    <div class="sidebar"><h3>Most read</h3><p><a href="/1">Council votes on bridge</a></p><p><a href="/2">Rain until Monday</a></p></div><div id="footer">Copyright 2021 Harbour Times. All rights reserved.</div></body></html>""",
    """<body><header><h2>Old Mill Kitchen</h2><nav><a href=1>Recipes</a><a href=2>About</a></nav></header><main><article><h1>*Barley soup</h1><p>*Soak the barley overnight. Drain it and rinse it well.</p><aside class="ad">Try our new pans, now half price!</aside>
    <p>*Fry the onions until they are soft, then add the stock.</p><blockquote>*My grandmother always added a bay leaf.</blockquote></article></main><section class="comments"><h3>3 comments</h3><div><p>Anna</p><p>Lovely soup, we had it twice this week.</p></div></section>
    <form><label>Newsletter</label><input name=e><button>Sign up</button></form><footer><p>Imprint</p></footer></body>""",
    """<body><div class="cookie-banner"><p>We use cookies to improve your visit. <button>Accept</button></p></div><table><tr><td class="menu"><ul><li><a href=a>Start</a></li><li><a href=b>Archive</a></li></ul></td><td><h1>*Notes on lichens</h1><p>*Lichens grow slowly, some by less than a millimetre in a year.
    <p>*They are a partnership of a fungus and an alga.<p>*Walls of old churches carry specimens of great age.</td></tr></table><p class="copyright">&copy; Field Club</p></body>""",
]


def test_pages_written_by_hand(model):
    right = total = 0
    for page in BY_HAND:
        want = [t.startswith("*") for _, t, _ in he.blocks(page)]
        plain = page.replace("*", "")
        text = he.main_text([plain], model)[0].split("\n\n")
        got = [t in text for _, t, _ in he.blocks(plain)]
        right += sum(a == b for a, b in zip(got, want, strict=True))
        total += len(want)
    assert right / total >= 0.95


def test_clashing_columns(spark, model):
    df = spark.createDataFrame([(1, "u", "<p>x", "y", 3, 4)], "page_id long, url string, html string, text string, n_chars long, `page id` long")
    assert he.extract(df, model).columns == ["page_id", "url", "text", "n_chars"]


def test_very_long_page(model):
    html = "<body><article>" + "<p>Many words stand here, one after the other.</p>" * 20_000 + "</article><footer>&copy; x</footer>"
    assert he.main_text([html], model)[0].count("\n\n") == 19_999
