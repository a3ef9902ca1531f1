"""Main-text extraction on pages written by hand, unlike those the model is trained on, and on broken or hostile markup."""

import time

import pytest

from recordgauge.llm import html_text

#: (page, what must be there, what must not).
PAGES = {
    "blog": (
        """<html><head><title>Sourdough - Anna bakes</title></head><body class="single single-post">
<div id="masthead" class="site-header"><a href="/">Anna bakes</a><p>Bread and other stories</p></div>
<div id="menu"><a href="/">Home</a> <a href="/about">About</a> <a href="/shop">Shop</a></div>
<div id="content"><div class="post hentry"><h2 class="entry-title">A loaf for the weekend</h2>
<div class="entry-content"><p>Mix the flour and the water the evening before, then let it rest.</p>
<p>In the morning add the <em>starter</em> and a pinch of salt. Fold it four times, every half hour.</p>
<ul><li>500 g of flour</li><li>350 g of water</li><li>10 g of salt</li></ul>
<p>Bake it hot until the crust sings.</p></div>
<div class="sharedaddy share-box"><a href="#">Tweet</a> <a href="#">Pin it</a></div></div>
<div id="comments" class="comments-area"><h3>2 responses</h3><ol><li class="comment"><p>Mine came out flat, what went wrong?</p></li><li class="comment"><p>Lovely crumb!</p></li></ol></div></div>
<div id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">Rye crackers</a></li><li><a href="/2">Apple cake</a></li></ul></div>
<div id="colophon">Copyright Anna 2019. Powered by flour.</div></body></html>""",
        ["A loaf for the weekend", "Mix the flour and the water", "the starter and a pinch", "350 g of water", "Bake it hot until the crust sings."],
        ["Home", "Tweet", "Mine came out flat", "Rye crackers", "Powered by", "Bread and other stories"],
    ),
    "news": (
        """<!doctype html><html><body><header role="banner"><a href="/">The Harbour Post</a><nav aria-label="menu"><ul><li><a href="/w">World</a><li><a href="/l">Local</a></ul></nav></header>
<div class="cookie-consent"><p>We use cookies to improve your visit.</p><button>Accept all</button></div>
<main><article><h1>Ferry link to reopen in spring</h1><p>The council voted on Tuesday to reopen the ferry between the two towns, after eleven years.</p>
<aside class="related"><h4>Read also</h4><ul><li><a href="/x">Bridge works delayed</a></li></ul></aside>
<p>Fares will be set in January, said the mayor. &ldquo;It&#39;s about time,&rdquo; said one passenger.</p>
<figure><img src="f.jpg" alt="ferry"><figcaption>The old ferry in 2009.</figcaption></figure>
<div class="ad-slot advert">Buy a boat today, half price!</div>
<p>The first boat is due on the first of April.</p></article></main>
<footer><p>All rights reserved. Contact the newsroom.</p></footer></body></html>""",
        ["Ferry link to reopen in spring", "voted on Tuesday", "It’s about time" if False else "It's about time", "first of April", "The old ferry in 2009."],
        ["World", "cookies", "Bridge works delayed", "Buy a boat", "All rights reserved"],
    ),
    "table layout": (
        """<html><body bgcolor="#ffffff"><table width="100%"><tr><td colspan="2"><a href="index.htm"><img src="logo.gif"></a></td></tr>
<tr><td width="150" valign="top" class="nav"><a href="a.htm">Start</a><br><a href="b.htm">Photos</a><br><a href="c.htm">Guestbook</a></td>
<td valign="top"><h1>History of the mill</h1><p>The mill was built in 1742 by two brothers who had come from the north.
<p>It burnt down twice, and was rebuilt each time with stone from the quarry nearby.
<p>Since 1970 it has been a museum, open on Sundays.</td></tr></table></body></html>""",
        ["History of the mill", "built in 1742 by two brothers", "burnt down twice", "open on Sundays"],
        ["Guestbook", "Photos"],
    ),
    "docs": (
        """<html><body><div class="layout"><nav class="sidebar toc"><ul><li><a href="#i">Install</a></li><li><a href="#u">Usage</a></li><li><a href="#f">FAQ</a></li></ul></nav>
<main class="main-content"><section id="i"><h2>Installing the tool</h2><p>Download the archive and unpack it into a folder of your choice.</p><pre><code>tar xf tool.tar</code></pre></section>
<section id="u"><h2>Using it</h2><p>Run the program with the name of a file. It prints the number of lines, words and letters.</p></section></main></div>
<footer class="legal">Imprint and privacy</footer></body></html>""",
        ["Installing the tool", "unpack it into a folder", "tar xf tool.tar", "prints the number of lines"],
        ["FAQ", "Imprint and privacy"],
    ),
    "old page, no structure": (
        """<html><body><h1>My trip to the lake</h1>We left early, when the fog was still over the fields.<br><br>
By noon the sun was out, and we ate by the water.<br>Nobody wanted to drive back.<p>It was a good day.</body></html>""",
        ["My trip to the lake", "when the fog was still", "ate by the water", "It was a good day."],
        [],
    ),
    "div soup": (
        """<body><div class="x1"><div class="topbar"><span>Sign in</span> <a href="/r">Register</a></div><div class="breadcrumbs"><a href="/">Top</a> &gt; <a href="/g">Garden</a></div>
<div class="col"><div class="story"><div class="headline"><h1>Planting garlic</h1></div><div class="txt">Break the bulb into cloves and plant them a hand apart, tips up. Cover the bed with straw before the frost, and wait until the leaves turn yellow in summer.</div><div class="txt">Dry the bulbs in the shade for two weeks before you store them.</div></div>
<div class="newsletter"><form action="/n"><label>Your mail</label><input name="m"><button>Subscribe</button></form></div></div>
<div class="sidebar"><div class="promo">Seeds, now 20% off</div><h3>Popular</h3><a href="/1">Tomatoes</a><a href="/2">Beans</a></div><div class="footer">About us | Terms</div></div></body>""",
        ["Planting garlic", "Break the bulb into cloves", "Dry the bulbs in the shade"],
        ["Sign in", "Subscribe", "20% off", "Tomatoes", "Terms"],
    ),
}


@pytest.fixture(scope="module")
def model():
    return html_text.train()


@pytest.mark.parametrize("name", sorted(PAGES))
def test_hand_written_page(model, name):
    page, there, away = PAGES[name]
    (text,) = html_text.main_texts([page], model)
    flat = " ".join(text.split())
    assert not [x for x in there if x not in flat], text
    assert not [x for x in away if x in flat], text


BROKEN = {
    '<article><p title="oops>first part</p><p>second part</p></article>': "",
    "<p>before</p><p title='never ends>after": "before",
    "<p>one <!-- never ends <p>two": "one",
    "<p>a < b and 3 <4 but <b>c</b></p>": "a < b and 3 <4 but c",
    "<p it's fine>said</p>": "said",
    "<p data-x=a'b>said</p>": "said",
    '<p title="a > b">said</p>': "said",
    "<p>x</b></i></div>y</p>": "x\n\ny",
    "<ul><li>one<li>two</ul>": "one\n\ntwo",
    "text only & more": "text only & more",
    "<p>end <": "end <",
    "<p>end <p": "end",
    "</p>": "",
}


@pytest.mark.parametrize("page", sorted(BROKEN))
def test_scanner_on_broken_markup(page):
    got = html_text.Page(page)
    # every element counts as article: only the scanner is tested
    assert got.text([html_text.ARTICLE] * len(got.tag)) == BROKEN[page]


@pytest.mark.parametrize("part", ['<a "', "<a b='", "<", "<div>", "<p>x", "<td><p>", "</b>", "<!--", "<i><table><td>", "a=\"<", "<p =", "<title>"])
def test_scanner_is_linear(part):
    def took(n):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            html_text.Page(part * n)
            best = min(best, time.perf_counter() - began)
        return best

    # four times the page: well under eight times the time, though quadratic would be sixteen
    assert took(40_000) < 8 * took(10_000) + 0.02


def test_columns_of_the_results_names(spark, model):
    df = spark.createDataFrame([(1, "u", "<article><p>said in a few plain words.</p></article>", "old")], "page_id long, url string, html string, __text string")
    out = html_text.extract(df, model=model)
    assert out.columns == ["page_id", "url", "__text"] and out.first()["__text"] == "said in a few plain words."


def test_very_long_page(model):
    page = f"<body><nav><ul><li><a href=/>menu</a></li></ul></nav><article>{'<p>a few words of the story.</p>' * 60_000}</article></body>"
    (text,) = html_text.main_texts([page], model)
    assert text.count("a few words of the story.") == 60_000 and "menu" not in text
