"""Operator 10: held-out pages, exact decoding, markup edge cases."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np

from tessera.llm import pages


def test_held_out_accuracy():
    chain, wrong, total = pages.trained(), 0, 0
    for page in pages.labelled_pages(300, seed=77):
        found, gold = pages.labelled(page)
        wrong += sum(a != b for a, b in zip(chain.decode(pages.features(found)), gold))
        total += len(gold)
    assert wrong <= 0.01 * total


def test_viterbi_and_gradient():
    rng = np.random.default_rng(0)
    chain = pages.Chain(rng.normal(size=len(pages.INDEX)), rng.normal(size=(2, 2)))
    feats = [[int(k) for k in rng.integers(0, len(pages.INDEX), 3)] for _ in range(6)]
    em = chain.emissions(feats)
    score = lambda y: sum(e for e, b in zip(em, y) if b) + sum(chain.moves[a, b] for a, b in zip(y, y[1:]))
    ways = list(itertools.product([0, 1], repeat=6))
    assert [int(b) for b in chain.decode(feats)] == list(max(ways, key=score))
    gold = np.array([[0, 1, 1, 0, 1, 1]])
    mask, e = np.ones((1, 6), bool), np.array([em])
    like, by_em, _ = chain.likelihood(e, mask, gold)
    exact = score(tuple(gold[0])) - np.log(sum(np.exp(score(y)) for y in ways))
    assert np.isclose(like, exact)
    e2 = e.copy()
    e2[0, 2] += 1e-6
    assert np.isclose((chain.likelihood(e2, mask, gold)[0] - like) / 1e-6, by_em[0, 2], atol=1e-4)


def test_text_and_markup():
    page = """<html><head><title>no</title><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p><b>One  two<br>
    <p>x &lt; y&nbsp;&copy;\n\tz.</p><div class="ad">Buy now.</div><ul><li>First <a href="/y">link</a> here.<li>Second.</ul></article>
    <section id="comments"><h2>Comments</h2><p>Nice text, thanks.</p></section><footer>&copy; me</footer>"""
    assert pages.main_text(page, pages.trained()) == "A & B\nOne two\nx < y © z.\nFirst link here.\nSecond."


def test_dropped_elements_end():
    """Self-closed and unclosed elements take no text after them along; formulas and fallback text stay."""
    chain = pages.trained()
    start = "<html><body><article><h1>Some title here</h1><p>A first paragraph with enough words in it to be read.</p>"
    last = "A last paragraph with enough words in it to be read as text."
    for part, text in [
        ('<p>One <svg class="icon"/> two and three more words of a sentence.</p>', "One two and three more words of a sentence."),
        ("<p>With <math/> nothing and more words of a sentence.</p>", "With nothing and more words of a sentence."),
        ("<p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of the words.</p>", "Where x=2 holds for all of the words."),
        ('<p>See <object data="a">the fallback text</object> for more of it here.</p>', "See the fallback text for more of it here."),
        ('<p>Here are many words before it. <svg><path d="x"> unclosed.</p>', "Here are many words before it."),
        ("<p>Here are many words before it. <select><option>a<option>b</p>", "Here are many words before it."),
        ("<p>Some <svg><g><title>t</title></g><text>no</text></svg> words of a sentence are here.</p>", "Some words of a sentence are here."),
        ("<noscript><p>No script.</p></noscript><template><template><p>no</p></template><p>no</p></template><p>The words of a sentence are here.</p>", "The words of a sentence are here."),
        ("<noscript><p>The words of a sentence are here.</p>", "The words of a sentence are here."),
    ]:
        assert pages.main_text(f"{start}{part}<p>{last}</p></article></body></html>", chain).split("\n")[2:] == [text, last]
    assert pages.blocks("<svg>" * 30000) == [] and pages.blocks("<template>" * 30000 + "<p>a") == [("a", pages.BITS["<p>"], "p", 0)]


def test_rows(spark):
    long = "<article>" + "<p>Some words here.</p>" * 20000 + "</article>"
    rows = [(1, "u", None, "t0"), (2, "u", "", "t1"), (3, "u", long, "t2"), (3, "u", long, "t2"), (4, None, "<p", "t3"), (5, "u", "<" * 3000, "t")]
    got = pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == by[2].text == ""
    assert by[3].n_chars == len(by[3].text) and by[3].text.count("\n") == 19999
    assert pages.extract(spark.createDataFrame([], "page_id bigint, html string")).count() == 0


# Written by hand, in layouts that the generator of labelled pages lacks: (page, main text).
BY_HAND = [
    (  # a news page of tables and fonts, without any class
        """<html><body><table width=800><tr><td colspan=2><a href="/">Front</a> <a href="/w">World</a> <a href="/s">Sport</a></td></tr>
        <tr><td valign=top><h1>Ferry service resumes after storm</h1><p>The ferry between the two islands has resumed, the harbour office said on Monday.
        <p>Crews worked <i>through the night</i> to clear the channel of timber.<p>Tickets bought for last week stay valid until May.</td>
        <td><a href="/1">Mayor resigns</a><br><a href="/2">Bread prices up</a><br><a href="/3">Weather</a></td></tr></table><hr>Copyright 2004 The Island Post. All rights reserved.</body></html>""",
        "Ferry service resumes after storm\nThe ferry between the two islands has resumed, the harbour office said on Monday.\nCrews worked through the night to clear the channel of timber.\nTickets bought for last week stay valid until May.",
    ),
    (  # a blog with a caption, a quotation and an author box in a footer of the article
        """<!doctype html><html><head><title>x</title></head><body class="single"><a class="skip-link" href="#c">Skip to content</a><div class="site-branding"><a href="/">Notes from a kitchen</a></div>
        <main id="c"><article class="hentry"><h1 class="entry-title">Why dough rests</h1><div class="entry-content"><p>Dough that rests is easier to roll out, and it is worth the wait.</p>
        <figure><img src="d.jpg" alt=""><figcaption>Two doughs, one of them rested for an hour.</figcaption></figure><blockquote><p>Patience is the cheapest ingredient.</p></blockquote>
        <h2>How long?</h2><p>Half an hour is enough for most flours; rye needs more.</p></div></article></main>
        <aside class="widget-area"><section class="widget"><h2>Archive</h2><ul><li><a href="/a">May</a></li><li><a href="/b">June</a></li></ul></section></aside>
        <div id="respond" class="comment-respond"><h3>Leave a reply</h3><form><p>Your address is not published.</p><textarea></textarea></form></div><footer class="site-footer">Powered by hand.</footer></body></html>""",
        "Why dough rests\nDough that rests is easier to roll out, and it is worth the wait.\nTwo doughs, one of them rested for an hour.\nPatience is the cheapest ingredient.\nHow long?\nHalf an hour is enough for most flours; rye needs more.",
    ),
    (  # documentation with code, a list of steps and a table, between two menus
        """<html><body><header role="banner"><a href="/">Toolbox</a><nav><a href="/docs">Docs</a><a href="/blog">Blog</a></nav></header><div class="layout"><nav class="docs-menu"><ul><li><a href="/i">Install</a></li><li><a href="/u">Use</a></li></ul></nav>
        <div role="main"><h1>Installing the tool</h1><p>You need a shell and a compiler. Neither has to be new.</p><ol><li>Unpack the archive.</li><li>Run the script in it.</li></ol><pre>./build --all</pre>
        <table><tr><th>Option</th><th>Meaning</th></tr><tr><td>--all</td><td>builds the manual too</td></tr></table><p>If it fails, read the log first.</p></div></div><footer><a href="/p">Privacy</a> <a href="/t">Terms of use</a></footer></body></html>""",
        "Installing the tool\nYou need a shell and a compiler. Neither has to be new.\nUnpack the archive.\nRun the script in it.\n./build --all\nOption\nMeaning\n--all\nbuilds the manual too\nIf it fails, read the log first.",
    ),
    (  # a German page with a consent dialog, an advert in the text and reader comments
        """<html lang=de><body><div class="consent-layer" role="dialog"><p>Wir verwenden Cookies, um Inhalte zu zeigen.</p><button>Zustimmen</button></div><div class="kopf header"><ul class="hauptmenu nav"><li><a href="/p">Politik</a></li><li><a href="/k">Kultur</a></li></ul></div>
        <div class="artikel article-text"><h1>Das Museum öffnet wieder</h1><p>Nach drei Jahren Umbau sind die Säle im Osten der Stadt seit gestern wieder offen.</p><div class="anzeige ad-box"><p>Jetzt zwei Brillen zum Preis von einer sichern!</p></div><p>Der Eintritt ist bis zum Sommer frei, sagte die Leiterin.</p></div>
        <div class="kommentare comments"><h3>3 Kommentare</h3><p>Endlich, ich war schon am ersten Tag da.</p><p>Schade um das alte Dach.</p></div><div class="fuss footer"><p>© Stadtblatt</p></div></body></html>""",
        "Das Museum öffnet wieder\nNach drei Jahren Umbau sind die Säle im Osten der Stadt seit gestern wieder offen.\nDer Eintritt ist bis zum Sommer frei, sagte die Leiterin.",
    ),
    (  # a page of divisions with line breaks and no paragraphs
        """<html><body><div id="top-nav"><a href="/">Home</a> | <a href="/about">About</a> | <a href="/contact">Contact</a></div><div id="main-text"><div><b>The lighthouse keeper</b></div><div>He wrote down every ship that passed.<br>Most of them never knew that he was there.</div>
        <div>In the last winter he counted only four.</div></div><div id="side"><a href="/x">More stories</a><a href="/y">Subscribe to our newsletter</a></div></body></html>""",
        "The lighthouse keeper\nHe wrote down every ship that passed. Most of them never knew that he was there.\nIn the last winter he counted only four.",
    ),
    (  # a question and its answer in definition lists, a formula, and a share bar
        """<html><body><ul class="breadcrumb"><li><a href="/">Help</a></li><li><a href="/m">Maths</a></li></ul><section class="post-body"><h1>Area of a circle</h1><p>The area is <math><mi>A</mi><mo>=</mo><mi>π</mi><msup><mi>r</mi><mn>2</mn></msup></math> for a circle of radius r.</p>
        <dl><dt>Radius</dt><dd>Half of the diameter.</dd></dl></section><div class="share-buttons social"><a href="#">Tweet</a><a href="#">Share this</a></div><section class="related-posts"><h2>Related</h2><a href="/v">Volume of a ball</a></section></body></html>""",
        "Area of a circle\nThe area is A=πr2 for a circle of radius r.\nRadius\nHalf of the diameter.",
    ),
]


def test_pages_written_by_hand():
    """Blocks found on pages unlike the labelled ones: recall 0.95, precision 0.9 or more."""
    chain, right, found, there = pages.trained(), 0, 0, 0
    for page, text in BY_HAND:
        got, want = pages.main_text(page, chain).split("\n"), text.split("\n")
        common = sum((Counter(got) & Counter(want)).values())
        right, found, there = right + common, found + len(got), there + len(want)
        print([x for x in want if x not in got], [x for x in got if x not in want])
    print(f"precision {right / found:.3f} recall {right / there:.3f}")
    assert right >= 0.95 * there and right >= 0.9 * found
