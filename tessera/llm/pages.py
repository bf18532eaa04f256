"""Main text of web pages by a linear-chain conditional random field over leaf blocks (operator 10).

A page is cut into leaf blocks: text between block-level tags, with the tags and the class, id and
role words of all ancestors as bits.  Blocks get features from those bits and from their text, and a
two-label chain (article or not) is decoded by Viterbi.  The weights are trained on labelled pages
(``labelled_pages`` makes them: some fifteen layouts of menus, notices, adverts, sidebars, forms and
comments around and inside articles), by gradient ascent on the exact likelihood.  Training uses a
fixed number of pages, runs once in the driver and takes a few seconds; pages are then extracted
independently of each other, so the operator is one map without a shuffle.

Rows: a null or empty page has an empty text; unclosed tags end with their parent or the page;
repeated rows are extracted alike; very long pages are read whole; other columns pass by.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TRAINING_PAGES = 700
STEPS = 220

# Elements by their part in the layout.
BLOCK_TAGS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<>]*\"|'[^'<>]*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
#: Elements that are dropped whole; one without its end tag ends at the next block tag.
DROPPED = "svg noscript template iframe select".split()
DROPPED_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)({'|'.join(DROPPED)})(?![^\s/>])((?:[^>\"']|\"[^\"<>]*\"|'[^'<>]*')*|[^>]*)>", re.S | re.I)
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK_TAGS))})(?![^\s/>])", re.I)
BLOCK_TAG_NOT_OPTION = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK_TAGS - {'option'}))})(?![^\s/>])", re.I)
NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
WORDS = re.compile(r"[a-z]+")
# Words of class, id and role attributes by what they announce.
HINTS = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adbox adslot dfp",
    "comment": "comment comments commentlist respond reply replies disqus discussion reviews",
    "side": "sidebar aside side rail widget widgets secondary complementary",
    "social": "share sharing social follow tweet facebook like",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast banner disclaimer warning",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs toolbar skip",
    "foot": "footer foot copyright legal colophon contentinfo",
    "head": "header masthead topbar top logo branding brand sitename",
    "form": "form newsletter subscribe subscription signup login search input register",
    "related": "related recommended recommendation more popular trending also teaser links",
    "body": "article content post entry story main text body articlebody maincontent postbody",
    "meta": "meta byline author date published tags category categories timestamp",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
TAG_BITS = "nav header footer aside form article main section ul li p h1 h2 table blockquote figure pre button dialog address details div".split()
BITS = {name: 1 << i for i, name in enumerate([f"<{t}>" for t in TAG_BITS] + [f".{h}" for h in HINTS])}
ALIAS = {"ol": "ul", "dl": "ul", "dt": "li", "dd": "li", "h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "label": "button", "legend": "button", "fieldset": "form", "menu": "nav", "td": "table", "th": "table", "tr": "table", "summary": "details", "figcaption": "figure"}
PHRASES = re.compile(r"cookie|subscribe|newsletter|sign (?:up|in)|log ?in|all rights reserved|©|privacy|share (?:this|on)|\bcomments?\b|\breply\b|related|advert|sponsor|read more|terms of|menu\b|search\b", re.I)


@lru_cache(maxsize=20_000)
def _bits(tag: str, attrs: str) -> int:
    tag = ALIAS.get(tag, tag)
    out = BITS.get(f"<{tag}>", 0)
    for m in NAMED.finditer(attrs):
        for w in WORDS.findall(m[1].lower()):
            if hint := HINT_OF.get(w):
                out |= BITS[f".{hint}"]
    return out


#: Open elements that an opening tag ends, up to the given ancestors.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def _dropped_ends(page: str) -> dict[int, int]:
    """Ends of the dropped elements that are closed, by the ends of their opening tags."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {t: [] for t in DROPPED}
    for m in DROPPED_TAG.finditer(page):
        if m[3] and m[2]:
            if opened[m[3].lower()]:
                out[opened[m[3].lower()].pop()] = m.end()
        elif m[3] and not (m[3].lower() == "svg" and m[4].endswith("/")):
            opened[m[3].lower()].append(m.end())
    return out


def blocks(page: str) -> list[tuple[str, int, str, int]]:
    """Leaf blocks in page order: (text, ancestors' bits, nearest block tag, characters in links)."""
    out = []
    stack: list[tuple[str, int]] = [("", 0)]  # tag, bits of it and its ancestors
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                near = next((t for t, _ in reversed(stack) if t in BLOCK_TAGS), "")
                out.append((text, stack[-1][1], near, linked))
            parts.clear()
        linked = 0

    def close(names, stop) -> None:
        nonlocal links
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                links -= sum(t == "a" for t, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at = 0
    ends_of = None
    while m := TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        ends, attrs = m[2] or m[5], m[4] or m[7] or ""
        if tag in DROPPED and not ends:
            if tag == "svg" and attrs.endswith("/"):
                continue
            if ends_of is None:
                ends_of = _dropped_ends(page)
            if at in ends_of:
                at = ends_of[at]
            else:
                block_tag = (BLOCK_TAG_NOT_OPTION if tag == "select" else BLOCK_TAG).search(page, at)
                at = block_tag.start() if block_tag else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if ends:
            # an end tag of an inline element doesn't reach over block elements
            close({tag}, () if block else BLOCK_TAGS)
        elif tag not in VOID_TAGS:
            if block and tag not in ("html", "body", "head"):
                close({"p"}, {"table", "button", "article", "section", "div", "li", "td", "blockquote"})
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            if not attrs.endswith("/"):
                stack.append((tag, stack[-1][1] | _bits(tag, attrs)))
                links += tag == "a"
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


_NEGATIVE = sum(BITS[f"<{t}>"] for t in "nav aside form button dialog".split()) | sum(BITS[f".{h}"] for h in "ad comment side social notice menu foot form related".split())
_INSIDE = BITS["<article>"] | BITS["<main>"] | BITS[".body"]
_NAMES = [*BITS, *(f"{b}&in" for b in BITS), *(f"near:{t}" for t in "p li div h1 h2 h3 td blockquote pre figcaption header footer other".split()), *(f"words:{i}" for i in range(6)), *(f"links:{i}" for i in range(4)), "sentence", "phrase", "phrase&clean", "clean", "clean&in", "clean&in&p", "head&h", "foot&in", "title_seen", "title_next", "first", "last", "bias", "phrase&in&short"]
INDEX = {n: i for i, n in enumerate(_NAMES)}


def features(page_blocks: list[tuple[str, int, str, int]]) -> list[list[int]]:
    out = []
    seen = False
    n = len(page_blocks)
    for i, (text, bits, near, linked) in enumerate(page_blocks):
        f = [INDEX["bias"]]
        inside = bool(bits & _INSIDE)
        for k, b in enumerate(BITS.values()):
            if bits & b:
                f.append(k)
                if inside:
                    f.append(k + len(BITS))
        f.append(INDEX.get(f"near:{near}", INDEX["near:other"]))
        words = text.count(" ") + 1
        f.append(INDEX["words:0"] + min(5, words.bit_length() - 1))
        f.append(INDEX["links:0"] + (0 if not linked else 1 if 3 * linked < len(text) else 2 if 3 * linked < 2 * len(text) else 3))
        if text[-1] in ".!?…\"”»:;":
            f.append(INDEX["sentence"])
        clean = not bits & _NEGATIVE
        phrase = words < 25 and PHRASES.search(text) is not None
        if phrase:
            f.append(INDEX["phrase"])
            if clean:
                f.append(INDEX["phrase&clean"])
        if clean:
            f.append(INDEX["clean"])
            if inside:
                f.append(INDEX["clean&in"])
                if near == "p":
                    f.append(INDEX["clean&in&p"])
        if bits & BITS["<header>"] and near[:1] == "h" and near != "header":
            f.append(INDEX["head&h"])
        if seen:
            f.append(INDEX["title_seen"])
        if near == "h1":
            seen = True
            f.append(INDEX["title_next"])
        if i == 0:
            f.append(INDEX["first"])
        if i == n - 1:
            f.append(INDEX["last"])
        out.append(f)
    return out


class Chain:
    """Weights of the two-label chain: emission of "article" over "not", and transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def emissions(self, feats: list[list[int]]) -> list[float]:
        w = self._list = getattr(self, "_list", None) or self.weights.tolist()
        return [sum([w[k] for k in f]) for f in feats]

    def decode(self, feats: list[list[int]]) -> list[bool]:
        """Viterbi: the best labels of the blocks."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        back, s0, s1 = [], 0.0, 0.0
        for i, e in enumerate(self.emissions(feats)):
            if i:
                a0, a1 = s0 + m00 >= s1 + m10, s0 + m01 >= s1 + m11
                back.append((a0, a1))
                s0, s1 = max(s0 + m00, s1 + m10), max(s0 + m01, s1 + m11)
            s1 += e
        if not feats:
            return []
        label = s1 > s0
        out = [label]
        for a0, a1 in reversed(back):
            label = not (a1 if label else a0)
            out.append(label)
        return out[::-1]

    def likelihood(self, em: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of padded pages, and the gradients by emission and by transition (forward-backward)."""
        pages, steps = em.shape
        e = np.stack([np.zeros_like(em), em], axis=2)
        fwd, bwd = np.zeros((pages, steps, 2)), np.zeros((pages, steps, 2))
        fwd[:, 0] = e[:, 0]
        for t in range(1, steps):
            step = np.logaddexp(fwd[:, t - 1, 0, None] + self.moves[0], fwd[:, t - 1, 1, None] + self.moves[1]) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        for t in range(steps - 2, -1, -1):
            nxt = e[:, t + 1] + bwd[:, t + 1]
            step = np.logaddexp(self.moves[:, 0] + nxt[:, 0, None], self.moves[:, 1] + nxt[:, 1, None])
            bwd[:, t] = np.where(mask[:, t + 1, None], step, bwd[:, t + 1])
        p1 = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - total[:, None])
        by_em = np.where(mask, gold - p1, 0.0)
        by_move = np.zeros((2, 2))
        both = mask[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(fwd[:, :-1, a] + self.moves[a, b] + e[:, 1:, b] + bwd[:, 1:, b] - total[:, None])
                is_ = (gold[:, :-1] == a) & (gold[:, 1:] == b)
                by_move[a, b] = np.where(both, is_ - p, 0.0).sum()
        score = np.where(mask, gold * em, 0.0).sum() + (self.moves[gold[:, :-1], gold[:, 1:]] * both).sum()
        return float(score - total.sum()), by_em, by_move


def train(pages: list[tuple[list[list[int]], list[bool]]], steps: int = STEPS, penalty: float = 0.5) -> Chain:
    """Maximise the penalised likelihood of labelled block sequences."""
    pages = [p for p in pages if p[0]]
    longest = max(len(f) for f, _ in pages)
    mask, gold = np.zeros((len(pages), longest), dtype=bool), np.zeros((len(pages), longest), dtype=int)
    at, feat = [], []
    for i, (f, y) in enumerate(pages):
        mask[i, : len(f)], gold[i, : len(f)] = True, y
        for t, ks in enumerate(f):
            at += [i * longest + t] * len(ks)
            feat += ks
    at, feat = np.array(at), np.array(feat)
    chain = Chain(np.zeros(len(INDEX)), np.zeros((2, 2)))
    m = [np.zeros(len(INDEX)), np.zeros((2, 2))]
    v = [np.zeros(len(INDEX)), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        em = np.bincount(at, weights=chain.weights[feat], minlength=mask.size).reshape(mask.shape)
        _, by_em, by_move = chain.likelihood(em, mask, gold)
        grads = [np.bincount(feat, weights=by_em.ravel()[at], minlength=len(INDEX)) - penalty * chain.weights, by_move - penalty * chain.moves]
        for k, (g, x) in enumerate(zip(grads, (chain.weights, chain.moves))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            x += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return chain


#: Marks article text in labelled pages; a private character that blocks lose before features are taken.
GOLD = "\ue000"


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 10):
    """Made-up pages whose article text carries the GOLD mark."""
    rnd = random.Random(seed)
    syllables = "an be ca do el fo gi ha in ja ke lo mi no or pa qu re si to um va wi xo yu ze".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b))).capitalize()
    sentence = lambda: say(1, 14) + rnd.choice(["."] * 6 + ["?", "!", ",", "", " |", ":"])
    prose = lambda: GOLD + " ".join(sentence() for _ in range(rnd.choice([1, 1, 1, 2, 4, 7])))
    pick = lambda *x: rnd.choice(x)
    maybe = lambda p, f: f() if rnd.random() < p else ""

    def link():
        return f'<a href="/{word()}">{say(1, 3)}</a>'

    def menu():
        items = [link() for _ in range(rnd.randint(2, 9))]
        body = "".join(f"<li>{x}</li>" for x in items) if rnd.random() < 0.8 else " | ".join(items)
        return pick(f"<nav><ul>{body}</ul></nav>", f'<div class="{pick("menu", "navbar", "top-nav")}"><ul>{body}</ul></div>', f'<ul id="{pick("nav", "main-menu")}">{body}</ul>', f'<div role="navigation">{body}</div>', f'<p class="breadcrumbs">{" &gt; ".join(items)}</p>')

    def head():
        return pick(f"<header><h1>{say(1, 3)}</h1><p>{sentence()}</p></header>", f'<div class="{pick("masthead", "topbar", "header")}">{say(1, 4)}</div>', f'<header><a href="/">{say(1, 2)}</a>{menu()}</header>', menu(), menu())

    def ad():
        text = pick(sentence(), say(2, 8), f"{say(1, 3)} {link()}", " ".join(sentence() for _ in range(3)))
        return pick(f'<div class="{pick("ad", "ads", "ad-slot", "advert", "sponsored", "promo banner", "advertisement")}">{pick(text, f"<p>{text}</p>")}</div>', f'<!-- ad {word()} --><div id="{pick("ad-1", "banner-ad")}">{text}</div>', f'<aside class="promo"><p>{text}</p></aside>')

    def notice():
        text = pick("We use cookies to improve your experience. ", "This site uses cookies. ", "") + sentence()
        return pick(f'<div class="{pick("cookie-notice", "consent", "gdpr-banner", "alert notice", "popup")}"><p>{text}</p>{pick("", "<button>OK</button>")}</div>', f'<div role="dialog" id="cookie-consent">{text}</div>', f'<section class="notice">{text}</section>')

    def side():
        inner = pick("".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 6))), f"<p>{sentence()}</p>", f"<h3>{say(1, 3)}</h3><p>{sentence()}</p>", " ".join(sentence() for _ in range(2)))
        return pick(f"<aside>{inner}</aside>", f'<div class="{pick("sidebar", "widget", "right-rail")}">{inner}</div>', f'<div id="sidebar"><h3>{say(1, 3)}</h3>{inner}</div>', f'<section class="related"><h2>{pick("Related", "More", say(1, 2))}</h2>{inner}</section>')

    def form():
        return pick(f'<form action="/s"><label>{say(1, 3)}</label><input name="q"><button>{say(1, 1)}</button></form>', f'<div class="newsletter"><p>{pick("Subscribe to our newsletter", sentence())}</p><form><input><button>Sign up</button></form></div>', f'<form class="search"><p>{sentence()}</p><select><option>{word()}</option></select></form>', f"<form><p>{sentence()}</p><p>{sentence()}</p><textarea>{word()}</textarea></form>")

    def comments():
        one = lambda: pick(f"<p>{sentence()}</p>", f'<div class="comment"><b>{word()}</b><p>{sentence()} {sentence()}</p></div>', f"<li><p>{sentence()}</p></li>")
        body = "".join(one() for _ in range(rnd.randint(1, 6)))
        return pick(f'<section id="comments"><h2>{pick("Comments", say(1, 2))}</h2>{body}</section>', f'<div class="{pick("comments", "comment-list", "reader-comments", "disqus")}">{body}</div>', f'<ul class="commentlist">{body}</ul>')

    def foot():
        text = pick(f"&copy; {word()}.example.org", f"© 2020 {say(1, 3)}. All rights reserved.", say(2, 6), f"{link()} {link()}", sentence())
        return pick(f"<footer>{text}</footer>", f"<footer><p>{text}</p></footer>", f'<div class="footer">{text}</div>', f'<div id="footer"><ul><li>{link()}</li><li>{text}</li></ul></div>')

    def paragraph():
        text = prose()
        kind = rnd.random()
        if kind < 0.55:
            return f"<p>{text}</p>"
        if kind < 0.65:
            return f"<p><b>{text}<br>"
        if kind < 0.7:
            return f"<p>{text} <a href='/x'>{say(1, 3)}</a> {say(2, 6)}.</p>"
        if kind < 0.76:
            return f"<ul>{''.join(f'<li>{GOLD}{sentence()}</li>' for _ in range(rnd.randint(1, 5)))}</ul>"
        if kind < 0.82:
            return f"<h{rnd.randint(2, 4)}>{GOLD}{say(1, 6)}</h2>"
        if kind < 0.86:
            return f"<blockquote>{pick(text, f'<p>{text}</p>')}</blockquote>"
        if kind < 0.9:
            return f"<table><tr><td>{GOLD}{say(1, 3)}</td><td>{GOLD}{say(1, 4)}</td></tr></table>"
        if kind < 0.93:
            return f"<figure><img src='x.png'><figcaption>{GOLD}{sentence()}</figcaption></figure>"
        if kind < 0.96:
            return f"<pre>{text}</pre>"
        return f"<div>{text}</div>"

    for _ in range(n):
        title = GOLD + say(1, 9)
        body = [paragraph() for _ in range(rnd.choice([1, 2, 4, 8, 14]))]
        for p, f in ((0.25, ad), (0.12, form), (0.12, side), (0.1, notice)):
            if rnd.random() < p:
                body.insert(rnd.randint(0, len(body)), f())
        if rnd.random() < 0.2:
            body.append(comments())
        inner = maybe(0.9, lambda: pick(f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>")) + "".join(body)
        tag, end = pick(("<article>", "</article>"), ("<article>", "</article>"), ('<article class="post">', "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="article-body">', "</div>"), ('<div class="entry-content post">', "</div>"), ('<section class="story">', "</section>"), ("<div>", "</div>"), ('<div class="page"><div class="wrap">', "</div></div>"))
        before = maybe(0.9, head) + maybe(0.3, notice) + maybe(0.4, ad) + maybe(0.2, form) + maybe(0.2, side)
        after = maybe(0.25, side) + maybe(0.25, comments) + maybe(0.2, form) + maybe(0.2, ad) + maybe(0.9, foot)
        tail = pick("</body></html>", "</body></html>", "")
        yield f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{say(1, 5)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{before}{tag}{inner}{end}{after}{tail}'


def labelled(page: str) -> tuple[list, list[bool]]:
    found = blocks(page)
    return [(t.replace(GOLD, ""), b, n, k) for t, b, n, k in found if t.strip(GOLD)], [GOLD in t for t, *_ in found if t.strip(GOLD)]


@lru_cache(maxsize=2)
def trained(n: int = TRAINING_PAGES, seed: int = 10) -> Chain:
    pages = []
    for page in labelled_pages(n, seed):
        found, gold = labelled(page)
        pages.append((features(found), gold))
    return train(pages)


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, keep in zip(found, chain.decode(features(found))) if keep)


def extract(pages: DataFrame, html_col: str = "html", chain: Chain | None = None) -> DataFrame:
    """Append text and n_chars; existing columns of those names are replaced."""
    chain = chain or trained()
    kept = [f for f in pages.schema.fields if f.name not in ("text", "n_chars") or f.name == html_col]
    pages = pages.select(*[f"`{f.name}`" for f in kept])
    place = pages.columns.index(html_col)
    out = [f for f in kept if f.name != html_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), "text string", "n_chars bigint"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h, chain) for h in part.column(place).to_pylist()]
                cols = [c for i, c in enumerate(part.columns) if i != place]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in out), "text", "n_chars"])

    return pages.mapInArrow(run, schema)
