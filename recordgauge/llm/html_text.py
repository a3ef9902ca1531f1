"""Main text of web pages: boosted trees over DOM nodes, decoded top-down without contradiction.

A tolerant scanner builds the tree of a page in one pass. Each element has features: its tag, the tokens
of its class, id and role, depth, text, link and punctuation density of its subtree,
position among its siblings and their sizes, and the same marks of its ancestors. Boosted
trees give each element three states: article (A), boilerplate (B) and mixed container (M).
A dynamic program over the tree then picks the likeliest states in which all below
boilerplate is boilerplate and nothing below an article is a mixed container. Text beside
elements is a leaf of its own, each run up to the next block, and leaves are never mixed, so
that every text is judged; that in A leaves is kept, block by block.

The trees are trained on pages that `training_page` makes by rule, with known articles
(TRAIN_PAGES of them, some 5 s on the driver); the model is about 100 kB. Extraction is one
Arrow pass over the html column, no shuffle; nodes of a batch are scored together.

Defined cases: null or empty html gives ''; text without any tag is one article; unclosed,
stray or crossed tags close what HTML would close; a comment, tag or quoted value that never
ends takes the rest; a page of any length is scanned in one pass; repeated rows are treated
alike; other columns pass through `extract`, but one named __text gives way to the result;
an empty table gives an empty table.
"""

from __future__ import annotations

import html as _html
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordgauge.llm.boosting import Boosted, fit

TRAIN_PAGES = 800
ARTICLE, BOILER, MIXED = range(3)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never page text.
SILENT = frozenset("script style noscript template title textarea select svg iframe object head canvas audio video math".split())
RAW = frozenset("script style title textarea noscript iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
ENDS_P = BLOCK - {"body", "html"}
#: Open elements that keep a start tag from closing a paragraph outside them.
HOLDS_P = ("td", "th", "button", "table", "body", "html")
#: Open elements that a start tag of the key closes, and the ones that stop the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TAGS = {t: k for k, t in enumerate("div section article main p h1 h2 h3 h4 ul ol li a nav header footer aside form table blockquote pre figure body html span button label #text".split())}
KIN = ("nav", "header", "footer", "aside", "form", "article", "main", "section")
#: Words in class, id and role, by what they speak for.
GROUPS = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "header masthead topbar branding logo",
    "footer copyright legal colophon imprint",
    "sidebar aside widget related rail recommended trending popular more",
    "cookie cookies consent notice gdpr popup modal alert overlay paywall dialog",
    "form search login signup newsletter subscribe contact",
    "comment comments respond reply replies discussion disqus responses reader readers",
    "share social follow tags meta byline",
    "article content post entry story main body text page prose",
)
GROUP_OF = {w: k for k, words in enumerate(GROUPS) for w in words.split()}
#: Attributes whose words count.
NAMED = frozenset(("class", "id", "role", "aria-label"))
_NAME = re.compile(r"[^\s/>]++")
#: One step through a start tag: up to its end, or to an attribute's value, quoted or not.
_STEP = re.compile(r"""([^>=]*+)(?:(>)|=\s*+(?:(["'])|([^\s>]*+)))""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Tree of a page: node 0 is the root; `flow` lists texts (node, text) and block breaks (-1, '')."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.groups = ["#root"], [-1], [0]
        self.flow: list[tuple[int, str]] = []
        self.scan(source or "")
        self.split_texts()

    def split_texts(self) -> None:
        """Makes each run of text beside elements a leaf `#text`; a run goes on over inline elements, to the next block."""
        has, run = set(self.parent), {}
        for k, (node, text) in enumerate(self.flow):
            if node < 0:
                run = {}
            elif node in has and (node in run or text.strip()) and len(self.tag) > 1:
                if node not in run:
                    run[node] = self.add("#text", node, 0)
                self.flow[k] = (run[node], text)

    def add(self, tag: str, parent: int, marks: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.groups.append(marks)
        return len(self.tag) - 1

    def scan(self, s: str) -> None:
        """One pass: every character is looked at a bounded number of times."""
        stack, flow, at, text = [0], self.flow, 0, 0
        places: dict[str, list[int]] = {}  # of each tag, where it is open on the stack
        quiet = 0

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def close(k: int) -> int:
            out = 0
            for node in stack[k:]:
                places[self.tag[node]].pop()
                out += self.tag[node] in SILENT
            del stack[k:]
            return out

        def say(end: int) -> None:
            if text < end and not quiet:
                flow.append((stack[-1], _html.unescape(s[text:end])))

        while True:
            begin = s.find("<", at)
            if begin < 0 or begin + 1 == len(s):
                say(len(s))
                return
            c = s[begin + 1]
            ending = c == "/" and s[begin + 2 : begin + 3].isalpha()
            if not (ending or c in "!?" or c.isascii() and c.isalpha()):
                at = begin + 1
                continue
            say(begin)
            if c in "!?":
                comment = s.startswith("<!--", begin)
                stop = s.find("-->" if comment else ">", begin + (4 if comment else 2))
                at = text = len(s) if stop < 0 else stop + (3 if comment else 1)
                continue
            name = _NAME.match(s, begin + 1 + ending)
            tag = name[0].lower()
            marks, at, bare = 0, name.end(), False
            while (step := _STEP.match(s, at)) and not step[2]:
                if step[3]:
                    stop = s.find(step[3], step.end())
                    value, at = ("", len(s)) if stop < 0 else (s[step.end() : stop], stop + 1)
                else:
                    value, at = step[4], step.end()
                field = step[1].split()
                if field and field[-1].lower() in NAMED:
                    for w in _TOKEN.findall(value):
                        k = GROUP_OF.get(w.lower())
                        if k is not None:
                            marks |= 1 << k
            if not step:  # a tag or a quote that never ends takes the rest
                return
            bare = step[1].endswith("/")
            at = text = step.end()
            if ending:
                if places.get(tag):
                    quiet -= close(places[tag][-1])
                if tag in BLOCK:
                    flow.append((-1, ""))
                continue
            if tag == "body" and quiet:  # a head that was never closed
                quiet = 0
                close(max(1, places["head"][0] if places.get("head") else 1))
            if tag in CLOSES:
                closing, stops = CLOSES[tag]
                found = last(closing)
                if found > last(stops):
                    quiet -= close(found)
            elif tag in ENDS_P:
                found = last(("p",))
                if found > last(HOLDS_P):
                    quiet -= close(found)
            if tag in BLOCK:
                flow.append((-1, ""))
            elif tag in ("br", "td", "th") and not quiet:
                flow.append((stack[-1], " "))
            if tag in VOID or bare and tag not in BLOCK:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.IGNORECASE).search(s, at)
                at = text = stop.end() if stop else len(s)
                continue
            places.setdefault(tag, []).append(len(stack))
            stack.append(self.add(tag, stack[-1], marks))
            quiet += tag in SILENT

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, link, marks, tags, paras = (np.zeros(n) for _ in range(5))
        for node, text in self.flow:
            if node >= 0:
                size = len(text) - text.count(" ")
                own[node] += size
                marks[node] += sum(map(text.count, ",.;!?"))
        parent = np.array(self.parent)
        names = np.array([TAGS.get(t, -1) for t in self.tag])
        bits = np.array(self.groups)
        kin = np.array([1 << KIN.index(t) if t in KIN else 0 for t in self.tag])
        depth, above, kin_above = np.zeros(n, dtype=int), np.zeros(n, dtype=int), np.zeros(n, dtype=int)
        children, place = np.zeros(n, dtype=int), np.zeros(n, dtype=int)
        in_link = np.zeros(n, dtype=bool)
        for i in range(1, n):
            p = parent[i]
            depth[i], above[i], kin_above[i] = depth[p] + 1, above[p] | bits[p], kin_above[p] | kin[p]
            in_link[i] = in_link[p] or names[i] == TAGS["a"]
            place[i] = children[p]
            children[p] += 1
        link = np.where(in_link, own, 0.0)
        sub = np.stack([own, link, marks, np.ones(n), (names == TAGS["p"]).astype(float), (names == TAGS["li"]).astype(float)])
        for i in range(n - 1, 0, -1):
            sub[:, parent[i]] += sub[:, i]
        total, links, marks, tags, paras, items = sub
        up = np.maximum(parent, 0)
        numeric = np.stack([
            np.log1p(total), np.log1p(own), links / (total + 1), marks / (total + 1), total / tags, np.log1p(tags), np.log1p(paras), items / tags,
            np.minimum(depth, 12), np.minimum(children, 20), place / np.maximum(1, children[up]), np.minimum(children[up], 20),
            total / (total[up] + 1), total / (total[0] + 1), np.log1p((total[up] - total) / np.maximum(1, children[up] - 1)),
        ], axis=1)
        hot = names[:, None] == np.arange(len(TAGS))
        spread = [(v[:, None] >> np.arange(k)) & 1 for v, k in ((bits, len(GROUPS)), (above, len(GROUPS)), (kin_above, len(KIN)))]
        return np.concatenate([numeric, hot, *spread], axis=1).astype(np.float64)

    def decode(self, logp: np.ndarray) -> list[int]:
        """The likeliest states, children of B being B and children of A being A or B."""
        if len(self.tag) == 1:  # no element at all: plain text
            return [ARTICLE]
        score = logp.copy()
        score[np.setdiff1d(np.arange(len(self.tag)), self.parent), MIXED] = -np.inf
        for i in range(len(self.tag) - 1, 0, -1):
            a, b, m = score[i]
            p = self.parent[i]
            score[p, ARTICLE] += max(a, b)
            score[p, BOILER] += b
            score[p, MIXED] += max(a, b, m)
        states = [int(score[0].argmax())]
        for i in range(1, len(self.tag)):
            up = states[self.parent[i]]
            states.append(BOILER if up == BOILER else int(score[i].argmax()) if up == MIXED else int(score[i][:2].argmax()))
        return states

    def text(self, states: list[int]) -> str:
        blocks, part = [], []
        for node, text in [*self.flow, (-1, "")]:
            if node >= 0:
                if states[node] == ARTICLE:
                    part.append(text)
            elif part:
                block = " ".join("".join(part).split())
                if block:
                    blocks.append(block)
                part = []
        return "\n\n".join(blocks)


class Maker:
    """Made-up pages by rule. Words of an article start with MARK, those of boilerplate never do."""

    MARK = "q"

    def __init__(self, r: random.Random):
        self.r = r

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, low: int, high: int, mark: str = "") -> str:
        """One sentence or several."""
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            w = mark + "".join(r.choice("aeioudlmnrstk") for _ in range(r.randint(1, 9)))
            out.append((w.title() if self.chance(0.1) and not mark else w) + (r.choice([",", ".", ";", "?", ":"]) if self.chance(0.12) else ""))
        return " ".join(out) + ("." if self.chance(0.5) else "")

    def attrs(self, group: int, sure: float = 1.0) -> str:
        """A class, id or role that speaks for a group, or another word or none."""
        r = self.r
        if not self.chance(sure):
            return "" if self.chance(0.7) else f' class="{r.choice(["c1", "row", "inner", "block-2", "s7", "col-8", "x"])}"'
        w = r.choice(GROUPS[group].split())
        shape = r.choice(["{}", "{}", "{}-box", "site-{}", "{} x1", "{}Area", "js-{}", "page_{}", "{}-{}".format("{}", r.randint(1, 9)), "main-{}"] if group != 9 else ["{}", "{}", "{}-body", "single-{}", "{} clearfix", "the{}", "{}-wrap"])
        return f' {r.choice(["class", "class", "class", "id", "role"])}="{shape.format(w)}"'

    def link(self, low: int = 1, high: int = 3, mark: str = "") -> str:
        return f'<a href="{self.r.choice(["/", "#", "https://e.example/"])}{self.r.randint(0, 99)}">{self.words(low, high, mark)}</a>'

    def links(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        kind = self.r.choice(["ul", "ul", "ul", "ol", "bar", "div"])
        if kind == "bar":
            return self.r.choice([" | ", " ", " &raquo; ", " / "]).join(self.link() for _ in range(n))
        if kind == "div":
            return "".join(f"<div>{self.link()}</div>" for _ in range(n))
        return f"<{kind}>" + "".join(f"<li>{self.link()}{'</li>' if self.chance(0.9) else ''}" for _ in range(n)) + f"</{kind}>"

    def boiler(self, inside: bool = False) -> str:
        r = self.r
        kind = r.choice("advert advert menu crumbs side notice form comments share related hidden".split() if inside else "advert advert menu crumbs side notice form comments share related imprint hidden".split())
        if kind == "advert":
            t = r.choice(["div", "div", "aside", "section", "ins", "p"])
            return f"<{t}{self.attrs(0)}>{self.link(1, 6) if self.chance(0.3) else self.words(1, 40)}</{t}>"
        if kind == "menu":
            t = r.choice(["nav", "nav", "div", "ul"])
            if t == "ul":
                return f"<ul{self.attrs(1)}>" + "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"
            return f"<{t}{self.attrs(1, 0.4 if t == 'nav' else 0.8)}>{self.links(2, 12)}</{t}>"
        if kind == "crumbs":
            t = r.choice(["div", "p", "nav"])
            return f"<{t}{self.attrs(1, 0.7)}>{' &gt; '.join(self.link() for _ in range(r.randint(2, 4)))}</{t}>"
        if kind in ("side", "related"):
            t = r.choice(["aside", "div", "section"])
            said = f"<p>{self.words(3, 40)}</p>" if self.chance(0.5) else ""
            return f"<{t}{self.attrs(4, 0.6 if t == 'aside' else 0.9)}><{(h := r.choice(['h2', 'h3', 'h4']))}>{self.words(1, 4)}</{h}>{said}{self.links(1, 8)}</{t}>"
        if kind == "notice":
            said = f"<p>{self.words(4, 40)}</p>" if self.chance(0.6) else self.words(4, 40)
            return f"<div{self.attrs(5)}>{said}{f'<button>{self.words(1, 2)}</button>' if self.chance(0.6) else self.link() if self.chance(0.5) else ''}</div>"
        if kind == "form":
            field = f'<label>{self.words(1, 4)}</label><input name="f{r.randint(1, 9)}">'
            return f'<form action="/f"{self.attrs(6, 0.5)}>{field}{f"<p>{self.words(1, 25)}</p>" if self.chance(0.6) else ""}<button type="submit">{self.words(1, 2)}</button></form>'
        if kind == "comments":
            t = r.choice(["div", "li", "article", "section"])
            said = "".join(f"<{t}{self.attrs(7, 0.8)}>{f'<b>{self.words(1, 2)}</b>' if self.chance(0.4) else ''}<p>{self.words(3, 70)}</p></{t}>" for _ in range(r.randint(1, 6)))
            said = f"<ol>{said}</ol>" if t == "li" else said
            return f"<{(o := r.choice(['section', 'div']))}{self.attrs(7)}><{(h := r.choice(['h2', 'h3']))}>{self.words(1, 3)}</{h}>{said}</{o}>"
        if kind == "share":
            return f"<{(t := r.choice(['div', 'ul', 'p']))}{self.attrs(8)}>" + (" ".join(self.link(1, 2) for _ in range(r.randint(2, 5))) if t != "ul" else "".join(f"<li>{self.link(1, 2)}</li>" for _ in range(r.randint(2, 5)))) + f"</{t}>"
        if kind == "imprint":
            return self.imprint()
        return f"<div{self.attrs(r.choice([0, 4, 5]))}><span>{self.words(1, 30)}</span></div>"

    def imprint(self) -> str:
        said = self.r.choice(["&copy; 2021 ", "Copyright ", "(c) ", "", "", "&#169; "]) + self.words(1, 40)
        said += self.links(1, 6) if self.chance(0.4) else ""
        return f"<footer{self.attrs(3, 0.3)}>{f'<p>{said}</p>' if self.chance(0.4) else said}</footer>" if self.chance(0.65) else f"<div{self.attrs(3)}>{said}</div>"

    def masthead(self) -> str:
        inner = f"<{(t := self.r.choice(['div', 'p', 'h1', 'h2', 'span']))}{self.attrs(2, 0.7)}>{self.link() if self.chance(0.5) else self.words(1, 5)}</{t}>"
        inner += f"<nav>{self.links(2, 8)}</nav>" if self.chance(0.4) else self.words(2, 8) if self.chance(0.2) else ""
        return f"<header{self.attrs(2, 0.4)}>{inner}</header>" if self.chance(0.6) else f"<div{self.attrs(2)}>{inner}</div>"

    def inline(self, low: int, high: int) -> str:
        """Article text with a few inline elements."""
        m, r = self.MARK, self.r
        out = [self.words(low, high, m)]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            t = r.choice(["b", "i", "em", "strong", "a", "code", "span", "sup"])
            out += [self.link(1, 4, m) if t == "a" else f"<{t}>{self.words(1, 5, m)}</{t}>", self.words(1, 20, m)]
        return " ".join(out)

    def paragraphs(self) -> str:
        r, m = self.r, self.MARK
        out = [f"<{(h := r.choice(['h1', 'h1', 'h1', 'h2']))}>{self.words(1, 10, m)}</{h}>"] if self.chance(0.85) else []
        if self.chance(0.1):
            out[:] = [f"<header>{''.join(out)}<p>{self.words(3, 12, m)}</p></header>"]
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 16])):
            size = r.choice([(1, 5), (5, 30), (20, 90)])
            kind = r.random()
            if kind < 0.68:
                out.append(f"<p>{self.inline(*size)}{'</p>' if self.chance(0.85) else self.r.choice(['', '<br>'])}")
            elif kind < 0.74:
                out.append(f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{self.words(1, 7, m)}</{h}>")
            elif kind < 0.81:
                t = r.choice(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li>{self.inline(1, 20)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif kind < 0.86:
                out.append(f"<blockquote>{self.inline(*size)}</blockquote>" if self.chance(0.5) else f"<blockquote><p>{self.inline(*size)}</p></blockquote>")
            elif kind < 0.9:
                cells = "".join("<tr>" + "".join(f"<td>{self.words(1, 5, m)}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4)))
                out.append(f"<table>{cells}</table>")
            elif kind < 0.93:
                out.append(f"<pre><code>{self.words(3, 25, m)}</code></pre>")
            elif kind < 0.96:
                out.append(f"<figure><img src=x.png><figcaption>{self.words(2, 12, m)}</figcaption></figure>")
            else:
                out.append(f"<div>{self.inline(*size)}</div>")
            if self.chance(0.07):
                out.append(self.boiler(inside=True))
        if self.chance(0.12):
            at = len(out) // 2
            out = [f"<section>{''.join(out[:at])}</section>" if at else "", f"<section>{''.join(out[at:])}</section>"]
        return "".join(out)

    def loose(self) -> str:
        out = [self.words(5, 60, self.MARK)]
        for _ in range(self.r.choice([0, 1, 2, 4])):
            out.append(self.r.choice(["<br>", "<br><br>", f" <b>{self.words(1, 5, self.MARK)}</b> ", f" {self.link(1, 3, self.MARK)} ", f"<p>{self.words(5, 60, self.MARK)}</p>", self.boiler(inside=True)]) + self.words(5, 60, self.MARK))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        if self.chance(0.03):
            return self.words(1, 200, self.MARK)
        body = self.loose() if self.chance(0.2) else self.paragraphs()
        core = r.choice([
            lambda: f"<article{self.attrs(9, 0.4)}>{body}</article>",
            lambda: f"<article{self.attrs(9, 0.4)}>{body}</article>",
            lambda: f"<div{self.attrs(9)}>{body}</div>",
            lambda: f"<div{self.attrs(9)}><div{self.attrs(9, 0.5)}>{body}</div></div>",
            lambda: f"<main{self.attrs(9, 0.3)}>{body}</main>",
            lambda: f"<main><article>{body}</article>{self.boiler()}</main>",
            lambda: f"<section{self.attrs(9, 0.7)}>{body}</section>",
            lambda: f"<div>{body}</div>",
            lambda: body,
        ])()
        before = "".join(self.boiler() for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])))
        after = "".join(self.boiler() for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])))
        if self.chance(0.12):  # columns by a table
            side = f"<td{self.attrs(4, 0.6)}>{self.links(2, 9)}</td>"
            cells = [side, f"<td{self.attrs(9, 0.4)}>{body}</td>"]
            core = f"<table><tr>{''.join(cells if self.chance(0.6) else cells[::-1])}</tr></table>"
        if self.chance(0.5):
            before = f"<nav{self.attrs(1, 0.3)}>{self.links(2, 9)}</nav>" + before
        if self.chance(0.4):
            before = self.masthead() + before
        if self.chance(0.65):
            after += self.imprint()
        whole = before + core + after
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            whole = f"<div{r.choice(['', ' id=wrap', ' class=container', ' class=layout', ' id=page-7'])}>{whole}</div>"
        if self.chance(0.1):
            return whole
        extra = r.choice(["", "<script>if (a < b) { c('</p>') }</script>", f"<noscript><p>{self.words(2, 9)}</p></noscript>", f"<!-- {self.words(1, 9)} -->"])
        return f"<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>{self.words(1, 6)}</title><style>p{{margin:1em}}</style></head><body>{extra}{whole}</body></html>"


def training_page(r: random.Random) -> tuple[str, str]:
    """A made-up page and the mark of its article's words."""
    return Maker(r).page(), Maker.MARK


def labelled(pages: int = TRAIN_PAGES, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and states of the nodes of made-up pages."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        source, mark = training_page(r)
        page = Page(source)
        good, bad = np.zeros(len(page.tag)), np.zeros(len(page.tag))
        for node, text in page.flow:
            if node >= 0 and text.strip():
                q = sum(w.startswith(mark) for w in text.split())
                good[node] += q > 0
                bad[node] += q == 0 and any(c.isalpha() for c in text)
        for i in range(len(page.tag) - 1, 0, -1):
            good[page.parent[i]] += good[i]
            bad[page.parent[i]] += bad[i]
        state = np.where(good > 0, np.where((bad > 0) & (bad > 0.3 * good), MIXED, ARTICLE), BOILER)
        # a body or wrapper with boilerplate of its own beside the article is mixed, however small that is
        state[(good > 0) & (bad > 0) & np.isin(np.array(page.tag), ["body", "html", "#root"])] = MIXED
        leaves = np.setdiff1d(np.arange(len(page.tag)), page.parent)
        state[leaves] = np.where(good[leaves] > 0, ARTICLE, BOILER)
        xs.append(page.features())
        ys.append(state)
    return np.concatenate(xs), np.concatenate(ys)


def train(pages: int = TRAIN_PAGES, seed: int = 3) -> Boosted:
    x, y = labelled(pages, seed)
    return fit(x, y, 3)


def main_texts(sources: list[str | None], model: Boosted) -> list[str]:
    out: list[str] = []
    for at in range(0, len(sources), 256):
        pages = [Page(s) for s in sources[at : at + 256]]
        feats = [p.features() for p in pages]
        logp = model.log_probabilities(np.concatenate(feats))
        k = 0
        for p, f in zip(pages, feats, strict=True):
            out.append(p.text(p.decode(logp[k : k + len(f)])))
            k += len(f)
    return out


def extract(df: DataFrame, source: str = "html", model: Boosted | None = None) -> DataFrame:
    """`df` without the html column, with __text appended."""
    model = model or train()
    df = df.drop("__text")
    others = [f for f in df.schema.fields if f.name != source]
    schema = T.StructType([*others, T.StructField("__text", T.StringType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = main_texts(b.column(source).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in others], pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def op1(pages: DataFrame) -> DataFrame:
    done = extract(pages.select("page_id", "url", "html"))
    return done.select("page_id", "url", F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))
