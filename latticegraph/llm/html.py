"""Main-text extraction: gradient-boosted trees over DOM-node features with hierarchical decoding.

A page is parsed into a tree of elements. Every element gets features of its own (tag, tokens of class, id and role),
of its subtree (text, links, tags, paragraphs, punctuation), of its place (depth, sibling statistics) and of its
ancestors. Boosted trees, trained here on generated pages with known labels, give the probability that the element
belongs to the main text. Decoding chooses one state per element: content (its text is emitted), boilerplate (nothing
below it is), or container (an ancestor of either, emitting no text itself). Only container -> any, content -> content or
boilerplate and boilerplate -> boilerplate are allowed, and the assignment with the greatest total log-probability is
found by dynamic programming over the tree, so an element never contradicts its ancestors. The page itself and its body
may be content, so text that stands in no other element is not lost.

The training set is TRAIN_PAGES generated pages (a bounded sample by construction); fitting takes a few seconds on the
driver and the model, a few thousand numbers, is sent with the task.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one space in page order. Elements that are never rendered as text (scripts, styles, the head, form controls) and
comments of the markup are left out by the parser. So is what hidden or display:none keeps from being shown. The header of
the article itself (headline, standfirst, byline) belongs to it, that of the page does not; reader comments go, also those
that no attribute marks as such: items of one shape with short names, dates and links.

Defined results: a null or empty page has an empty text; broken markup (unclosed elements, stray end tags, a cut tag or
script at the end) is parsed as far as it goes, and an element of hidden content that is never closed hides nothing; a
page without elements is text as a whole if the trees say so; repeated rows are extracted one by one; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, ddl_name, thrifty

TRAIN_PAGES = 1200
TREES = 50
#: Share of the features that a tree may split by; which ones is drawn anew for each tree.
COLUMNS = 0.5
DEPTH = 5
SEED = 10

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title noscript template svg iframe object canvas audio video math select textarea button datalist".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Start tags that close an open element of their own kind, up to the element that bounds them.
CLOSES_OWN = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

#: Blocks of one line: what is inline in them, links apart, is judged as they are.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote figcaption summary pre".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)(?!\s*=\s*[\"']?until-found)|style\s*=\s*(?:\"[^\"]*|'[^']*)display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?]")
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in HIDDEN}

#: Attribute tokens that the features count, by group.
GOOD = frozenset("article content post entry story main body text articlebody richtext prose".split())
BAD = {
    "nav": "nav navigation menu breadcrumb breadcrumbs navbar pager pagination toc links tabs",
    "edge": "header footer masthead sidebar aside rail copyright colophon banner topbar bottom complementary contentinfo",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promoted promotion banner adsense",
    "talk": "comment comments respond reply replies discussion disqus reviews thread",
    "ask": "form newsletter subscribe signup login search popup modal cookie cookies consent notice notices alert gdpr overlay",
    "more": "related share sharing social recommended trending tags meta widget author bio byline",
}
_GROUP = {t: k for k, words in enumerate(BAD.values()) for t in words.split()}
TAGS = {t: k for k, t in enumerate("article main section div p h1 h2 h3 h4 ul ol li nav header footer aside form table tr td blockquote pre a span b i em strong figure figcaption body html br img dl dt dd label fieldset dialog details".split())}


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "good", "bad", "depth", "text", "own", "links", "tags", "paras", "punct", "label", "block", "unseen", "names", "alike")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.children, self.parts = tag, parent, [], []
        self.block = parent.block if parent is not None and tag in INLINE else self  # the nearest that is not inline
        self.depth = parent.depth + 1 if parent else 0
        self.good = self.bad = 0
        self.unseen = parent is not None and parent.unseen or bool(attrs) and _UNSEEN.search(attrs) is not None
        self.label = None
        if attrs and "=" in attrs:
            for m in _ATTR.finditer(attrs):
                value = m[2] or m[3] or m[4] or ""
                for t in _SPLIT.split(value):
                    t = t.lower()
                    if t in GOOD:
                        self.good += 1
                    elif t in _GROUP:
                        self.bad |= 1 << _GROUP[t]


def parse(page: str | None) -> list[Node]:
    """Elements in page order, the root first. parts holds strings, child nodes and None (a line break).

    The work grows with the length of the page: an end tag is only looked for if such an element is open, and an end
    that is not there is not looked for twice.
    """
    page = page or ""
    root = Node("#root", None)
    nodes, top, at = [root], root, 0
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()

    def up_to(node: Node) -> Node:
        """Close everything up to and with node."""
        at_node = top
        while at_node is not node:
            opened[at_node.tag] -= 1
            at_node = at_node.parent
        opened[node.tag] -= 1
        return node.parent

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            top.parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag] > 0:
                node = top
                while node.tag != tag:
                    node = node.parent
                top = up_to(node)
            continue
        if tag in HIDDEN:
            if m[3].endswith("/"):
                continue
            end = None if tag in unclosed else _END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in RAW:
                at = len(page)
            else:  # an element that is never closed hides nothing
                unclosed.add(tag)
            continue
        if tag in CLOSES_P and opened["p"] > 0 and top.block.tag == "p":
            top = up_to(top.block)
        if tag in CLOSES_OWN:
            own, bounds = CLOSES_OWN[tag]
            own = own.split()
            if any(opened[t] > 0 for t in own):
                node, last = top, None
                while node is not root and node.tag not in bounds:
                    if node.tag in own:
                        last = node
                        if tag != "tr":
                            break
                    node = node.parent
                if last is not None:
                    top = up_to(last)
        if tag == "br":
            top.parts.append(None)
            continue
        node = Node(tag, top, m[3])
        top.children.append(node)
        top.parts.append(node)
        nodes.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            opened[tag] += 1
            top = node
    if at < len(page):
        top.parts.append(page[at:])
    return nodes


N_FEATURES = 42


def features(nodes: list[Node]) -> np.ndarray:
    """One row of features per element."""
    for n in reversed(nodes):
        n.text = n.links = n.punct = n.paras = n.names = 0
        n.tags = 1
        for p in n.parts:
            if type(p) is str:
                s = p.strip()
                if s:
                    n.text += len(s)
                    n.punct += len(_PUNCT.findall(s))
        n.own = n.text
        for c in n.children:
            n.text += c.text
            n.links += c.links
            n.tags += c.tags
            n.paras += c.paras + (c.tag == "p")
            n.punct += c.punct
            n.names += c.names
        if n.tag == "a":
            n.links = n.text
        # names, dates and reply links of a comment are short elements of a line
        n.names += n.tag in INLINE and 0 < n.text <= 40 or n.tag in ("h3", "h4", "h5", "h6", "summary") and 0 < n.text <= 40
        shapes = Counter((c.tag, *(d.tag for d in c.children[:4])) for c in n.children if c.children)
        n.alike = max(shapes.values(), default=0)
    total = max(nodes[0].text, 1)
    page_art = any(n.tag in ("article", "main") for n in nodes)
    page_good = any(n.good for n in nodes)
    page_paras = sum(n.tag == "p" for n in nodes)
    up: dict[int, tuple] = {}
    done = 0  # characters of the page before an element
    out = np.zeros((len(nodes), N_FEATURES), np.float32)
    for k, n in enumerate(nodes):
        p = n.parent
        a_good, a_bad, a_art, a_edge, a_alike = up[id(p)] if p is not None else (0, 0, 0, 0, 0)
        own_art = n.tag in ("article", "main")
        own_edge = n.tag in ("nav", "header", "footer", "aside", "form", "dialog", "fieldset")
        up[id(n)] = (a_good + n.good, a_bad | n.bad, a_art + own_art, a_edge + own_edge, max(a_alike, n.alike))
        kin = p.children if p is not None else ()
        row = out[k]
        row[0] = TAGS.get(n.tag, -1)
        row[1] = n.good
        row[2:8] = [n.bad >> j & 1 for j in range(6)]
        row[8] = a_good
        row[9] = bin(a_bad).count("1")
        row[10:16] = [a_bad >> j & 1 for j in range(6)]
        row[16], row[17] = own_art + a_art, own_edge + a_edge
        row[18] = np.log1p(n.text)
        row[19] = n.links / n.text if n.text else 0
        row[20] = n.text / n.tags
        row[21] = n.paras
        row[22] = n.punct / n.text * 100 if n.text else 0
        row[23] = n.text / total
        row[24] = n.depth
        row[25] = len(kin)
        if p is not None:
            row[26] = p.text and n.text / p.text
            row[27] = p.paras
            row[28] = TAGS.get(p.tag, -1)
        row[29] = np.log1p(n.own)
        row[30] = n.own / n.text if n.text else 0
        row[31] = n.parts.count(None)
        row[32], row[33], row[34] = page_art, page_good, min(page_paras, 20)
        row[35], row[36] = min(n.alike, 20), min(a_alike, 20)
        row[37] = done / total
        row[38] = n.names / n.tags
        row[39] = min(p.names, 30) if p is not None else 0
        row[40] = p.names / p.tags if p is not None else 0
        row[41] = min(p.alike, 20) if p is not None else 0
        done += n.own
    return out


# ---------------------------------------------------------------- boosted trees


class Boosted:
    """Binary gradient boosting with histogram splits; trees are complete and kept as arrays."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = 0.2, bins: int = 32):
        self.n, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        cuts = [np.unique(x[:, j])[:-1] if len(np.unique(x[:, j])) <= self.bins else c for j, c in enumerate(cuts)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        width, rng = max(len(c) for c in cuts) + 1, np.random.default_rng(SEED)
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(prior / (1 - prior)))
        score = np.full(len(y), self.base)
        self.trees = []
        inner = 2**self.depth - 1
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
            at = np.zeros(len(y), np.int64)
            mine = np.sort(rng.permutation(x.shape[1])[: max(1, int(COLUMNS * x.shape[1]))])
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.zeros(count)
                pick = np.zeros((count, 2), np.int64)
                pick[:, 1] = -1
                for j in mine:
                    if not len(cuts[j]):
                        continue
                    slot = (at - first) * width + binned[:, j]
                    gs = np.bincount(slot, g, count * width).reshape(count, width).cumsum(1)
                    hs = np.bincount(slot, h, count * width).reshape(count, width).cumsum(1)
                    G, H = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                    gain = gain[:, : len(cuts[j])]
                    k = gain.argmax(1)
                    better = gain[np.arange(count), k] > best + 1e-9
                    best[better] = gain[np.arange(count), k][better]
                    pick[better] = np.stack([np.full(count, j), k], axis=1)[better]
                for k in range(count):
                    if pick[k, 1] >= 0:
                        feature[first + k], cut[first + k] = pick[k, 0], cuts[pick[k, 0]][pick[k, 1]]
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            leaf = at - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            self.trees.append((feature, cut, value.astype(np.float32)))
            score += value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base, np.float32)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


# ---------------------------------------------------------------- generated training pages


#: Kinds of pages by where the main text stands, and how often each is generated.
KINDS = ("marked", "marked", "marked", "headed", "thread", "section", "div", "beside", "body", "table", "bare", "rootless")


def _training_page(rng: random.Random, kind: str) -> list[Node]:
    """A random page of a kind whose elements are labelled by how they were made."""
    syllables = ["ta", "re", "on", "ing", "es", "ver", "sch", "ou", "ción", "ment", "ar", "li", "no", "per", "a"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(2, 25).capitalize() + rng.choice(".....,?!")
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    good: list[str] = []

    def link() -> str:
        return f'<a href="/{word()}">{words(1, 3)}</a>'

    def item_list() -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"

    def attr(names: str) -> str:
        n = rng.choice(names.split())
        return rng.choice([f' class="{n}"', f" id='{n}'", f' class="{word()} {n}-{word()}"', f" class={n}"])

    def block(names: str, body: str, tags: str = "div section") -> str:
        t = rng.choice(tags.split())
        return f"<{t}{attr(names)}>{body}</{t}>"

    def boilerplate(kind: str) -> str:
        if kind == "nav":
            return rng.choice([f"<nav>{item_list()}</nav>", block("menu nav navigation breadcrumb", item_list()), f"<nav{attr('menu main-nav')}>{link()} {link()}</nav>"])
        if kind == "header":
            return rng.choice([f"<header><p>{words(1, 6)}</p>{item_list()}</header>", f"<header><h1>{words(1, 4)}</h1></header>", block("header masthead topbar", f"<p>{words(1, 8)}</p>{link()}")])
        if kind == "footer":
            return rng.choice([f"<footer>&copy; {words(1, 4)} &middot; {prose(1, 2)}</footer>", f"<footer><p>{prose(1, 3)}</p>{item_list()}</footer>", block("footer copyright colophon", f"<p>{prose(1, 2)}</p>")])
        if kind == "aside":
            return rng.choice([f"<aside><h3>{words(1, 3)}</h3>{item_list()}</aside>", f"<aside><p>{prose(1, 3)}</p></aside>", block("sidebar rail widget related", f"<h4>{words(1, 3)}</h4><p>{prose(1, 3)}</p>{item_list()}")])
        if kind == "ad":
            return rng.choice([f'<div class="ad">{prose(1, 2)}</div>', block("ad ads advert sponsored promo banner", f"<p>{prose(1, 2)}</p>"), block("advertisement ad", f"{sentence()} {link()}", "div aside p")])
        if kind == "notice":
            return block("cookie consent notice alert gdpr", rng.choice([prose(1, 3), f"<p>{prose(1, 2)}</p>{link()}"]))
        if kind == "form":
            return rng.choice([f"<form><label>{words(1, 4)}</label><input><p>{sentence()}</p></form>", block("newsletter subscribe login search", f"<form><p>{prose(1, 2)}</p><label>{words(1, 2)}</label></form>"), f"<form{attr('search contact')}>{words(1, 4)}<fieldset><label>{words(1, 3)}</label></fieldset></form>"])
        if kind == "comments":
            body = "".join(rng.choice([f"<div{attr('comment reply')}><b>{word()}</b><p>{prose(1, 4)}</p></div>", f"<li{attr('comment')}><p>{prose(1, 4)}</p></li>", f"<p>{prose(1, 3)}</p>"]) for _ in range(rng.randint(1, 6)))
            return block("comments discussion respond disqus", f"<h3>{words(1, 3)}</h3>{body}")
        return block("related share social recommended", f"<h4>{words(1, 3)}</h4>{item_list()}")

    def thread(tags: str) -> str:
        """Reader comments that no attribute marks: like items with a name, a date and something to press."""
        outer, inner = rng.choice(tags.split()).split("/")
        name = rng.choice(["<b>{}</b>", "<strong>{}</strong>", "<span>{}</span>", "<h4>{}</h4>", "<cite>{}</cite>", "<a href='/u'>{}</a>"])
        date = rng.choice(["", " <time>{}</time>", " <span>{}</span>", " <small>{}</small>"])
        press = rng.choice(["", "<a href='#'>{}</a>", "<p><a href='#'>{}</a></p>", "<span>{}</span>"])
        line = rng.choice(["", "p"])
        items = ""
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
            head = name.format(words(1, 2)) + date.format(words(1, 2))
            said = f"<p>{prose(1, 3)}</p>" * 1 + (f"<p>{prose(1, 2)}</p>" if rng.random() < 0.2 else "")
            items += f"<{inner}>{f'<p>{head}</p>' if line else head}{said}{press.format(word())}</{inner}>"
        head = f"<h{rng.choice('2334')}>{rng.choice([words(1, 3), '3 ' + word(), word() + ' (12)'])}</h2>" if rng.random() < 0.85 else ""
        own = rng.choice(["", f' class="{word()}"', f' id="{word()}-{word()}"'])
        return f"<{outer}{own}>{head}{items}</{outer}>"

    def heading() -> str:
        """The header of the article itself: headline, standfirst and byline belong to it."""
        out = f"<h{rng.choice('1112')} data-m>{words(2, 12)}</h1>"
        if rng.random() < 0.4:
            out += rng.choice([f"<p data-m>{prose(1, 2)}</p>", f'<p data-m class="standfirst {word()}">{sentence()}</p>', f"<h2 data-m>{sentence()}</h2>"])
        if rng.random() < 0.4:
            out += rng.choice([f'<p data-m class="byline">{words(2, 3)}</p>', f"<div data-m><span data-m>{words(1, 2)}</span> <time data-m>{words(1, 2)}</time></div>", f"<p data-m>{words(1, 2)} <a data-m href='/u'>{words(1, 2)}</a>, {words(1, 2)}</p>"])
        if rng.random() < 0.1:
            out = f"<hgroup data-m>{out}</hgroup>"
        if rng.random() < 0.6:
            return f"<header data-m{rng.choice(['', '', attr('entry-header article-header post-header header ' + word())])}>{out}</header>"
        return f"<div data-m{rng.choice([attr('article-header entry-header post-header story-header headline'), ''])}>{out}</div>"

    kinds = "nav header footer aside ad notice form comments more".split()

    def mark(body: str) -> str:  # elements of good text carry a mark, others do not
        good.append(body)
        return body

    def content() -> str:
        out = []
        if kind == "headed" or rng.random() < 0.25 and kind not in ("rootless", "beside", "table"):
            out.append(heading())
        elif rng.random() < 0.85:
            out.append(f"<h1 data-m>{words(1, 12)}</h1>")
        for _ in range(rng.choice([1, 1, 2, 4, 8, 15])):
            r = rng.random()
            if r < 0.6:
                out.append(f"<p data-m>{prose(1, rng.choice([1, 3, 10, 30]))}" + rng.choice(["</p>", "</p>", ""]))
            elif r < 0.7:  # lines in bold, also short ones and the same again and again
                bold = rng.choice([prose(1, 2), f"{words(1, 6)}.", f"{words(1, 3)}."])
                out.append(f"<p data-m><b data-m>{bold}" + rng.choice(["<br>", "<br>", "</b></p>", ""]))
                if rng.random() < 0.3:
                    out += [f"<p data-m>{bold}</p>"] * rng.randint(1, 9) + out[-1:]
            elif r < 0.76:
                out.append(f"<h2 data-m>{words(1, 6)}</h2>")
            elif r < 0.82:
                out.append(f"<p data-m>{words(1, 3)}.</p>")
            elif r < 0.86:
                out.append("<ul data-m>" + "".join(f"<li data-m>{sentence()}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.9:
                out.append(f"<blockquote data-m><p data-m>{prose(1, 3)}</p></blockquote>")
            elif r < 0.93:
                out.append("<table data-m>" + "".join(f"<tr data-m><td data-m>{words(1, 4)}</td><td data-m>{word()}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif r < 0.945:
                out.append(f"<details data-m><summary data-m>{words(1, 5)}</summary><p data-m>{prose(1, 4)}</p></details>")
            elif r < 0.97:
                out.append(f"<p data-m>{sentence()} <a data-m href='/{word()}'>{words(1, 3)}</a> <em data-m>{words(1, 3)}</em> {sentence()}</p>")
            else:
                out.append(f"<div data-m>{prose(1, 4)}</div>")
            if rng.random() < 0.06:
                out.append(boilerplate(rng.choice(["ad", "more", "aside", "form", "notice", "nav"])))
        return "".join(out)

    names = "content post entry story article-body main-content post-content text"
    body = content()
    tail = boilerplate(rng.choice(["comments", "more"])) if rng.random() < 0.25 else ""
    if kind == "thread":
        tail = thread("section/div section/li aside/div div/blockquote section/article ol/li")
    elif rng.random() < 0.2:
        tail += thread("section/div div/div section/article ul/li")
    before = "".join(boilerplate(k) for k in rng.sample(["nav", "header", "ad", "notice", "form"], rng.randint(0, 4)))
    after = "".join(boilerplate(k) for k in rng.sample(["footer", "aside", "ad", "comments", "more", "form"], rng.randint(0, 4)))

    def links() -> str:
        """Links or a last line without any mark of their own."""
        few = [link() for _ in range(rng.randint(2, 8))]
        return rng.choice([f"<div>{' '.join(few)}</div>", item_list(), f"<p>{' | '.join(few)}</p>", f"<div>{item_list()}</div>", f"<div>&copy; {words(1, 3)} {' '.join(few[:2])}</div>", f"<div><h4>{words(1, 2)}</h4>{item_list()}</div>", " ".join(few)])

    if kind not in ("marked", "headed", "thread") and rng.random() < 0.7:
        before, after = rng.choice([before, ""]) + (links() if rng.random() < 0.6 else ""), (links() if rng.random() < 0.6 else "") + rng.choice([after, ""])
    elif tail and kind != "marked" and rng.random() < 0.4:  # comments behind the main element
        tail, after = "", tail + after
    marked_root = False
    if kind in ("marked", "headed", "thread"):
        shell = rng.random()
        if shell < 0.55:
            main = f"<article data-m>{body}{tail}</article>"
        elif shell < 0.65:
            main = f"<article data-m{attr(names)}>{body}{tail}</article>"
        elif shell < 0.75:
            main = f"<main data-m>{body}{tail}</main>"
        elif shell < 0.85:
            main = f"<main><article data-m>{body}</article>{tail}</main>"
        else:
            main = f"<div data-m{attr(names)}>{body}{tail}</div>"
        if rng.random() < 0.3:
            main = f"<div{rng.choice(['', attr('wrapper page container layout'), attr('row grid')])}>{boilerplate(rng.choice(kinds)) if rng.random() < 0.5 else ''}{main}{boilerplate(rng.choice(kinds)) if rng.random() < 0.5 else ''}</div>"
        page = f"<html><head><title>{words(1, 5)}</title></head><body>{before}{main}{after}</body></html>"
    elif kind == "section":
        page = f"<html><body>{before}<section data-m>{body}{tail}</section>{after}</body></html>"
    elif kind == "div":
        opened = rng.randint(1, 4)
        page = f"<html><body>{before}{'<div data-m>' * opened}{body}{tail}{'</div>' * opened}{after}</body></html>"
    elif kind == "beside":  # content and links without marks in one element
        page = f"<html><body>{before}<div>{links() if rng.random() < 0.5 else ''}{body}{links()}</div>{after}</body></html>"
    elif kind == "body":
        page = f"<html><head><title>{words(1, 5)}</title></head><body>{before}{body}{after}</body></html>"
    elif kind == "table":
        cell = rng.choice([body, f"<font data-m size=2>{prose(3, 20)}<br><br>{prose(1, 9)}</font>", f"{prose(3, 20)}<br>{prose(2, 9)}"])
        side = f"<td width=120>{rng.choice([links(), boilerplate('nav'), boilerplate('aside')])}</td>"
        main = f"<td data-m>{cell}</td>"
        cells = rng.choice([side + main, main + side, main])
        top = f"<tr><td colspan=2>{rng.choice([links(), words(1, 5)])}</td></tr>" if rng.random() < 0.4 else ""
        page = f"<html><body>{rng.choice(['', before])}<table border=0>{top}<tr>{cells}</tr></table>{after}</body></html>"
    elif kind == "bare":  # text straight in the body, lines ended by line breaks
        text = "<br><br>".join(rng.choice([prose(1, 9), f"{prose(1, 4)} <b data-m>{words(1, 3)}</b> {prose(1, 4)}", f"{prose(1, 3)} <a data-m href='/{word()}'>{words(1, 2)}</a> {prose(1, 5)}"]) for _ in range(rng.randint(1, 12)))
        head = f"<h1 data-m>{words(1, 8)}</h1>" if rng.random() < 0.5 else ""
        no_text = [x for x in (before, after) if x.startswith("<")]
        page = f"<html><body data-m>{no_text[0] if no_text else ''}{head}{text}{item_list() if rng.random() < 0.3 else ''}</body></html>"
    else:  # without html and body, or without any element
        marked_root = rng.random() < 0.6
        page = f"{prose(1, 30)}" if marked_root else f"{before}{body}{after}"
        if marked_root and rng.random() < 0.5:
            page = f"{prose(1, 9)}<br>{prose(1, 9)} <i data-m>{words(1, 3)}</i> {prose(1, 4)}"
    nodes = parse(page.replace(" data-m", ' data-m="1"'))
    nodes[0].label = marked_root
    return nodes


class _Marked(Node):
    """A node that remembers whether its tag was marked by the generator."""

    __slots__ = ()

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        super().__init__(tag, parent, attrs)
        self.label = 'data-m="1"' in attrs


def generated(pages: int, seed: int, kinds: tuple[str, ...] = KINDS) -> list[list[Node]]:
    """Parsed pages of the kinds in turn, with labels."""
    global Node
    plain, rng = Node, random.Random(seed)
    Node = _Marked
    try:
        return [_training_page(rng, kinds[k % len(kinds)]) for k in range(pages)]
    finally:
        Node = plain


def training_set(pages: int = TRAIN_PAGES, seed: int = SEED, kinds: tuple[str, ...] = KINDS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements of generated pages; containers of content are not examples."""
    xs, ys = [], []
    for nodes in generated(pages, seed, kinds):
        x = features(nodes)
        holds = set()
        for n in reversed(nodes):
            if n.label or id(n) in holds:
                holds.add(id(n.parent))
        keep = [k for k, n in enumerate(nodes) if n.label or id(n) not in holds]
        xs.append(x[keep])
        ys.append(np.array([nodes[k].label for k in keep], float))
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=4)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED, kinds: tuple[str, ...] = KINDS) -> Boosted:
    return Boosted().fit(*training_set(pages, seed, kinds))


# ---------------------------------------------------------------- decoding

CONTAINER, CONTENT, BOILERPLATE = 0, 1, 2
#: Elements that may hold both content and boilerplate without emitting text of their own.
HOLDERS = frozenset("#root html body div section main center table tr td tbody span article font".split())


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[int]:
    """The best consistent state of every element."""
    yes, no = (-np.logaddexp(0, -log_odds)).tolist(), (-np.logaddexp(0, log_odds)).tolist()
    index = {id(n): k for k, n in enumerate(nodes)}
    above = [index[id(n.parent)] if n.parent is not None else -1 for n in nodes]
    # totals of each state, from the last element up; the last place takes what the root hands on
    container, content, boilerplate = ([0.0] * (len(nodes) + 1) for _ in range(3))
    for k in range(len(nodes) - 1, -1, -1):
        a = container[k] + (no[k] * 0.5 if nodes[k].tag in HOLDERS else -1e6)
        b, c = content[k] + yes[k], boilerplate[k] + no[k]
        container[k], content[k], boilerplate[k] = a, b, c
        up = above[k]
        inside = b if b > c else c
        container[up] += a if a > inside else inside
        content[up] += inside
        boilerplate[up] += c
    state = [BOILERPLATE] * len(nodes)
    for k, up in enumerate(above):
        over = CONTAINER if up < 0 else state[up]
        if over == BOILERPLATE:
            continue
        inside = CONTENT if content[k] >= boilerplate[k] else BOILERPLATE
        best = content[k] if inside == CONTENT else boilerplate[k]
        state[k] = CONTAINER if over == CONTAINER and container[k] >= best else inside
    return state


def main_text(nodes: list[Node], state: list[int]) -> str:
    """Text of the content elements: one space for white space, blocks trimmed and joined by one space."""
    index = {id(n): k for k, n in enumerate(nodes)}
    out: list[str] = []
    todo: list = [nodes[0]]
    while todo:
        item = todo.pop()
        if type(item) is str:
            out.append(item)
            continue
        s = state[index[id(item)]]
        if s == BOILERPLATE:
            out.append(" ")
            continue
        block = item.tag not in INLINE
        parts: list = [" "] if block else []
        for p in item.parts:
            if p is None:
                parts.append(" ")
            elif type(p) is str:
                if s == CONTENT:
                    parts.append(entities.unescape(p))
            else:
                parts.append(p)
        if block:
            parts.append(" ")
        todo += reversed(parts)
    return " ".join("".join(out).split())


def extract_page(page: str | None, model: Boosted) -> str:
    """Main text of one page."""
    return extract_pages([page], model)[0]


def extract_pages(pages: list[str | None], model: Boosted) -> list[str]:
    """Main texts; the trees run over the elements of all the pages at once."""
    parsed = [parse(p) for p in pages]
    x = [features(n) for n in parsed]
    scores = model.score(np.concatenate(x)) if x else np.zeros(0)
    at = np.cumsum([0, *map(len, parsed)])
    for nodes, first in zip(parsed, at):
        place = {id(n): first + k for k, n in enumerate(nodes)}
        for k, n in enumerate(nodes):
            if n.unseen:
                scores[first + k] = -1e3
            elif n.tag in INLINE and n.tag != "a" and n.block.tag in LINES:
                scores[first + k] = scores[place[id(n.block)]]
    return [main_text(n, decode(n, scores[a:b])) for n, a, b in zip(parsed, at, at[1:])]


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """id, url, text and n_chars of every page."""
    model = trained(train_pages)
    types = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = extract_pages(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    chosen = pages.select(column(id_col), column(url_col), column(html_col))
    return chosen.mapInArrow(thrifty(run), f"{ddl_name(id_col)} {types[0]}, {ddl_name(url_col)} {types[1]}, text string, n_chars long")
