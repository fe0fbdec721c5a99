"""Main text of HTML pages by a tree-structured graphical model.

Every block element of the DOM is a binary variable (content or not) with a log-linear potential of its own tag,
attribute words, text and links, and a potential with its parent; sum-product messages upward and downward give exact
marginals. The parameters are the gradient ascent of the labelled pages' conditional likelihood under the same messages.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import table, text_of

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose insides are never text of a page.
SILENT = frozenset("script style noscript template iframe svg math canvas audio video object textarea title head select datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])))*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
FEATURES = 1 << 13
THRESHOLD = 0.5


@dataclass
class Dom:
    """Block elements in page order (a parent precedes its children), and the runs of text in page order."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)


def parse(html: str) -> Dom:
    """A forgiving parse: unclosed and stray tags, truncated pages, raw-text elements, implied ends."""
    dom, lower = Dom(["html"], [-1], [""], [], [0]), html.lower()
    tags, parents, attrs, link_chars = dom.tags, dom.parents, dom.attrs, dom.link_chars
    stack, held, silent, in_link, at, end = [0], [], 0, False, 0, len(html)
    silent_tag, opened, unclosed = "", 0, set()

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                dom.runs.append((stack[-1], text))
            held.clear()

    def text(piece: str) -> None:
        if "&" in piece:
            piece = unescape(piece)
        held.append(piece)
        if in_link:
            link_chars[stack[-1]] += len(piece)

    search = TAG.search
    while at < end or silent:
        m = search(html, at)
        if m is None and silent:  # never closed: back to where it began, and from now on the first end tag of its name counts
            unclosed.add(silent_tag)
            silent, at = 0, opened
            continue
        if m is None:
            text(html[at:])
            break
        if m.start() > at and not silent:
            text(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attr = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if at == end and html[-1] != ">":  # a tag that the page's end cuts off
            if silent:
                continue
            break
        if silent:
            if name == silent_tag:
                silent += -1 if closing else (not attr.endswith("/") and name not in unclosed)
            continue
        if name in SILENT:
            if closing:
                continue
            if name in RAW:
                close = re.compile(rf"</{name}[^a-zA-Z0-9]", re.I).search(html, at)
                if close is None:
                    break
                at = html.find(">", close.end() - 1) + 1 or end
            elif name == "head":  # ends at its end tag or at the first block
                continue
            elif not attr.endswith("/") and (name not in unclosed or lower.find(f"</{name}", at) >= 0):
                silent, silent_tag, opened = 1, name, at
            continue
        if name not in BLOCKS:
            if name == "a":
                in_link = not closing
            elif name == "br":
                held.append(" ")
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == name:
                    del stack[k:]
                    break
                if tags[stack[k]] in ("td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if name in ("html", "hr"):
            continue
        if name == "body":
            if len(stack) == 1 and attr:
                attrs[0] = attr
            continue
        if tags[stack[-1]] == "p" or (name[0] == "h" and name[1:].isdigit() and tags[stack[-1]][0] == "h" and tags[stack[-1]][1:].isdigit()):
            stack.pop()
        if name in CLOSES:
            same, bound = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                t = tags[stack[k]]
                if t in bound:
                    break
                if t in same and not any(tags[x] in bound for x in stack[k + 1 :]):
                    del stack[k:]
                    if name not in ("tr", "tbody", "tfoot"):
                        break
        tags.append(name)
        parents.append(stack[-1])
        attrs.append(attr)
        link_chars.append(0)
        stack.append(len(tags) - 1)
    flush()
    return dom


def _level(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


@lru_cache(maxsize=200_000)
def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


@lru_cache(maxsize=50_000)
def _named(tag: str, parent: str, attr: str) -> tuple[int, ...]:
    """Features of the tag, its parent's and the words of class, id and role."""
    out = [f"t={tag}", f"t={tag}<{parent}"]
    for m in ATTR.finditer(attr):
        for w in PART.findall(m[2] or m[3] or m[4] or ""):
            out += [f"w={w.lower()}", f"w4={w.lower()[:5]}"]
    return tuple(_hash(x) for x in dict.fromkeys(out))


def node_features(dom: Dom) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """For every node, its features by name and by text."""
    n = len(dom.tags)
    chars = [0] * n
    for i, text in dom.runs:
        chars[i] += len(text)
    total, links = chars[:], dom.link_chars[:]
    for i in range(n - 1, 0, -1):
        total[dom.parents[i]] += total[i]
        links[dom.parents[i]] += links[i]
    out = []
    for i, tag in enumerate(dom.tags):
        own = _level(chars[i], (1, 15, 40, 100, 250))
        near = _level(dom.link_chars[i] / chars[i] if chars[i] else 0, (0.05, 0.4, 0.8))
        sub = _level(links[i] / total[i] if total[i] else 0, (0.05, 0.3, 0.6, 0.9))
        size = _level(total[i], (1, 60, 300, 1500))
        by_text = (_hash(f"own={own},{near}"), _hash(f"sub={size},{sub}"), _hash(f"kind={tag},{own > 2},{near > 1}"))
        out.append((_named(tag, dom.tags[dom.parents[i]] if i else "", dom.attrs[i]), by_text))
    return out


#: The parent-child tables: one for children that are containers, one for those that hold text themselves.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li pre td th dd dt figcaption blockquote".split())


@dataclass
class Model:
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    edges: list[list[list[float]]] = field(default_factory=lambda: [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)])

    def unary(self, feats: list[tuple[tuple[int, ...], tuple[int, ...]]]) -> list[float]:
        w = self.weights
        return [sum([w[k] for k in a]) + sum([w[k] for k in b]) for a, b in feats]


def marginals(model: Model, dom: Dom, unary: list[float], pairs: bool = False):
    """P(content) of each node, by one upward and one downward pass; with ``pairs`` also each edge's joint 2 x 2 table."""
    n, parents, tags = len(dom.tags), dom.parents, dom.tags
    tables = [[[math.exp(x) for x in row] for row in t] for t in model.edges]
    kind = [tables[t in TEXT_TAGS] for t in tags]
    up0, up1 = [1.0] * n, [1.0] * n  # product of the children's messages, with the node's own potential
    m0, m1 = [1.0] * n, [1.0] * n  # the message to the parent
    for i in range(n - 1, -1, -1):
        p = math.exp(max(-30.0, min(30.0, unary[i])))
        a, b = up0[i], up1[i] * p
        s = a + b
        a, b = a / s, b / s
        up0[i], up1[i] = a, b
        if i:
            t = kind[i]
            x, y = t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b
            s = x + y
            m0[i], m1[i] = x / s, y / s
            q = parents[i]
            up0[q] *= m0[i]
            up1[q] *= m1[i]
            s = up0[q] + up1[q]
            up0[q] /= s
            up1[q] /= s
    out, d0, d1, joint = [0.0] * n, [1.0] * n, [1.0] * n, [None] * n
    for i in range(n):
        a, b = up0[i] * d0[i], up1[i] * d1[i]
        if i:
            q, t = parents[i], kind[i]
            # the parent's belief without this child's message
            x, y = d0[q] * up0[q] / m0[i], d1[q] * up1[q] / m1[i]
            d0[i], d1[i] = x * t[0][0] + y * t[1][0], x * t[0][1] + y * t[1][1]
            s = d0[i] + d1[i]
            d0[i], d1[i] = d0[i] / s, d1[i] / s
            a, b = up0[i] * d0[i], up1[i] * d1[i]
            if pairs:
                j = [[x * t[0][0] * up0[i], x * t[0][1] * up1[i]], [y * t[1][0] * up0[i], y * t[1][1] * up1[i]]]
                s = sum(map(sum, j))
                joint[i] = [[v / s for v in row] for row in j]
        out[i] = b / (a + b)
    return (out, joint) if pairs else out


def fit(pages: list[tuple[str, set[str]]], epochs: int = 10, rate: float = 0.25, decay: float = 1e-4, seed: int = 1) -> Model:
    """Stochastic gradient ascent of the labelled pages' log-likelihood. A label: the ``data-c`` marks of content nodes."""
    rng, model = random.Random(seed), Model()
    known = []
    for html, _ in pages:
        dom = parse(html)
        labels = [int('data-c="1"' in a) for a in dom.attrs]
        for i in range(len(labels) - 1, 0, -1):  # what holds content counts as content: nothing below a rejected element is kept
            labels[dom.parents[i]] |= labels[i]
        known.append((dom, node_features(dom), labels))
    for e in range(epochs):
        rng.shuffle(known)
        lr = rate * (1 - e / (epochs + 1))
        for dom, feats, labels in known:
            got, joint = marginals(model, dom, model.unary(feats), True)
            w = model.weights
            for (a, b), y, p in zip(feats, labels, got, strict=True):
                step = lr * (y - p)
                if abs(step) > 1e-4:
                    for k in (*a, *b):
                        w[k] += step - lr * decay * w[k]
            for i in range(1, len(labels)):
                t, j = model.edges[dom.tags[i] in TEXT_TAGS], joint[i]
                for s in (0, 1):
                    for r in (0, 1):
                        t[s][r] += 0.1 * lr * ((labels[dom.parents[i]] == s and labels[i] == r) - j[s][r])
    return model


def labelled_pages(n: int = 400, seed: int = 9) -> list[tuple[str, set[str]]]:
    """Generated pages of many layouts, whose content elements carry data-c="1" (an attribute that is no feature)."""
    rng = random.Random(seed)
    syllables = "ba co di en fu ga hi jo ka le mi no or pe qui ra sto tu un ve wi ya zo the an ing ter ment".split()

    def words(lo: int, hi: int, end: str = "") -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(lo, hi))).capitalize() + end

    def prose(lo: int = 1, hi: int = 6) -> str:
        return " ".join(words(3, 22, rng.choice("....!?")) for _ in range(rng.randint(lo, hi)))

    def named(*names: str) -> str:
        name = rng.choice(names)
        name = rng.choice([name, name, f"{name}-{rng.choice(['box', 'wrap', 'area', 'inner', 'block', 'list'])}", f"site-{name}", f"{name} {rng.choice(['wide', 'x1', 'dark', 'clearfix', 'col'])}"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def links(lo: int = 3, hi: int = 9) -> str:
        items = [f'<a href="/x">{words(1, 3)}</a>' for _ in range(rng.randint(lo, hi))]
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}" + rng.choice(["</li>", "</li>", ""]) for i in items) + "</ul>"
        return rng.choice([" | ", " "]).join(items)

    c = ' data-c="1"'

    def piece() -> str:
        r = rng.random()
        if r < 0.66:
            t = prose() if rng.random() < 0.85 else words(1, 6, ".")
            if rng.random() < 0.15:
                t = "<b>" + t + rng.choice(["</b>", ""])
            if rng.random() < 0.12:
                t = t.replace(" ", f' <a href="/y">{words(1, 3)}</a> ', 1)
            return f"<p{c}>{t}" + rng.choice(["</p>", "</p>", "</p>", ""])
        if r < 0.78:
            return f"<h{rng.randint(2, 4)}{c}>{words(1, 7)}</h2>".replace("</h2>", "") + f"</h{rng.randint(2, 4)}>"
        if r < 0.86:
            k = rng.choice(["ul", "ol"])
            return f"<{k}{c}>" + "".join(f"<li{c}>{words(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + f"</{k}>"
        if r < 0.9:
            return f"<blockquote{c}><p{c}>{prose(1, 2)}</p></blockquote>"
        if r < 0.94:
            return f"<table{c}><tr{c}><th{c}>{words(1, 2)}</th><td{c}>{words(1, 4)}</td></tr></table>"
        if r < 0.97:
            return f"<pre{c}>{words(3, 20)}</pre>"
        return f"<figure{c}><img src=x><figcaption{c}>{words(3, 10, '.')}</figcaption></figure>"

    def inset() -> str:
        return rng.choice([advert, share, related, signup, notice])()

    def advert() -> str:
        return f"<{'div'}{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner-ad', 'adsense', 'sponsor')}>{rng.choice([prose(1, 2), words(2, 8), '<p>' + prose(1, 2) + '</p>'])}</div>"

    def share() -> str:
        return f"<div{named('share', 'social', 'sharing', 'follow')}>{links(2, 5)}</div>"

    def related() -> str:
        return f"<{rng.choice(['div', 'aside', 'section'])}{named('related', 'recommended', 'more-stories', 'popular', 'trending')}><h3>{words(1, 3)}</h3>{links(3, 6)}</div>"

    def signup() -> str:
        return f"<form{rng.choice(['', named('newsletter', 'signup', 'search', 'login', 'subscribe', 'contact')])}><label>{words(1, 4)}</label><input name=q><p>{words(3, 12, '.')}</p><button>{words(1, 2)}</button></form>"

    def notice() -> str:
        return f"<{rng.choice(['div', 'section', 'aside'])}{named('cookie', 'consent', 'notice', 'alert', 'gdpr', 'privacy', 'banner', 'warning', 'popup', 'modal', 'disclaimer')}><p>{prose(1, 3)}</p></div>"

    def menu() -> str:
        return rng.choice([f"<nav{rng.choice(['', named('nav', 'main-nav')])}>{links()}</nav>", f"<div{named('menu', 'nav', 'navbar', 'navigation', 'breadcrumb', 'breadcrumbs', 'topbar', 'toolbar')}>{links()}</div>"])

    def header() -> str:
        inside = rng.choice([f"<h1>{words(1, 3)}</h1><p>{words(2, 8)}</p>", f'<a href="/">{words(1, 2)}</a>', f"<p>{prose(1, 1)}</p>", words(1, 5)]) + rng.choice(["", menu()])
        return rng.choice([f"<header{rng.choice(['', named('header', 'masthead')])}>{inside}</header>", f"<div{named('header', 'masthead', 'logo', 'top')}>{inside}</div>"])

    def footer() -> str:
        inside = rng.choice([f"&copy; {words(1, 2)} &middot; {prose(1, 1)}", f"<p>{prose(1, 2)}</p>{links(2, 5)}", words(2, 9)])
        return rng.choice([f"<footer{rng.choice(['', named('footer')])}>{inside}</footer>", f"<div{named('footer', 'copyright', 'legal', 'colophon', 'bottom')}>{inside}</div>"])

    def sidebar() -> str:
        inside = "".join(rng.choice([f"<div{named('widget', 'box')}><h3>{words(1, 3)}</h3>{links()}</div>", f"<p>{prose(1, 3)}</p>", related(), advert()]) for _ in range(rng.randint(1, 3)))
        return rng.choice([f"<aside{rng.choice(['', named('sidebar')])}>{inside}</aside>", f"<div{named('sidebar', 'widget', 'rail', 'secondary', 'side')}>{inside}</div>"])

    def comments() -> str:
        one = lambda: rng.choice([f"<div{named('comment', 'reply')}><span>{words(1, 2)}</span><p>{prose(1, 4)}</p></div>", f"<li{named('comment', 'reply')}><p>{prose(1, 3)}</p></li>", f"<article{named('comment', 'reply')}><p>{prose(1, 4)}</p></article>", f"<p>{prose(1, 4)}</p>"])
        inside = f"<h3>{words(1, 2)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5)))
        return f"<{rng.choice(['section', 'div', 'ol', 'ul', 'aside'])}{named('comments', 'comment', 'discussion', 'responses', 'disqus', 'replies', 'feedback', 'commentlist')}>{inside}</div>"

    out = []
    for _ in range(n):
        body = "".join(piece() for _ in range(rng.choice([rng.randint(1, 9), rng.randint(5, 40)])))
        if rng.random() < 0.25:
            body += inset() + "".join(piece() for _ in range(rng.randint(0, 4)))
        title = f"<h1{c}>{words(2, 14)}</h1>"
        if rng.random() < 0.15:
            title = f"<header{c}>{title}</header>"
        wrap = rng.choice(["article", "article", "article", "main", "main>article", "div", "div", "section", "none"])
        names = rng.choice(["", named("content", "main", "post", "entry", "article", "story", "body", "text", "main-content", "article-body", "post-content", "entry-content"), named("content", "post", "article"), f' class="c{rng.randint(1, 99)}"'])
        if wrap == "none":
            body = title + body
        elif rng.random() < 0.8:
            tags = wrap.split(">")
            body = "".join(f"<{t}{names}{c}>" for t in tags) + title + body + "".join(f"</{t}>" for t in reversed(tags))
        else:
            t = wrap.split(">")[0]
            body = title + f"<{t}{names}{c}>" + body + f"</{t}>"
        if rng.random() < 0.3:
            comment = comments()
            body = body[: body.rfind("</")] + comment + body[body.rfind("</") :] if rng.random() < 0.4 and wrap != "none" else body + comment
        before = "".join(f() for f, p in ((notice, 0.25), (header, 0.6), (menu, 0.7), (advert, 0.4), (signup, 0.2)) if rng.random() < p)
        after = "".join(f() for f, p in ((sidebar, 0.45), (related, 0.2), (share, 0.2), (advert, 0.2), (signup, 0.2), (footer, 0.8), (notice, 0.1)) if rng.random() < p)
        if rng.random() < 0.2:
            body = f"<div{rng.choice(['', named('wrapper', 'container', 'page', 'row')])}>{body}</div>"
        out.append((f"<html><head><title>{words(1, 4)}</title></head><body>{before}{body}{after}</body></html>", set()))
    return out


@lru_cache(maxsize=1)
def trained() -> Model:
    return fit(labelled_pages())


def extract(html: str, model: Model, threshold: float = THRESHOLD) -> str:
    """The page's content blocks, white space inside each made one space, joined by a line end."""
    dom = parse(html)
    if not dom.runs:
        return ""
    p = marginals(model, dom, model.unary(node_features(dom)))
    return "\n".join(t for i, t in dom.runs if p[i] >= threshold)


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from the whole html.

    A null or empty html gives an empty text; repeated rows and null ids stay; an empty table gives an empty one; other
    columns are ignored. A page is a row's own work: nothing is shuffled.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py(), model) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
