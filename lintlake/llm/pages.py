"""Main text of web pages: boosted trees score the nodes of the DOM, and one consistent choice is decoded.

Nodes are block elements; inline markup only parts words from links. A node's features are its tag, attribute
tokens, depth, place among its siblings, and the densities of text, links, paragraphs and punctuation below
it. The trees give the probability that a node belongs to the article or holds it. Decoding picks
the most probable labelling in which a node is kept only if its parent is, so an ancestor and a
descendant never contradict each other. The text is that of the blocks whose nodes are kept.

They are trained on a bounded sample of the given pages, labelled where these mark their article, and on
pages put together here from templates with menus, sidebars, notices, adverts, forms and comments.

Null and empty pages give an empty text. Character references are decoded, white space inside a block
becomes one space, blocks are joined by a line break. Unclosed and stray tags are tolerated: only where HTML
reads plain text to its end (script, style, textarea, title, iframe) does an unclosed tag take the rest of the
page. noscript, template and object are nodes that the trees judge; controls and drawings (svg, select, button, video,
audio, canvas) are left out with what they nest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit

#: Pages of the table that the trees are fitted on at most, chosen by a hash of the id.
TRAIN_PAGES = 300
TEMPLATE_PAGES = 700

#: What stands between a tag's name and its end, read once from left to right: a value in quotes, unless its quote has no
#: mate before the next tag or none that ends a value; a value without; a name. An opening angle ends it.
_REST = r"""(?:[\s/]++|=\s*+"[^"<]*+"|=\s*+"[^"]*+"(?=[\s/>])|=\s*+'[^'<]*+'|=\s*+'[^']*+'(?=[\s/>])|=\s*+[^\s<>]*+|[^\s/=<>]++)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_REST})>|<[!?][^<>]*>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Plain text up to the closing tag, or to the end of the page.
_TEXT = {"script", "style", "textarea", "title", "iframe"}
#: Left out with all they hold if they are closed; a tag that isn't is ignored.
_CONTROLS = {"svg", "select", "button", "video", "audio", "canvas"}
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _TEXT}
_EDGES = {name: re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<text>{'|'.join(sorted(_TEXT))})(?=[\s/>]).*?(?:</(?P=text)(?=[\s/>])|\Z)|<(?P<close>/?){name}(?=[\s/>])(?P<rest>{_REST})>", re.I | re.S) for name in _CONTROLS}
_BLOCKS = {
    "html", "head", "body", "div", "p", "article", "main", "section", "header", "footer", "nav", "aside", "form", "fieldset", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead",
    "tbody", "tr", "td", "th", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "dialog", "hr", "center", "menu",
    "noscript", "template", "object",
}
_VOID = {"hr"}
_CLOSES_P = _BLOCKS - {"td", "th", "tr", "tbody", "thead", "noscript", "template", "object"}
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_TAGS = [
    {"div"}, {"p"}, {"article"}, {"main"}, {"section"}, {"header"}, {"footer"}, {"nav", "menu"}, {"aside"}, {"form", "fieldset"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"},
    {"h1", "h2", "h3", "h4", "h5", "h6"}, {"table", "thead", "tbody", "tr", "td", "th"}, {"blockquote", "pre"}, {"figure", "figcaption"}, {"html", "body"}, {"head"}, {"details", "dialog", "summary", "address"},
]
_WORDS = [
    r"nav|menu|breadcrumb|pagination|pager|toc", r"header|masthead|topbar|logo", r"foot|copyright|colophon|legal", r"side|rail|widget", r"notice|cookie|consent|alert|popup|modal|overlay|newsletter|subscribe|gdpr|toast",
    r"\bads?\b|advert|sponsor|promo|banner|outbrain|taboola|adsense", r"comment|disqus|repl(?:y|ies)|respond|discussion|feedback", r"form|search|login|signup|register", r"content|article|post|entry|main|story|body|text",
    r"share|social|related|recommend|tags?\b|meta|author|byline|more",
]
_WORD_PATTERNS = [re.compile(w) for w in _WORDS]
_SPLIT_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])|[_\-/]+")


#: Flags of side matter and of articles, which descendants inherit.
_OUT_COLUMNS = [k for k, g in enumerate(_TAGS) if g & {"nav", "aside", "footer", "form", "head", "details"}] + [len(_TAGS) + k for k in (0, 2, 3, 4, 5, 6, 7, 9)]
_IN_COLUMNS = [k for k, g in enumerate(_TAGS) if g & {"article", "main"}] + [len(_TAGS) + 8]


def _ends(text: str, name: str) -> dict[int, int]:
    """Where each closed tag of a kind that opens in a page ends, by the end of its opening tag."""
    out, opened = {}, []
    for m in _EDGES[name].finditer(text):
        if m["rest"] is None or m["rest"].endswith("/"):
            continue
        if not m["close"]:
            opened.append(m.end())
        elif opened:
            out[opened.pop()] = m.end()
    return out


class Page:
    """The block nodes of a page in order, and its text blocks with the node each belongs to."""

    __slots__ = ("tags", "parents", "attributes", "blocks", "owners", "links")

    def __init__(self, text: str):
        self.tags, self.parents, self.attributes = ["html"], [-1], [""]
        self.blocks: list[str] = []
        self.owners: list[int] = []
        self.links: list[int] = []
        stack, held, linked, in_link = [0], [], 0, 0
        ends: dict[str, dict[int, int]] = {}
        at, end = 0, len(text)
        match = _TOKEN.match

        def flush() -> None:
            nonlocal linked
            if held:
                words = " ".join(html.unescape("".join(held)).split())
                if words:
                    self.blocks.append(words)
                    self.owners.append(stack[-1])
                    self.links.append(min(linked, len(words)))
                held.clear()
            linked = 0

        def close(upto: int) -> None:
            flush()
            del stack[upto:]

        while at < end:
            m = match(text, at)
            at = m.end()
            plain = m[4]
            if plain is not None:
                held.append(plain)
                linked += len(plain) if in_link else 0
                continue
            name = m[2]
            if name is None:
                continue
            name, closing = name.lower(), m[1]
            if name in _TEXT:
                if not closing and not m[3].endswith("/"):
                    stop = _ENDS[name].search(text, at)
                    at = stop.end() if stop else end
                held.append(" ")
            elif name in _CONTROLS:
                if not closing:
                    if name not in ends:
                        ends[name] = _ends(text, name)
                    at = ends[name].get(at, at)
                held.append(" ")
            elif name == "a":
                in_link = 0 if closing else 1
            elif name not in _BLOCKS:
                if name in ("br", "img", "input", "label", "option"):
                    held.append(" ")
            elif closing:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == name:
                        close(k)
                        break
                in_link = 0
            else:
                flush()
                if name == "html" or (name == "body" and "body" in (self.tags[s] for s in stack)):
                    continue
                if name in _CLOSES_P:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[k]] == "p":
                            close(k)
                            break
                        if self.tags[stack[k]] not in ("p",):
                            break
                mates = _SELF.get(name)
                if mates:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[k]] in mates:
                            close(k)
                            break
                        if self.tags[stack[k]] in ("ul", "ol", "dl", "table", "div", "section", "article"):
                            break
                if name == "body":
                    close(1)
                self.tags.append(name)
                self.parents.append(stack[-1])
                attributes = " ".join(x for a in _ATTRIBUTE.finditer(m[3]) for x in (a[1] if a[1].lower() in ("hidden",) else "", a[2] or a[3] or a[4] or "")) if m[3] else ""
                self.attributes.append(_SPLIT_CASE.sub(" ", attributes).lower())
                if name not in _VOID:
                    stack.append(len(self.tags) - 1)
        flush()


_FLAGS = len(_TAGS) + len(_WORDS)
N_FEATURES = 2 * _FLAGS + 19
_PUNCTUATION = re.compile(r"[.,;:!?]")


def features(page: Page) -> np.ndarray:
    n = len(page.tags)
    parents = page.parents
    chars, links, blocks, marks, paragraphs, below = (np.zeros(n) for _ in range(6))
    for text, owner, link in zip(page.blocks, page.owners, page.links, strict=True):
        chars[owner] += len(text)
        links[owner] += link
        blocks[owner] += 1
        marks[owner] += len(_PUNCTUATION.findall(text))
    depth, children, place = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(1, n):
        p = parents[i]
        depth[i] = depth[p] + 1
        place[i] = children[p]
        children[p] += 1
    own = chars.copy()
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        blocks[p] += blocks[i]
        marks[p] += marks[i]
        paragraphs[p] += paragraphs[i] + (page.tags[i] == "p")
        below[p] += below[i] + 1
    x = np.zeros((n, N_FEATURES), np.float32)
    for i in range(n):
        tag = page.tags[i]
        for k, group in enumerate(_TAGS):
            if tag in group:
                x[i, k] = 1
        words = page.attributes[i]
        if words:
            for k, pattern in enumerate(_WORD_PATTERNS):
                if pattern.search(words):
                    x[i, len(_TAGS) + k] = 1
    parent = np.maximum(np.array(parents), 0)
    x[1:, _FLAGS : 2 * _FLAGS] = x[parent[1:], :_FLAGS]
    total = max(1.0, chars[0])
    hidden = np.array([1.0 if ("hidden" in a or "display:none" in a or "display: none" in a) else 0.0 for a in page.attributes])
    out = x[:, _OUT_COLUMNS].any(axis=1).astype(float)
    inside = x[:, _IN_COLUMNS].any(axis=1).astype(float)
    same = np.zeros(n)
    mates: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        out[i], inside[i] = max(out[i], out[parents[i]]), max(inside[i], inside[parents[i]])
        key = (parents[i], page.tags[i])
        mates[key] = mates.get(key, 0) + 1
    for i in range(1, n):
        same[i] = mates[(parents[i], page.tags[i])]
    density = links / np.maximum(chars, 1)
    x[:, 2 * _FLAGS :] = np.column_stack(
        [
            depth, place, children[parent], np.log1p(chars), chars / total, density, paragraphs, below, chars / (below + 1), marks / np.maximum(chars, 1),
            own / np.maximum(chars, 1), hidden, blocks, out, inside, same, chars[parent] / total, paragraphs[parent], density[parent],
        ]
    )
    return x


def decode(parents: list[int], probability: np.ndarray) -> np.ndarray:
    """Which nodes are kept in the most probable labelling where no kept node has a dropped parent."""
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p), np.log(1 - p)
    for i in range(len(parents) - 1, 0, -1):
        keep[parents[i]] += max(keep[i], drop[i])
        drop[parents[i]] += drop[i]
    kept = np.zeros(len(parents), bool)
    kept[0] = True
    for i in range(1, len(parents)):
        kept[i] = kept[parents[i]] and keep[i] > drop[i]
    return kept


_OUT_TAGS = {"nav", "aside", "footer", "form", "head", "menu", "dialog"}
_OUT_WORDS = re.compile("|".join(_WORDS[k] for k in (0, 2, 3, 4, 5, 6, 7)))


def marked_labels(page: Page) -> np.ndarray | None:
    """Labels of a page that marks its article by a tag: inside it but for side matter, and what holds it. None if it has none."""
    n = len(page.tags)
    top = [i for i in range(n) if page.tags[i] == "article"] or [i for i in range(n) if page.tags[i] == "main"]
    if not top:
        return None
    label = np.zeros(n)
    for i in range(1, n):
        inside = i == top[0] or label[page.parents[i]] == 1
        label[i] = inside and page.tags[i] not in _OUT_TAGS and not (i != top[0] and _OUT_WORDS.search(page.attributes[i]))
    i = page.parents[top[0]]
    while i >= 0:
        label[i] = 1
        i = page.parents[i]
    return label


def template_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A made-up page and the texts of its article's blocks."""
    letters = "abcdefghijklmnopqrstuvwxyzäéñ"
    number = iter(range(10**6))
    word = lambda: "".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(2, 9)))
    pick = lambda *options: options[rng.integers(len(options))]

    def sentence(low: int = 4, high: int = 16) -> str:
        return " ".join(word() for _ in range(rng.integers(low, high))).capitalize() + f" {next(number)}" + pick(".", ".", "!", "?")

    prose = lambda: " ".join(sentence() for _ in range(rng.integers(1, 6)))
    links = lambda n: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
    good: set[str] = set()

    def kept(tag: str, text: str) -> str:
        good.add(text)
        return f"<{tag}>{text}</{tag}>" if rng.random() < 0.85 or tag != "p" else f"<{tag}>{text}"

    menu = f'<{(t := pick("nav", "div", "ul"))} class="{pick("menu", "nav", "navbar", "breadcrumbs")}"><ul>{links(int(rng.integers(3, 9)))}</ul></{t}>'
    header = f'<{(t := pick("header", "div"))} class="{pick("header", "masthead", "site-header", "top-bar")}"><div class="logo">{word()}</div>{pick("", "<p>" + sentence() + "</p>")}</{t}>'
    footer = f'<{(t := pick("footer", "div"))} class="{pick("footer", "site-footer", "copyright")}"><p>&copy; {word()} &middot; {prose()}</p>{pick("", "<ul>" + links(4) + "</ul>")}</{t}>'
    side = lambda: f'<{(t := pick("aside", "div"))} class="{pick("sidebar", "side", "widget", "related", "right-rail")}"><h3>{word()}</h3>{pick("<ul>" + links(5) + "</ul>", "<p>" + prose() + "</p>")}</{t}>'
    notice = lambda: f'<div class="{pick("notice", "cookie-notice", "cookie-banner", "alert", "consent", "newsletter", "popup")}"{pick("", " role=alert")}>{pick("<p>" + prose() + "</p>", prose())}</div>'
    advert = lambda: f'<div class="{pick("ad", "ads", "advert", "sponsored", "ad-slot", "promo")}">{pick(sentence(), "<p>" + prose() + "</p>")}</div>'
    form = lambda: f'<form class="{pick("", "search", "login")}"><label>{word()}</label><input name="q"><p>{sentence()}</p><button>{word()}</button></form>'
    comment = lambda: f'<{(t := pick("div", "li", "article"))} class="{pick("comment", "reply", "comment-item")}"><b>{word()}</b><p>{prose()}</p></{t}>'
    comments = f'<{(t := pick("section", "div"))} {pick("id", "class")}="{pick("comments", "comment-list", "discussion", "responses", "disqus")}"><h2>{word()}</h2>{"".join(comment() for _ in range(rng.integers(1, 6)))}{pick("", form())}</{t}>'
    inner = [kept("h1", sentence())]
    for _ in range(rng.integers(2, 12)):
        kind = rng.random()
        if kind < 0.72:
            inner.append(kept("p", prose()))
        elif kind < 0.8:
            inner.append(kept(pick("h2", "h3"), sentence(2, 6)))
        elif kind < 0.88:
            inner.append("<ul>" + "".join(kept("li", sentence()) for _ in range(rng.integers(2, 6))) + "</ul>")
        elif kind < 0.94:
            inner.append("<blockquote>" + kept("p", prose()) + "</blockquote>")
        else:
            inner.append(pick(advert, notice, side, form)())
    text = "".join(inner)
    if rng.random() < 0.4:
        text = f'<div class="{pick("entry-content", "post-body", "article-text", "text", "")}">{text}</div>'
    if rng.random() < 0.25:
        text += comments
        comments = ""
    shell = pick(("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="article"'), ("section", ' class="story"'), ("div", ""))
    text = f"<{shell[0]}{shell[1]}>{text}</{shell[0]}>"
    extra = [x() for x in (side, notice, advert, form) if rng.random() < 0.45]
    before = [x for x in extra if rng.random() < 0.5]
    after = [x for x in extra if x not in before]
    body = [header if rng.random() < 0.6 else "", menu, *before, text, comments if rng.random() < 0.5 else "", *after, footer]
    wrapped = "".join(body) if rng.random() < 0.6 else f'<div class="{pick("wrapper", "page", "container")}">{"".join(body)}</div>'
    return f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{}}</style></head><body>{wrapped}</body></html>", good


def template_labels(page: Page, good: set[str]) -> np.ndarray:
    """1 for nodes that hold a block of the article, itself or below."""
    label = np.zeros(len(page.tags))
    for text, owner in zip(page.blocks, page.owners, strict=True):
        if text in good:
            while owner >= 0:
                label[owner] = 1
                owner = page.parents[owner]
    return label


def train(pages: DataFrame, max_pages: int = TRAIN_PAGES) -> Trees:
    """Trees from a bounded sample of the table and a fixed number of template pages."""
    chosen = pages.where(F.col("html").isNotNull()).select(F.xxhash64("page_id", "html").alias("h")).orderBy("h").limit(max_pages)
    sample = pages.select(F.xxhash64("page_id", "html").alias("h"), "html").join(F.broadcast(chosen.distinct()), "h").dropDuplicates(["h"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(text)
                labels = marked_labels(page)
                if labels is not None:
                    out.append((h, labels.tolist(), features(page).ravel().tolist()))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float32())), strict=True)], names=["h", "y", "x"])

    rows = sorted(sample.mapInArrow(label, "h long, y array<double>, x array<float>").collect(), key=lambda r: r["h"])
    x, y = [np.array(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows], [np.array(r["y"]) for r in rows]
    rng = np.random.default_rng(4)
    for _ in range(TEMPLATE_PAGES):
        text, good = template_page(rng)
        page = Page(text)
        x.append(features(page))
        y.append(template_labels(page, good))
    return fit(np.concatenate(x), np.concatenate(y), trees=40, depth=5, bins=32, rate=0.25)


def main_text(page: Page, kept: np.ndarray) -> str:
    return "\n".join(b for b, owner in zip(page.blocks, page.owners, strict=True) if kept[owner])


def extract(pages: DataFrame, max_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    trees = train(pages, max_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                parsed = [Page(t or "") for t in part.column("html").to_pylist()]
                x = [features(p) for p in parsed]
                probability = trees.probability(np.concatenate(x))
                texts, at = [], 0
                for page, rows in zip(parsed, x, strict=True):
                    texts.append(main_text(page, decode(page.parents, probability[at : at + len(rows)])))
                    at += len(rows)
                yield pa.record_batch(
                    {"page_id": part.column("page_id").cast(pa.int64()), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
