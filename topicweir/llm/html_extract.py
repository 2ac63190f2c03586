"""Main text of web pages by gradient-boosted trees over the nodes of their element trees.

Every block-level element is a node with features of its subtree (text, link and tag density),
its attribute tokens, its depth and its siblings. Boosted trees give each node the log-odds that
it belongs to the main text. Decoding is hierarchical: a node can be kept only if its parent is,
and the set of nodes with the greatest total is found by dynamic programming over the tree, so
no ancestor contradicts its descendants.

No labels come with the pages. The trees are fitted on pages laid out here from texts of a
bounded sample of the given pages, in many arrangements of known parts, and on those sampled
pages whose own elements tell their parts (article, nav, footer and the like).
"""

import html as entities
import random
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from topicweir.llm.boosting import Boosted, boost

SAMPLE_PAGES = 200
LAID_OUT = 500
LEAST_ODDS = 6.0  # log-odds are cut off there, so that no single node outweighs a page
BODY_CHARS = 200_000  # of a sampled page, for fitting only

# How elements behave by the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
SILENT = RAW | set("head svg select option button canvas object audio video map datalist".split())
BLOCK = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "thead": set(),
}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}}

# Attribute tokens by what they usually name.
TOKENS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar tabs pagination pager skip toc sitemap links".split(),
    "header": "header masthead banner logo branding hero topper".split(),
    "footer": "footer foot copyright legal colophon imprint credits bottom".split(),
    "side": "sidebar side aside rail widget widgets related recommended recommendation more trending popular teaser archive archives tagcloud tags".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay warning message notification paywall toast disclaimer".split(),
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense outbrain taboola commercial banner-ad".split(),
    "form": "form newsletter subscribe subscription signup signin login register search searchbox contact input".split(),
    "comment": "comment comments commentlist reply replies respond disqus discussion discuss thread responses reviews feedback guestbook".split(),
    "share": "share sharing social follow like facebook twitter buttons byline author bio meta".split(),
    "content": "article content main post body entry story text page maincontent articlebody prose hentry markdown".split(),
}
_KIND_OF = {t: k for k, ts in TOKENS.items() for t in ts}
_KINDS = list(TOKENS)

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)>|<[a-zA-Z/][^>]*(?:>|$)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|aria-label|data-component)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|\bhidden\b|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Element tree of a page: block-level nodes in page order, and its text blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kinds, self.hidden, self.marks = ["#"], [-1], [()], [False], [None]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters inside links
        self.tags_in = [0]  # inline tags of each node
        stack = [0]
        pieces: list[tuple[str, bool]] = []
        links = 0
        silent: list[str] = []  # open elements whose text is never shown
        at = 0

        def flush():
            nonlocal pieces
            if pieces:
                text = " ".join("".join(p for p, _ in pieces).split())
                if text:
                    inside = sum(len(" ".join(p.split())) for p, link in pieces if link)
                    self.blocks.append((stack[-1], text, min(inside, len(text))))
                pieces = []

        end = len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            upto = m.start() if m else end
            if upto > at and not silent:
                piece = source[at:upto]
                pieces.append((entities.unescape(piece) if "&" in piece else piece, links > 0))
            if not m:
                break
            at = m.end()
            closing, opening = m[1], m[2]
            if opening:
                tag = opening.lower()
                if tag in RAW:
                    close = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                    at = close.start() if close else end
                    if close:
                        after = source.find(">", at)
                        at = after + 1 if after >= 0 else end
                    continue
                if m[3].endswith("/") and tag not in BLOCK:
                    continue
                if tag in SILENT:
                    if tag not in VOID:
                        silent.append(tag)
                elif tag == "br":
                    pieces.append((" ", False))
                    self.tags_in[stack[-1]] += 1
                elif tag in BLOCK:
                    if tag == "body":
                        silent.clear()
                    flush()
                    if tag not in ("html", "body") and self.tag[stack[-1]] == "p":
                        stack.pop()
                    if tag in CLOSES:
                        scope = SCOPE.get(tag, {"table"})
                        for i in range(len(stack) - 1, 0, -1):
                            if self.tag[stack[i]] in scope:
                                break
                            if self.tag[stack[i]] in CLOSES[tag]:
                                del stack[i:]
                                if tag not in ("tr", "tbody", "tfoot"):
                                    break
                    self._open(tag, m[3], stack)
                    if tag == "hr":
                        stack.pop()
                elif tag == "a":
                    links += 1
                    self.tags_in[stack[-1]] += 1
                else:
                    self.tags_in[stack[-1]] += 1
            elif closing:
                tag = closing.lower()
                if tag in SILENT:
                    if tag in silent:
                        del silent[len(silent) - 1 - silent[::-1].index(tag) :]
                elif tag == "a":
                    links = max(0, links - 1)
                elif tag in BLOCK:
                    flush()
                    links = 0 if tag not in ("p", "li") else links
                    for i in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[i]] == tag:
                            del stack[i:]
                            break
        flush()

    def _open(self, tag: str, attributes: str, stack: list[int]):
        kinds, mark = (), None
        if "=" in attributes:
            found = []
            for a in _ATTR.finditer(attributes):
                value = a[2] or a[3] or a[4] or ""
                for token in value.split():
                    whole = token.lower()
                    if whole in _KIND_OF:
                        found.append(_KIND_OF[whole])
                    else:
                        found += [_KIND_OF[p] for p in map(str.lower, _SPLIT.findall(token)) if p in _KIND_OF]
                if a[1].lower() == "data-component":
                    mark = value
            kinds = tuple(found)
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.kinds.append(kinds)
        self.hidden.append(bool(attributes) and bool(_HIDDEN.search(attributes)))
        self.marks.append(mark)
        self.tags_in.append(0)
        stack.append(len(self.tag) - 1)


_TAG_GROUPS = [
    {"nav", "menu"}, {"header", "hgroup"}, {"footer", "address"}, {"aside", "dialog"}, {"form", "fieldset", "search"},
    {"article"}, {"main"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "pre", "blockquote"}, {"li", "dd", "dt"},
    {"ul", "ol", "dl"}, {"table", "tbody", "tr", "td", "th"}, {"figure", "figcaption"}, {"div", "section"},
]
_GROUP_OF = {t: i for i, ts in enumerate(_TAG_GROUPS) for t in ts}
_INSIDE = [0, 1, 2, 3, 4, 5, 6]  # tag groups whose presence above a node is a feature


def _forest(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent (-1 for roots) and depth of all nodes of some pages, one page after another, and their first nodes."""
    first = np.cumsum([0, *(len(p.tag) for p in pages)])
    parent, depth = [], []
    for start, page in zip(first.tolist(), pages):
        own = [0] * len(page.tag)
        for i, p in enumerate(page.parent[1:], 1):
            own[i] = own[p] + 1
        depth += own
        parent += [-1, *(p + start for p in page.parent[1:])]
    return np.array(parent, dtype=np.int64), np.array(depth, dtype=np.int64), first


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth, without the roots, the deepest last."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1)))[1:]


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of each page: subtree, attribute, depth and sibling statistics."""
    parent, depth, first = _forest(pages)
    n = len(parent)
    own = np.zeros((n, 9))  # text, link text, blocks, sentence marks, words, tags, paragraphs, list items, headings
    siblings, index, before = [0] * n, [0] * n, [0.0] * n
    kinds = np.zeros((n, len(_KINDS)))
    for start, page in zip(first.tolist(), pages):
        for i, ks in enumerate(page.kinds):
            for k in ks:
                kinds[start + i, _KINDS.index(k)] += 1
        for i, p in enumerate(page.parent[1:], 1):
            index[start + i] = siblings[start + p]
            siblings[start + p] += 1
        seen, at, blocks = 0, 0, page.blocks
        for i in range(len(page.tag)):
            while at < len(blocks) and blocks[at][0] < i:
                seen += len(blocks[at][1])
                at += 1
            before[start + i] = seen
    rows = [(s + node, len(t), inside, 1, t.count(".") + t.count(",") + t.count("?") + t.count("!"), t.count(" ") + 1)
            for s, page in zip(first.tolist(), pages) for node, t, inside in page.blocks]
    if rows:
        table = np.array(rows)
        np.add.at(own[:, :5], table[:, 0], table[:, 1:])
    group = np.array([_GROUP_OF.get(t, -1) for page in pages for t in page.tag])
    own[:, 5] = 1 + np.array([t for page in pages for t in page.tags_in])
    own[:, 6], own[:, 7], own[:, 8] = group == 8, group == 9, group == 7
    sub = own.copy()
    levels = _levels(depth)
    for level in reversed(levels):
        np.add.at(sub, parent[level], sub[level])
    hidden = np.array([h for page in pages for h in page.hidden], dtype=float)
    over_kinds, over_tags = np.zeros((n, len(_KINDS))), np.zeros((n, len(_INSIDE)))
    marks = np.stack([group == g for g in _INSIDE], 1)
    for level in levels:
        up = parent[level]
        over_kinds[level] = over_kinds[up] + (kinds[up] > 0)
        over_tags[level] = over_tags[up] + marks[up]
        hidden[level] = np.maximum(hidden[level], hidden[up])
    total = np.maximum(1.0, np.repeat(sub[first[:-1], 0], np.diff(first)))
    siblings, index = np.array(siblings, dtype=float), np.array(index, dtype=float)
    around = np.where(parent >= 0, siblings[parent], 0)
    text = np.maximum(1, sub[:, 0])
    columns = [
        np.log1p(sub[:, 0]), sub[:, 0] / total, sub[:, 1] / text, sub[:, 0] / sub[:, 5], np.log1p(sub[:, 2]), sub[:, 3] / text * 100,
        sub[:, 0] / np.maximum(1, sub[:, 2]), np.log1p(own[:, 0]), own[:, 1] / np.maximum(1, own[:, 0]), np.log1p(sub[:, 4]),
        np.log1p(sub[:, 6]), np.log1p(sub[:, 7]), sub[:, 8], depth, around, index / np.maximum(1, around), np.array(before) / total, hidden,
    ]
    tags = np.stack([group == g for g in range(len(_TAG_GROUPS))], 1).astype(float)
    return np.concatenate([np.stack(columns, 1), tags, kinds, over_kinds, over_tags], axis=1)


def decode(pages: list[Page], score: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the sets closed under parents with the greatest sum of scores kept less scores dropped.

    Roots are always kept.
    """
    parent, depth, _ = _forest(pages)
    dropped, best = -score, score.copy()
    levels = _levels(depth)
    for level in reversed(levels):
        np.add.at(dropped, parent[level], dropped[level])
        np.add.at(best, parent[level], np.maximum(best[level], dropped[level]))
    keep = parent < 0
    for level in levels:
        keep[level] = keep[parent[level]] & (best[level] > dropped[level])
    return keep


def main_text(page: Page, keep: np.ndarray) -> str:
    return "\n".join(text for node, text, _ in page.blocks if keep[node])


# --- fitting ------------------------------------------------------------------------------


def _weak_labels(page: Page) -> np.ndarray | None:
    """Labels of a page whose elements tell its parts; None if they do not."""
    group = [_GROUP_OF.get(t, -1) for t in page.tag]
    if 5 not in group and 6 not in group:
        return None
    n = len(group)
    inside, out = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for i in range(1, n):
        p = page.parent[i]
        off = any(k not in ("content", "share", "header") for k in page.kinds[i])
        out[i] = out[p] or group[i] in (0, 2, 3, 4) or off
        inside[i] = inside[p] or group[i] in (5, 6)
    good = inside & ~out
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] |= good[i]
    return good


def lay_out(rng: random.Random, sentences: list[str]) -> tuple[str, str]:
    """A page in one of many arrangements and its main text; `data-component` marks what is not main text."""

    def text(low, high):
        return " ".join(rng.choice(sentences) for _ in range(rng.randint(low, high)))

    def words(n):
        return " ".join(text(1, 2).split()[:n])

    main: list[str] = []

    def keep(tag, value):
        main.append(" ".join(value.split()))
        return f"<{tag}>{entities.escape(value)}</{tag}>"

    def name(kind):
        token = rng.choice(TOKENS[kind])
        shape = rng.randrange(6)
        return [f' class="{token}"', f' id="{token}"', f' class="{token}-{rng.choice(["box", "wrap", "area", "list", "inner"])}"',
                f' class="{rng.choice(["c", "l", "m"])}-{token}"', "", f' class="{rng.choice(["row", "col", "x1", "block"])}"'][shape]

    def links(n):
        rows = "".join(f'<li><a href="/{i}">{entities.escape(words(rng.randint(1, 6)))}</a></li>' for i in range(n))
        return f"<ul>{rows}</ul>" if rng.random() < 0.8 else re.sub("</?li>", " ", rows)

    def part(kind):
        tags = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"],
                "form": ["form", "div"], "comment": ["section", "div", "ol"]}
        tag = rng.choice(tags.get(kind, ["div", "section", "aside"]))
        if kind == "menu":
            body = links(rng.randint(2, 10))
        elif kind in ("side", "share"):
            body = f"<h3>{words(3)}</h3>" * rng.randrange(2) + links(rng.randint(2, 7)) + f"<p>{entities.escape(words(12))}</p>" * rng.randrange(2)
        elif kind == "comment":
            body = f"<h3>{words(2)}</h3>" + "".join(
                f"<div{name('comment')}><b>{words(1)}</b><p>{entities.escape(text(1, 4))}</p></div>" if rng.random() < 0.6 else f"<li><p>{entities.escape(text(1, 3))}</p></li>"
                for _ in range(rng.randint(1, 6))
            )
        elif kind == "form":
            body = f"<label>{words(3)}</label><input type=text><p>{entities.escape(words(8))}</p><button>{words(1)}</button>"
        elif kind == "footer":
            body = f"&copy; {words(4)} &middot; {entities.escape(words(8))}" + (links(3) if rng.random() < 0.4 else "")
        elif kind == "header":
            body = f"<div>{words(3)}</div>" + (links(4) if rng.random() < 0.5 else "")
        else:
            body = entities.escape(words(rng.randint(3, 25)))
            body = f"<p>{body}</p>" if rng.random() < 0.5 else body
        attributes = name(kind)
        if not attributes and tag in ("div", "section", "ul", "ol") and kind not in ("menu", "comment"):
            attributes = f' class="{rng.choice(TOKENS[kind])}"'
        return f'<{tag}{attributes} data-component="x">{body}</{tag}>'

    def maybe(kind, chance):
        return part(kind) if rng.random() < chance else ""

    body = keep(rng.choice(["h1", "h1", "h2"]), words(rng.randint(3, 12)))
    body += maybe("share", 0.25)
    for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 8, 12])):
        value = text(1, rng.choice([1, 3, 8]))
        kind = rng.random()
        if kind < 0.66:
            body += keep("p", value)
        elif kind < 0.74:
            body += keep(rng.choice(["h2", "h3"]), words(5)) + keep("p", value)
        elif kind < 0.82:
            kind_of_list = rng.choice(["ul", "ol"])
            items = [keep("li", text(1, 2) if rng.random() < 0.5 else words(rng.randint(1, 6))) for _ in range(rng.randint(2, 6))]
            body += f"<{kind_of_list}>{''.join(items)}</{kind_of_list}>"
        elif kind < 0.86:
            body += "<blockquote>" + keep("p", value) + "</blockquote>"
        elif kind < 0.92:
            cells = rng.randint(2, 4)
            lines = ["".join(keep("th" if i == 0 else "td", words(rng.randint(1, 4))) for _ in range(cells)) for i in range(rng.randint(2, 5))]
            body += "<table>" + "".join(f"<tr>{line}</tr>" for line in lines) + "</table>"
        elif kind < 0.96:
            body += '<figure><img src="/i.png" alt="">' + keep("figcaption", words(rng.randint(2, 14))) + "</figure>"
        else:
            body += keep("pre", value)
        body += maybe("advert", 0.08) + maybe("side", 0.04) + maybe("form", 0.02)
    inner_comments = maybe("comment", 0.15)
    wrap = rng.choice(["<article{c}>{b}</article>", "<main{c}>{b}</main>", "<div{c}>{b}</div>", "<section{c}>{b}</section>", "<main><article{c}>{b}</article></main>"])
    content = wrap.format(c=name("content") if rng.random() < 0.7 else "", b=body + inner_comments)
    top = maybe("header", 0.5) + maybe("menu", 0.8) + maybe("notice", 0.3) + maybe("advert", 0.5)
    side = maybe("side", 0.5)
    tail = maybe("share", 0.3) + maybe("comment", 0.4) + maybe("side", 0.3) + maybe("form", 0.3) + maybe("advert", 0.2) + maybe("footer", 0.8) + maybe("notice", 0.1)
    middle = (side + content if rng.random() < 0.5 else content + side) + tail
    if rng.random() < 0.4:
        middle = f'<div class="{rng.choice(["wrapper", "container", "site", "page", "layout"])}">{middle}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(5)}</title></head><body>{top}{middle}</body></html>", "\n".join(x for x in main if x)


def _known_labels(page: Page) -> np.ndarray:
    """Labels of a laid-out page from its marks."""
    n = len(page.tag)
    out = np.zeros(n, dtype=bool)
    good = np.zeros(n, dtype=bool)
    for i in range(1, n):
        out[i] = out[page.parent[i]] or page.marks[i] == "x"
    for node, _, _ in page.blocks:
        good[node] |= not out[node]
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] |= good[i]
    return good & ~out


def fit(sources: list[str], laid_out: int = LAID_OUT, seed: int = 11) -> Boosted:
    """Trees from laid-out pages over the texts of `sources`, and from those sources that tell their parts."""
    rng = random.Random(seed)
    x, y, sentences = [], [], []
    for source in sources:
        page = Page(source)
        sentences += [s for _, t, _ in page.blocks for s in re.findall(r"[^.!?]+[.!?]?", t)[:40] if len(s) > 8]
        labels = _weak_labels(page)
        if labels is not None:
            x.append(features([page])[1:]), y.append(labels[1:])
    sentences = [s.strip() for s in sentences] or ["Some words stand here, and a few more."]
    for _ in range(laid_out):
        page = Page(lay_out(rng, sentences)[0])
        x.append(features([page])[1:]), y.append(_known_labels(page)[1:])
    return boost(np.concatenate(x), np.concatenate(y).astype(float))


def _extract(model: Boosted):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("html")
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                pages = [Page(h or "") for h in column.slice(start, 256).to_pylist()]
                keep = decode(pages, np.clip(model.margin(features(pages)), -LEAST_ODDS, LEAST_ODDS))
                texts, at = [], 0
                for page in pages:
                    texts.append(main_text(page, keep[at : at + len(page.tag)]))
                    at += len(page.tag)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def extract(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html).

    Other columns are ignored. A null or empty page has an empty text; every input row gives one row,
    also when rows or ids repeat. An empty table gives an empty result. At most `sample` pages, taken
    by a hash of their html, are used for fitting.
    """
    rows = pages.select("page_id", "url", "html")
    # A share of the hash range, each page once however often it repeats.
    share = min(1.0, sample / max(1, rows.select("page_id").count()))
    hashed = rows.filter("html IS NOT NULL").select(F.xxhash64("html").alias("h"), F.substring("html", 1, BODY_CHARS).alias("html"))
    chosen = hashed.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("h").agg(F.first("html").alias("html"))
    sources = [r.html for r in chosen.limit(2 * sample).sort("h").collect()]
    id_kind, url_kind = (rows.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return rows.mapInArrow(_extract(fit(sources)), f"page_id {id_kind}, url {url_kind}, text string, n_chars long")
