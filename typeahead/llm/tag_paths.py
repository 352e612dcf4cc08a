"""Main-text extraction by tag-path ratios.

A page is cut into text blocks, each with the path of block-level tags from the root.  Per
page and path, the mean text length and the mean punctuation count of its blocks are fused
into one ratio, which a full paragraph reaches at most, so one huge block does not set the
scale; the ratios are smoothed over neighbouring blocks in page order, and blocks above a
share of the ratios' standard deviation are content.  A path's blocks rise and fall together,
so a one-word paragraph among long ones stays.  An element that holds content of its own
gives its decision to the lists, tables, headings and wrappers inside it, however short their
blocks are; the page itself gives it to nested elements only between its first and its last
own content.  Elements whose tag, role or class
names furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments) are left out before the ratios are taken; blocks of link text have paths of
their own.  A class or id names furniture as a whole token or as the head of a compound
("site-footer", "share-buttons"), not as a layout's mark ("no-sidebar", "has-banner",
"comments-open").  A form or named wrapper that holds the main element, most of the page's
text, or an article or h1 with a quarter of it is no furniture; reader comments stay
furniture when the page's article stands outside them.

Null or empty html gives an empty text; broken markup is closed the way browsers do for
paragraphs, list items and table cells; nothing is cut off at any length.  Every input row
gives one row, repeated rows included; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table
from .queries import register

MARKUP = re.compile(r"<(?:[a-zA-Z]|/[a-zA-Z]|[/!?])")
NAME_END = re.compile(r"[\s/>]")
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、؟।]")

# HTML's element classes, and the names that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark "
                   "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body div section article main table ul ol dl blockquote form aside nav header "
                  "footer".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 "
                           "h4 h5 h6 header hr main nav ol p pre section table ul".split())
FURNITURE_TAGS = frozenset("head nav footer aside form button select menu dialog template svg canvas "
                           "object audio video map".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu "
                            "menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav "
    "navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies "
    "consent notice notices notification gdpr newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations comment comments reply replies respond disqus "
    "popup modal overlay toolbar pagination pager widget copyright disclaimer".split())
ANCHORS = frozenset("article main h1".split())
HEADER_NAME = frozenset(("header",))
READER_NAMES = frozenset("comment comments reply replies respond disqus".split())
# parts of compounds that say how a page is laid out, and nouns that follow the name of furniture
LAYOUT_PARTS = frozenset("no has have with without not hide show is".split())
PLACE_NOUNS = frozenset("area bar block box button buttons container form icon icons inner item items left link "
                        "links list panel post posts right section top bottom wrap wrapper".split())
CONTENT_TAGS = frozenset("html body article main".split())
# elements that order text inside a container rather than being one
ORDERING = INLINE | frozenset("html body p li ul ol dl dt dd table caption colgroup thead tbody tfoot tr td th "
                              "blockquote pre h1 h2 h3 h4 h5 h6 hgroup figure figcaption details summary "
                              "address center".split())
FULL_PARAGRAPH = 1000   # the ratio of some 400 characters with 5 marks
MEDIAN_CHARS = 200      # a block's weight in the median ends at so many characters


def named(token: str, names: frozenset) -> bool:
    """Whether a class or id token is one of the names, or a compound headed by one."""
    if token in names:
        return True
    parts = [x for x in re.split(r"[^a-z]+", token) if x]
    if not parts or LAYOUT_PARTS & set(parts):
        return False
    return parts[-1] in names or parts[0] in names and all(x in PLACE_NOUNS for x in parts[1:])


def furniture(tag: str, attributes: str, in_content: bool) -> str:
    """Empty for content; else whether the element is left out "always", or as a "wrapper" or
    "reader" comments unless it turns out to hold the page's content."""
    if tag in FURNITURE_TAGS and tag != "form" or tag == "header" and not in_content:
        return "always"
    found = "wrapper" if tag == "form" else ""
    if not attributes or tag in CONTENT_TAGS:
        return found
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value in FURNITURE_ROLES or name == "hidden":
            if value != "form":
                return "always"
            found = found or "wrapper"
        if name == "aria-hidden" and value == "true":
            return "always"
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return "always"
        if name in ("class", "id"):
            tokens = value.split()
            if any(named(t, READER_NAMES) for t in tokens):
                found = "reader"
            elif any(named(t, FURNITURE_NAMES) or not in_content and named(t, HEADER_NAME) for t in tokens):
                found = found or "wrapper"
    return found


class Wrappers:
    """What the page's forms and elements named as furniture hold, and what stands outside them.

    What a wrapper holds, those around it hold too: text is booked once, on the innermost
    wrapper it counts for, and handed outwards when that one closes.
    """

    def __init__(self):
        self.all: list[dict] = []
        self.open: list[dict] = []
        self.anchors: list[int] = []   # per open element: how many wrappers stand around it
        self.mains: list[int] = []
        self.articles = self.readers = 0   # open ones
        self.chars = self.article_outside = self.anchor_outside = 0

    def enter(self, number: int, kind: str, tag: str) -> None:
        if kind in ("wrapper", "reader"):
            found = {"number": number, "kind": kind, "chars": 0, "anchor": 0, "main": 0}
            self.all.append(found)
            self.open.append(found)
            self.readers += kind == "reader"
        if tag in ANCHORS:
            self.anchors.append(len(self.open))
        if tag == "main":
            self.mains.append(len(self.open))
        self.articles += tag in ("article", "main")

    def leave(self, kind: str, tag: str) -> None:
        if tag in ANCHORS:
            self.anchors.pop()
        if tag == "main":
            self.mains.pop()
        self.articles -= tag in ("article", "main")
        if kind in ("wrapper", "reader"):
            inner = self.open.pop()
            self.readers -= kind == "reader"
            if self.open:
                for c in ("chars", "anchor", "main"):
                    self.open[-1][c] += inner[c]

    def text(self, n: int, link: bool) -> None:
        own = 0 if link else n
        self.chars += own
        if self.open:
            self.open[-1]["chars"] += own
            # the wrappers outside the innermost open anchor hold it with the anchor
            if self.anchors and self.anchors[-1]:
                self.open[self.anchors[-1] - 1]["anchor"] += n
            if self.mains and self.mains[-1]:
                self.open[self.mains[-1] - 1]["main"] += n
        else:
            self.article_outside += n * (self.articles > 0)
        if self.anchors and not self.readers:
            self.anchor_outside += n

    def content(self) -> frozenset:
        """Numbers of those that hold the page's content."""
        for i in range(len(self.open) - 1, 0, -1):  # never closed
            for c in ("chars", "anchor", "main"):
                self.open[i - 1][c] += self.open[i][c]
        return frozenset(
            w["number"] for w in self.all
            if w["main"] or not (w["kind"] == "reader" and self.anchor_outside)
            and (2 * w["chars"] > self.chars and (w["anchor"] or not self.article_outside)
                 or w["anchor"] and 4 * w["chars"] >= self.chars))


class Tokens:
    """Comments and tags of a page, each found in one forward scan."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.name_end = -1
        self.dead: set[int] = set()  # marks outside quotes from which no tag ends

    def tag_end(self, at: int) -> int:
        """The position after the ``>`` that ends a tag whose attributes begin at ``at``, or -1."""
        seen = []
        while at <= self.last:
            m = QUOTE_OR_END.search(self.page, at)
            if m.start() in self.dead:
                break
            if m[0] == ">":
                return m.end()
            seen.append(m.start())
            at = self.page.find(m[0], m.end()) + 1
            if not at:
                break
        self.dead.update(seen)
        return -1

    def next(self, pos: int) -> tuple[int, int, str, str, bool] | None:
        """start, end, tag (empty for what is no element), attributes, whether it closes."""
        page = self.page
        while (m := MARKUP.search(page, pos)) is not None:
            start = m.start()
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", "", False
            if start > self.last:  # only a comment can still begin
                pos = start + 1
                continue
            closing = page[start + 1] == "/"
            name = start + 1 + closing
            if page[name].isalpha():
                if self.name_end < name:
                    self.name_end = NAME_END.search(page, name).start()
                end = self.tag_end(self.name_end)
                if end >= 0:
                    return start, end, page[name:self.name_end].lower(), page[self.name_end:end - 1], closing
            if page[start + 1] in "/!?":
                return start, page.index(">", start) + 1, "", "", False
            pos = start + 1
        return None


class Outline:
    """The page's paths and containers as parent links, so that deep pages stay small."""

    def __init__(self):
        self.paths: dict[tuple[int, str], int] = {}   # (parent's path, tag) -> path
        self.container: dict[int, tuple[int, str]] = {0: (0, "")}  # number -> (the one around it, tag); 0 is the page


def blocks(page: str) -> tuple[list[tuple[tuple[int, bool], str, int]], Outline]:
    """((path, whether mostly link text), text, container) of the page's blocks that are not
    furniture, in page order; a container is an element that is not mere ordering."""
    out, outline, content = parse(page, frozenset())
    return parse(page, content)[:2] if content else (out, outline)


def parse(page: str, content: frozenset):
    """The blocks, given the numbers of wrappers known as content, and the numbers found to be."""
    out: list[tuple[tuple[int, bool], str, int]] = []
    outline = Outline()
    stack: list[tuple[str, str, int, int, int]] = []  # tag, kind of furniture, number, path, container
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    scopes: list[int] = []
    wrappers, tokens = Wrappers(), Tokens(page)
    opened = always = 0
    parts: list[str] = []
    hidden = links = link_chars = 0

    def text(raw: str) -> None:
        nonlocal link_chars
        if raw and not always and not raw.isspace():
            wrappers.text(len(raw), links > 0)
        if not hidden and raw:
            parts.append(raw)
            link_chars += len(raw) if links else 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            raw = "".join(parts)
            found = " ".join(entities.unescape(raw).split())
            if found:
                path, around = stack[-1][3:] if stack else (0, 0)
                out.append(((path, 2 * link_chars > len(raw)), found, around))
            parts.clear()
        link_chars = 0

    def close(to: int) -> None:
        nonlocal hidden, always, links
        if any(stack[i][0] not in INLINE for i in range(to, len(stack))):
            flush()
        while len(stack) > to:
            t, kind, number, _, _ = stack.pop()
            places[t].pop()
            if t in SCOPE:
                scopes.pop()
            hidden -= kind != "" and number not in content
            always -= kind == "always"
            links -= t == "a"
            wrappers.leave(kind, t)

    def innermost(tags) -> int | None:
        """Where the innermost of ``tags`` is open, unless a scope stands inside it."""
        at = max((places[t][-1] for t in tags if places[t]), default=-1)
        return at if at >= 0 and (not scopes or scopes[-1] <= at) else None

    pos, end = 0, len(page)
    while pos < end:
        m = tokens.next(pos)
        if m is None:
            text(page[pos:])
            break
        start, after, tag, attributes, closing = m
        text(page[pos:start])
        pos = after
        if not tag:
            continue
        if closing:
            at = places[tag][-1] if places[tag] else None
            if at is not None and not (tag in INLINE and scopes and scopes[-1] >= at):
                close(at)
            continue
        if tag in RAW:
            ends = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos, tokens.last + 1)
            pos = ends.end() if ends else end
            continue
        if tag in CLOSES or tag in PARAGRAPH_ENDS:
            at = innermost(CLOSES.get(tag, frozenset(("p",))))
            if at is not None:
                close(at)
        if tag in VOID:
            if tag == "hr":
                flush()
            text(" ")
            continue
        if tag not in INLINE:
            flush()
        kind = furniture(tag, attributes, wrappers.articles > 0)
        opened += 1
        path, around = stack[-1][3:] if stack else (0, 0)
        if tag not in INLINE:
            path = outline.paths.setdefault((path, tag), len(outline.paths) + 1)
        if tag not in ORDERING:
            outline.container[opened] = (around, tag)
            around = opened
        places[tag].append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append((tag, kind, opened, path, around))
        wrappers.enter(opened, kind, tag)
        hidden += kind != "" and opened not in content
        always += kind == "always"
        links += tag == "a"
    flush()
    return out, outline, wrappers.content()


def spread_out(raw: list[float], share: float) -> tuple[list[float], list[float], float]:
    """The ratios, the smoothed ratios and the least one of content."""
    # neighbours in page order lend a heading the weight of the text it stands over
    smooth = [0.5 * x + 0.25 * (raw[i - 1] if i else x) + 0.25 * (raw[i + 1] if i + 1 < len(raw) else x)
              for i, x in enumerate(raw)]
    mean = sum(smooth) / len(smooth) if smooth else 0.0
    spread = (sum((x - mean) ** 2 for x in smooth) / len(smooth)) ** 0.5 if smooth else 0.0
    return raw, smooth, share * spread


def select(found: list[tuple[tuple[int, bool], str, int]], outline: Outline, share: float = 0.25) -> list[bool]:
    """Which blocks are content, by the smoothed ratios of their paths and by their containers."""
    size, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text, _ in found:
        size[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
    ratio = {p: size[p] / count[p] * (1 + marks[p] / count[p]) ** 0.5 for p in count}
    link = [p[1] for p, _, _ in found]
    # text beyond a full paragraph, or four times the page's usual one, says nothing more
    weights = sorted((ratio[p], min(len(t), MEDIAN_CHARS)) for (p, t, _), a in zip(found, link) if not a)
    half, most = sum(w for _, w in weights) / 2, FULL_PARAGRAPH
    for r, w in weights:
        half -= w
        if half <= 0:
            most = min(most, 4 * r)
            break
    raw, smooth, least = spread_out([min(ratio[p], most) for p, _, _ in found], share)
    link_raw, _, link_least = spread_out([min(ratio[p], FULL_PARAGRAPH) for p, _, _ in found], share)
    # containers with content of their own, and articles with any; the page itself is number 0
    holds: set[int] = set()
    climbed: set[int] = set()
    on_page: list[int] = []
    for i, (_, _, around) in enumerate(found):
        if not link[i] and raw[i] >= least:
            holds.add(around)
            if not around:
                on_page.append(i)
            while around and around not in climbed:
                climbed.add(around)
                outer, tag = outline.container[around]
                if tag == "article":
                    holds.add(around)
                around = outer
    within = {0: False}  # whether the container or one around it holds content, the page aside
    for number, (outer, _) in outline.container.items():  # outer ones come first
        if number:
            within[number] = number in holds or within[outer]

    def inherits(i: int) -> bool:
        around = found[i][2]
        if not around:
            return 0 in holds
        return within[around] or bool(on_page) and on_page[0] < i < on_page[-1]

    # a link block keeps its own low ratio, whatever stands beside or around it
    return [link_raw[i] >= link_least if link[i] else smooth[i] >= least or inherits(i) for i in range(len(found))]


def main_text(page: str | None) -> str:
    found, outline = blocks(page or "")
    return "\n\n".join(text for (_, text, _), keep in zip(found, select(found, outline)) if keep)


def extract_batches(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(extract_batches, "id long, url string, text string, n_chars long") \
        .toDF(id_col, url_col, "text", "n_chars")


@register("op6_tag_path_ratios")
def op6(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))
