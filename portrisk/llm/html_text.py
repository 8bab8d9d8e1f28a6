"""Main text of HTML pages by tag-path ratios.

A page is read into text nodes with their root-to-leaf tag paths. For each path, the lengths and punctuation
marks of its nodes are added up; a path's ratios are the logarithms of text per node and of punctuation per node.
Ratios are smoothed over the nodes in page order and fused by their product. What the tags themselves say is a
weight of the fused ratio: FRAME for a path through navigation, forms, footers or a class that names an advert,
comments and the like; OUTSIDE for a path outside the article of a page that marks one; else a weight that falls
with the share of links in the path's blocks. Paths below a share of the page's best one, or below LEAST, go.

Where no article is marked, the ratios choose among the page's boxes (its divisions, sections, table cells). A box's
evidence is the sum over its nodes of the geometric mean of their path's ratios, not logarithmic, times the weight (more
in paragraphs), and a part of the evidence of the boxes in it. What is in the box with the most evidence, or directly in one around it,
stays. Another box stays if it reaches SHARE of that or is in one that does, or if it has a heading of the first level or
the last one before the best box's text. A path stays with any of its nodes, as equal paths have equal parts in a page.

A class or id names something that is no content only if one of its words consists of such names and neutral
words (comment-list, ad_box), so share-price or side-effects does not.

Blocks are the runs of kept text between block-level tags: character references decoded, white space made one
space, trimmed, joined by two line feeds. Unclosed and misnested tags are taken as browsers do: an end tag
closes up to its start tag, a block in a paragraph ends it, text to the end of a cut page counts. Quotes delimit
only after an equals sign; a value whose quote is never closed ends at the tag's end.

Edge cases: null html is empty and gives an empty text; a page without tags is one block; rows with equal ids stay
separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the best path's weighted ratio that a path of content has at least, and its least value. The ratio of one
#: letter is a fifteenth of that of 100,000 with 10,000 marks, so within an article every path stays.
THRESHOLD = 0.05
LEAST = 0.1
SMOOTH = 1
FRAME = 0.002
OUTSIDE = 0.002
#: The weight of a path all of whose text is in links.
LINKS = 0.05
#: Share of the best box's evidence that another box of content has at least; the part of a box's evidence that counts
#: for the box around it (with a half, two equal boxes yield to the one around them); the weight of text in paragraphs.
SHARE = 0.07
NEST = 0.5
PARAGRAPH = 3

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NO_CONTENT = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "svg", "canvas", "object", "audio", "video", "dialog", "label", "fieldset", "math", "map", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main",
            "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "td", "th", "blockquote", "main", "select"}
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Tags of divisions: others, unknown ones too, are parts of a text and no boxes.
BOXES = ARTICLE | {"aside", "body", "center", "div", "footer", "form", "header", "nav", "section", "td"}

#: Words of class or id that mark what is no article, and words that say nothing beside them.
MARKS = re.compile(r"ads?|advert\w*|adsense|banners?|sponsor\w*|promos?|promotion\w*|comments?|commentary|respond|disqus|cookies?|consent|gdpr|notices?|newsletter|subscri\w*|popup|modal|overlay|nav|navbar|navigation|menus?|submenu|"
                   r"breadcrumbs?|sidebar\w*|widgets?|footer|header|masthead|topbar|related|recommend\w*|share|sharing|social\w*|pagination|pager|tags|login|signup|search|copyright|toolbar|skip\w*|outbrain|taboola", re.I)
NEUTRAL = re.compile(r"box|list|item|items|area|wrap|wrapper|container|section|block|bar|buttons?|btn|links?|icons?|media|posts?|articles?|site|page|main|top|bottom|left|right|inner|outer|content|form|unit|slot|row|col|text|body|"
                     r"primary|secondary|user|reader|thread|reply|replies|and|the|to|us|on|by|side|\d*", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
SPACE = re.compile(r"[ \t\n\r\f\v   -     　\x1c-\x1f\x85]+")


@dataclass(eq=False, slots=True)
class Box:
    number: int  # in page order, so larger than that of the box around it
    above: Box | None


@dataclass
class Node:
    block: int
    path: int
    text: str
    inside: bool  # of an article
    frame: bool  # in a subtree that is no content by its tags
    link: bool
    box: Box
    heading: int  # its level, or 0
    paragraph: bool  # in one


def _names(value: str) -> bool:
    """A word of a class or id that names what is no content."""
    for word in value.split():
        parts = [x for x in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", word) if x]
        if any(MARKS.fullmatch(x) for x in parts) and all(MARKS.fullmatch(x) or NEUTRAL.fullmatch(x) for x in parts):
            return True
    return False


def _marked(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if name in ("class", "id") and _names(value) or name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def text_nodes(page: str) -> tuple[list[Node], bool]:
    """Text nodes outside scripts and the like, in order; whether the page marks an article."""
    # Name, in a frame, in an article, in a link, path, box, level of heading.
    open_tags: list[tuple[str, bool, bool, bool, int, Box, int]] = []
    outermost = ("", False, False, False, 0, Box(0, None), 0)
    opened: Counter[str] = Counter()
    paths: dict[tuple[int, str, bool], int] = {}
    never_closed: set[str] = set()
    nodes: list[Node] = []
    block, at, has_article, boxes = 0, 0, False, 0

    def add(piece: str) -> None:
        _, frame, inside, link, path, box, heading = open_tags[-1] if open_tags else outermost
        if piece:
            nodes.append(Node(block, path, piece, inside, frame, link, box, heading, opened["p"] > 0))

    def close(k: int) -> None:
        """Ends the open tags from number k."""
        for name, *_ in open_tags[k:]:
            opened[name] -= 1
        del open_tags[k:]

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            add(html.unescape(page[at:]))
            break
        if m.start() > at:
            add(html.unescape(page[at: m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:
            while opened[name]:
                last = open_tags[-1][0]
                close(len(open_tags) - 1)
                if last == name:
                    break
            block += name not in INLINE
            continue
        if name not in INLINE:
            block += 1
            if name in CLOSES_P and opened["p"]:
                # Inline tags inside the paragraph end with it.
                while open_tags and open_tags[-1][0] in INLINE | {"p"}:
                    last = open_tags[-1][0]
                    close(len(open_tags) - 1)
                    if last == "p":
                        break
        if any(opened[x] for x in SIBLINGS.get(name, ())):
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] in SIBLINGS[name]:
                    close(k)
                    break
                if open_tags[k][0] in SCOPES:
                    break
        if name == "br":
            add(" ")
        if name in VOID:
            continue
        _, frame, inside, link, path, box, heading = open_tags[-1] if open_tags else outermost
        # The page's body is never taken for an advert by its class, nor is the outer article.
        outer = name in ("html", "body") or name in ARTICLE and not inside
        marked = not outer and _marked(m[3])
        title = name == "header" and inside and not marked
        frame = frame or name in NO_CONTENT and not title or marked
        inside = inside or name in ARTICLE and not frame
        has_article |= inside
        if name in RAW:
            # What is in it is no text; one without an end holds nothing back but itself, or the rest of the page.
            end = None if name in never_closed else re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if end:
                at = end.start()
            elif name in ("script", "style", "textarea", "title"):
                break
            else:
                never_closed.add(name)
            continue
        opened[name] += 1
        if name in BOXES:
            boxes += 1
            box = Box(boxes, box)
        heading = int(name[1]) if name in HEADINGS else heading
        open_tags.append((name, frame, inside, link or name == "a", paths.setdefault((path, name, frame), len(paths) + 1), box, heading))
    return nodes, has_article


def content_paths(nodes: list[Node], has_article: bool) -> set[int]:
    """Paths whose smoothed, fused and weighted ratios reach the threshold."""
    size, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    in_block, in_links = defaultdict(float), defaultdict(float)
    order: list[Node] = []
    for n in nodes:
        words = SPACE.sub(" ", n.text).strip()
        if words:
            order.append(n)
            size[n.path] += len(words)
            marks[n.path] += len(PUNCTUATION.findall(words))
            count[n.path] += 1
            in_block[n.block] += len(words)
            in_links[n.block] += len(words) * n.link
    ratio = {p: (math.log1p(size[p] / count[p]), math.log1p(marks[p] / count[p] + 1)) for p in count}
    # Neighbours in page order lift a path: captions between paragraphs, emphasis inside them.
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    weights: list[float] = []
    for i, n in enumerate(order):
        near = order[max(0, i - SMOOTH): i + SMOOTH + 1]
        for k in (0, 1):
            sums[n.path][k] += sum(ratio[q.path][k] for q in near) / len(near)
        frame = n.frame or has_article and not n.inside
        weight = 1 if n.inside or frame else 1 - (1 - LINKS) * in_links[n.block] / in_block[n.block]
        sums[n.path][2] += weight
        weights.append(weight)
    says = {n.path: FRAME if n.frame else OUTSIDE if has_article and not n.inside else 1.0 for n in order}
    fused = {p: math.sqrt(a * b) / count[p] * says[p] * weight / count[p] for p, (a, b, weight) in sums.items()}
    limit = max(LEAST, THRESHOLD * max(fused.values(), default=0.0))
    keep = {p for p, f in fused.items() if f >= limit}
    if has_article:
        return keep
    plain = {p: math.sqrt(size[p] / count[p] * (marks[p] / count[p] + 1)) for p in count}
    return keep & _paths_in_boxes(order, [plain[n.path] * says[n.path] * w * (PARAGRAPH if n.paragraph else 1) for n, w in zip(order, weights, strict=True)])


def _paths_in_boxes(order: list[Node], evidence: list[float]) -> set[int]:
    """Paths with a node in a box whose evidence reaches its share of the best one's."""
    total: dict[Box, float] = {}
    for n, e in zip(order, evidence, strict=True):
        box: Box | None = n.box
        while box and box not in total:
            total[box] = 0.0
            box = box.above
        total[n.box] += e
    if not total:
        return set()
    boxes = sorted(total, key=lambda b: b.number)
    for b in reversed(boxes):
        if b.above:
            total[b.above] += NEST * total[b]
    best = max(boxes, key=total.__getitem__)
    around, within = {best.above}, {best}
    for b in reversed(boxes):
        if b in around:
            around.add(b.above)
    for b in boxes:
        if b.above in within:
            within.add(b)
    titles, last = {n.box for n in order if n.heading == 1}, None
    for n in order:
        if n.heading:
            last = n.box
        elif n.box in within:
            break
    reach: dict[Box, float] = {}
    for b in boxes:
        if b is best or b is last or b in around or b in titles:
            reach[b] = total[best]
        else:
            reach[b] = max(total[b], 0.0 if b.above in around else reach[b.above])
    return {n.path for n in order if reach[n.box] >= SHARE * total[best]}


def main_text(page: str | None) -> str:
    nodes, has_article = text_nodes(page or "")
    keep = content_paths(nodes, has_article)
    blocks: dict[int, list[str]] = defaultdict(list)
    for n in nodes:
        if n.path in keep or not n.text.strip():
            blocks[n.block].append(n.text)
    texts = (SPACE.sub(" ", "".join(parts)).strip(" ") for _, parts in sorted(blocks.items()))
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep of every row, with text and its code points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*map(batch.column, keep), pa.array((main_text(x.as_py()) for x in batch.column("_html")), pa.string())], names=[*keep, "text"])

    source = pages.select(*keep, F.col(html_col).alias("_html"))
    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}, text string").withColumn("n_chars", F.length("text").cast("long"))
