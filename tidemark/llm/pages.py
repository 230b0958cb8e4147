"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its path of tags from the root (with class
and id) and the block it stands in. For each path the length and the punctuation marks
of its nodes are added up and divided by the number of nodes. Both ratios are smoothed
along the page, weighted by nearness and by how much of the path two nodes share, and
fused to their product. Paths whose fused ratio reaches a share of the page's standard
deviation are content.

A prior on the path is fused in: what stands in navigation, headers, footers, asides,
forms, scripts and the like, or under a class or id that names an advert, notice,
sidebar or reader comments, is never content; what else stands in the article or main
element, where there is one, always is.

Defined results: a null or empty page, or one without content, gives an empty text;
rows that repeat are extracted each; broken markup (tags that are not closed, a page
cut short) is read as far as it goes, text behind an unclosed comment or script is
lost; an empty table gives an empty table; other columns are ignored. Pages are
independent of each other, and read whole, one at a time.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?",
    re.S,
)
NAMES = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
#: Fixed values of HTML: elements without content, with raw content, and those that stand inside a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Elements, and words in classes and ids, that hold no main text.
OUTSIDE = set("head nav header footer aside form menu button select option input dialog svg math template object canvas audio video".split()) | RAW
NOISE = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modals?|overlays?|newsletter|subscribe|"
    r"side-?bars?|nav(?:bar|igation)?|menus?|bread-?crumbs?|footers?|headers?|masthead|toolbar|pagination|pager|share|sharing|social|related|recommended|widgets?|comments?|commentlist|disqus|respond|repl(?:y|ies)|complementary|contentinfo|search|login|signup)(?:$|[-_\s\d])",
    re.I,
)
MARKS = re.compile(r"[.,;:!?…。，、！？；：¿¡]")


class _Node:
    __slots__ = ("path", "outside", "inside", "block", "text")

    def __init__(self, path, outside, inside, block, text):
        self.path, self.outside, self.inside, self.block, self.text = path, outside, inside, block, text


def text_nodes(page: str) -> list[_Node]:
    """Text nodes in page order."""
    nodes: list[_Node] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, name with class and id, outside, inside
    block = at = 0

    def add(text: str) -> None:
        if text:
            _, _, outside, inside = stack[-1] if stack else ("", "", False, False)
            nodes.append(_Node(tuple(x[1] for x in stack), outside, inside, block, html.unescape(text)))

    def close(i: int) -> None:
        nonlocal block
        if any(x[0] not in INLINE for x in stack[i:]):
            block += 1
        del stack[i:]

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            return nodes
        add(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                block += tag not in INLINE
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in SIBLINGS:
            same, border = SIBLINGS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in same.split():
                    close(i)
                    break
                if stack[i][0] in border:
                    break
        if tag not in INLINE:
            block += 1
        names = " ".join(a or b or c for _, a, b, c in NAMES.findall(attributes))
        _, _, outside, inside = stack[-1] if stack else ("", "", False, False)
        outside = outside or tag in OUTSIDE or bool(NOISE.search(names))
        inside = inside or tag in ("article", "main") or "main" == names.lower()
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            at = stop.start() if stop else len(page)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((tag, f"{tag}.{names}" if names else tag, outside, inside))


def content_nodes(nodes: list[_Node], width: int = 3, share: float = 0.5) -> list[bool]:
    """Which nodes are content."""
    own: dict[tuple, list[float]] = {}
    full = [(i, n) for i, n in enumerate(nodes) if n.text.strip()]
    for _, n in full:
        sums = own.setdefault(n.path, [0.0, 0.0, 0.0])
        sums[0] += len(n.text)
        sums[1] += len(MARKS.findall(n.text))
        sums[2] += 1
    ratios = [(own[n.path][0] / own[n.path][2], (1 + own[n.path][1]) / own[n.path][2]) for _, n in full]
    article = any(n.inside and not n.outside for _, n in full)
    fused: dict[tuple, list[float]] = {}
    for k, (_, n) in enumerate(full):
        total = length = marks = 0.0
        for other in range(max(0, k - width), min(len(full), k + width + 1)):
            path = full[other][1].path
            common = next((i for i, (a, b) in enumerate(zip(path, n.path)) if a != b), min(len(path), len(n.path)))
            alike = (1 + common) / (1 + max(len(path), len(n.path)))
            weight = alike**2 * math.exp(-((k - other) ** 2) / (2.0 * width))
            total += weight
            length += weight * ratios[other][0]
            marks += weight * ratios[other][1]
        sums = fused.setdefault(n.path, [0.0, 0.0])
        sums[0] += length * marks / total**2
        sums[1] += 1
    scores = {path: math.sqrt(a / b) for path, (a, b) in fused.items()}
    each = [scores[n.path] for _, n in full]
    mean = sum(each) / len(each) if each else 0.0
    bound = share * math.sqrt(sum((x - mean) ** 2 for x in each) / len(each)) if each else 0.0
    keep = [False] * len(nodes)
    for i, n in full:
        keep[i] = not n.outside and (n.inside if article else scores[n.path] >= bound)
    return keep


def main_text(page: str | None) -> str:
    nodes = text_nodes(page or "")
    keep = content_nodes(nodes)
    blocks: dict[int, list[str]] = {}
    for n, k in zip(nodes, keep):
        # White space between kept nodes of a block parts their words.
        if k or (n.block in blocks and not n.outside and not n.text.strip()):
            blocks.setdefault(n.block, []).append(n.text)
    return " ".join(" ".join("".join(parts).split()) for parts in blocks.values()).strip()


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
