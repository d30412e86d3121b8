"""Main text of web pages by tag-path ratios.

A page is read as a sequence of blocks, each with the path of block elements from the root. Per path, text length and
punctuation are summed and divided by the number of its blocks; both ratios are smoothed along the page,
fused with the share of text outside links, and paths from the threshold on are content. The content node is
the deepest element that holds nearly all text of such paths, widened to the article around it; its blocks and those of
content paths elsewhere are the result, without those below elements that are no article text by their kind, or by the
words in their class, id or role if they hold less than half of the content or
lie apart from the article that the page names.

Edge cases: null and empty pages give an empty text; broken markup (open elements, cut tags, bare ampersands) is
read as far as it goes; a page without any content path gives its longest block that is no menu or the like; repeated
rows give equal results; an empty table gives an empty result; other columns pass through unless named like an output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# Element names of HTML by what they do to text.
_INLINE = ["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
           "math", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics"]
_VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
_UNREAD = ["script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "textarea", "select"]
_ASIDE = ["nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", *_UNREAD]
_ARTICLE = ["article", "main"]
_HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
_KEEP_LINKED = frozenset(["p", "li", "dt", "dd", "figcaption", *_HEADINGS])
_UNMARKED = frozenset(["html", "body", *_ARTICLE, *_HEADINGS])  # words in their class, id or role say nothing
_CLOSES = {
    "p": ["p"], "li": ["li", "p"], "dt": ["dt", "dd", "p"], "dd": ["dt", "dd", "p"], "tr": ["tr", "td", "th", "p"], "td": ["td", "th", "p"], "th": ["td", "th", "p"],
    "option": ["option"],
}
# Words in class, id or role that mark what is no article text; the second list holds beginnings of such words.
_ASIDE_WORDS = ["ad", "ads", "adv", "adbox", "alert", "banner", "breadcrumb", "breadcrumbs", "dialog", "footer", "gdpr", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "privacy", "promo", "related", "remark", "replies", "reply", "responses", "search", "share", "sharing", "sidebar", "social", "sponsor", "subscribe", "tags", "toolbar", "widget"]
_ASIDE_STARTS = ["advert", "comment", "consent", "cookie", "copyright", "disclaimer", "disqus", "feedback", "promo", "sidebar", "signup", "sponsor"]

_INLINE_SET, _VOID_SET, _ASIDE_SET, _UNREAD_SET = map(frozenset, (_INLINE, _VOID, _ASIDE, _UNREAD))
_BREAKS_P = frozenset(["article", "section", "div", "p", "ul", "ol", "dl", "table", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "figure", "figcaption", "main", *_ASIDE])
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|annotation-xml|annotation|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)"""
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？؟、।]")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _is_aside(name: str, attributes: str, depth_of_article: bool) -> bool:
    # A heading group of the article itself is part of it.
    if name in _ASIDE_SET:
        return not (name == "header" and depth_of_article)
    return _HIDDEN.search(attributes) is not None


def _is_marked(name: str, attributes: str) -> bool:
    if not attributes or name in _UNMARKED:
        return False
    for found in _MARKS.findall(attributes):
        for word in _SPLIT.split("".join(found).lower()):
            if word in _ASIDE_WORDS or any(word.startswith(s) for s in _ASIDE_STARTS):
                return True
    return False


class _Block:
    __slots__ = ("aside", "linked", "marked", "nodes", "path", "text")

    def __init__(self, text: str, linked: int, path: str, nodes: tuple[int, ...], aside: bool, marked: list[int]) -> None:
        self.text, self.linked, self.path, self.nodes, self.aside, self.marked = text, linked, path, nodes, aside, marked


def _blocks(html: str) -> list[_Block]:
    """The page's blocks in order; an element's number in ``nodes`` is its place among all elements."""
    blocks: list[_Block] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, number, whether it or one above is no article text, whether it is marked
    parts: list[str] = []
    linked, links, count, last = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            path = "/".join(s[0] for s in stack)
            blocks.append(_Block(text, min(linked, len(text)), path, tuple(s[1] for s in stack), bool(stack) and stack[-1][2], [s[1] for s in stack if s[3]]))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(" ".join(text.split()))

    def close(names: list[str] | tuple[str, ...], stop: tuple[str, ...]) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                flush()
                del stack[at:]
                return
            if stack[at][0] in stop:
                return

    for token in _TOKEN.finditer(html):
        if token.start() > last:
            add(html[last : token.start()])
        last = token.end()
        name = token[3]
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE_SET:
            if name == "a":
                links = 0 if token[2] else 1
            continue
        if name in _VOID_SET:
            if name == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        links = 0
        if token[2]:
            flush()
            close((name,), ())
            continue
        flush()
        if name in _BREAKS_P:
            close(["p"], ("td", "th", "li", "div", "section", "article", "blockquote", "body"))
        if name in _CLOSES:
            close(_CLOSES[name][:1] if name == "p" else _CLOSES[name], ("ul", "ol", "dl", "table", "article", "section", "div"))
        if name == "body":
            close(["head"], ())
        count += 1
        inside_article = any(s[0] in _ARTICLE for s in stack)
        stack.append((name, count, bool(stack) and stack[-1][2] or _is_aside(name, token[4] or "", inside_article), _is_marked(name, token[4] or "")))
    if last < len(html):
        add(html[last:])
    flush()
    return blocks


def _smooth(values: np.ndarray) -> np.ndarray:
    if len(values) < 3:
        return values
    wide = np.pad(values, 1, mode="edge")
    return 0.25 * wide[:-2] + 0.5 * wide[1:-1] + 0.25 * wide[2:]


def main_text(html: str | None, cut: float = 0.5) -> str:
    """The main text of one page. ``cut``: how many standard deviations of the path ratios a path must reach."""
    blocks = _blocks(html or "")
    if all(b.aside for b in blocks):
        return ""
    paths = {p: i for i, p in enumerate(dict.fromkeys(b.path for b in blocks))}
    of = np.array([paths[b.path] for b in blocks])
    size = np.array([len(b.text) for b in blocks], dtype=float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) for b in blocks], dtype=float)
    linked = np.array([b.linked for b in blocks], dtype=float)
    number = np.bincount(of)
    text_ratio, mark_ratio = np.bincount(of, size) / number, np.bincount(of, marks) / number
    # Along the page every block stands for its path; smoothed there, and taken back to the paths.
    along = lambda ratio: np.bincount(of, _smooth(ratio[of])) / number
    fused = along(text_ratio) * (1 + along(mark_ratio)) * (1 - np.bincount(of, linked) / np.maximum(1, np.bincount(of, size)))
    content = fused >= min(cut * float(np.std(fused)), float(fused.max()))
    counted = [0 if b.aside else len(b.text) for b in blocks]
    if any(c and content[p] for c, p in zip(counted, of)):
        counted = [c if content[p] else 0 for c, p in zip(counted, of)]
    below: dict[int, int] = {}
    for block, characters in zip(blocks, counted):
        for node in block.marked:
            below[node] = below.get(node, 0) + characters
    # Where a page names its article, marked elements apart from it are no part of it, whatever they hold.
    article = [b for b in blocks if not b.aside and not frozenset(_ARTICLE).isdisjoint(b.path.split("/"))]
    beside = {n for b in article for n in b.marked}
    apart = {n for n in below if article and n not in beside}
    for block in blocks:
        block.aside = block.aside or any(node in apart or 2 * below[node] < sum(counted) for node in block.marked)
    usable = [b for b in blocks if not b.aside]
    if not usable:
        return ""
    weight = {}
    total = 0.0
    for block, path in zip(blocks, of):
        if content[path] and not block.aside:
            total += len(block.text)
            for depth, node in enumerate(block.nodes):
                weight[node] = (weight.get(node, (0.0, depth))[0] + len(block.text), depth)
    if not total:
        return max((b.text for b in usable), key=len)
    holder = max((d, n) for n, (w, d) in weight.items() if w >= 0.8 * total)[1] if any(w >= 0.8 * total for w, _ in weight.values()) else None
    chosen = [b for b in usable if holder is None or holder in b.nodes]
    if holder is not None and all(holder == b.nodes[-1] for b in chosen) and len(chosen[0].nodes) > 1:
        # A single paragraph: its neighbours in the element around it, such as the heading, belong to it.
        holder = chosen[0].nodes[-2]
    if holder is not None:
        names = dict(zip(chosen[0].nodes, chosen[0].path.split("/")))
        around = [n for n in names if n <= holder and names[n] in _ARTICLE]  # elements above have smaller numbers
        holder = max((n for n in around if names[n] == "article"), default=max(around, default=holder))
    out = []
    for block in usable:
        inside = holder is not None and holder in block.nodes
        unlinked = block.linked < 0.6 * len(block.text) or block.path.rsplit("/", 1)[-1] == "p"
        if inside and block.path.rsplit("/", 1)[-1] in _KEEP_LINKED or unlinked and (inside or holder is None or content[paths[block.path]]):
            out.append(block.text)
    return "\n".join(out)


def extract(pages: DataFrame, html_column: str = "html", output: str = "text") -> DataFrame:
    """``pages`` with the main text of each page instead of its html."""
    source = pages.drop(output) if output != html_column else pages
    rest = [c for c in source.columns if c != html_column]
    schema = StructType([source.schema[c] for c in rest]).add(output, StringType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h) for h in batch.column(len(rest)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*rest, output])

    return source.select(*rest, F.col(html_column).cast("string")).mapInArrow(run, schema)


def op9_html(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
