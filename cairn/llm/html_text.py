"""HTML extraction by line-block distribution.

Markup is stripped: raw elements and comments go, block tags end a line, and what a page itself declares to be
navigation, its header or footer, a sidebar, notice, advert, form or reader comments leaves an empty line. A
line's length is that of its text, or 0 if most of it is links. If the page marks an article or a main part,
lines outside of it have no length.

Lengths are summed over a sliding window of lines. Text surges at the first window with SURGE characters (or
the most that the page has, if that is less), and dives after the last; both ends go on over neighbouring text
until a window without any. What lies between is the article: all of its lines, short ones too, but for
windows without own text, which are menus and link lists. On pages that mark nothing, lines at either end that
stand in another element than the article's long lines are left out, headings before it aside.

Null, empty or textless html gives the empty text. Unclosed and cut-off tags are taken as markup to the end
of the page. Very long pages are read whole. Repeated rows are extracted each on its own; an empty table gives
no rows. Extra columns can be passed through, but not under the names of results, which stand.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import common as C

WINDOW = 3
#: Characters in a window that make a surge.
SURGE = 86

_MARK = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S)
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "textarea", "title", "audio", "video"}
_DROP = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "head", "fieldset"}
_BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "thead", "tbody", "blockquote", "pre", "section", "article", "main", "header", "figure", "figcaption", "hr", "body", "html", "address", "details", "summary", "center", "caption"} | _DROP
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
_NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|side-?bar|menu\w*|nav(?:bar|igation|s)?|breadcrumbs?|cookies?|consent|gdpr|notice\w*|alert|popup|modal|newsletter|subscribe|signup|share|sharing|social|comments?|comment\w*|disqus|replies|reply|related|recommend\w*|footer|masthead|site-?header|page-?header|toolbar|pagination|pager|copyright|legal|disclaimer|skip|widget|login|search|contentinfo|complementary|navigation|dialog)(?=$|[\s_-])", re.I)
_HIDE = re.compile(r"(?:^|\s)hidden(?:$|[\s=])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_CONTAIN = re.compile(r"\brole\s*=\s*[\"']?(?:main|article)\b", re.I)


class Line(NamedTuple):
    """A line's text, its characters in links, whether it is in a marked article, its element's number, and whether it is a heading."""

    text: str
    linked: int = 0
    inside: bool = False
    home: int = 0
    heading: bool = False


class _Open:
    __slots__ = ("parts", "linked", "inside", "heading")

    def __init__(self, inside: bool) -> None:
        self.parts: list[str] = []
        self.linked, self.inside, self.heading = 0, inside, False


#: Elements that hold blocks.
_HOLD = {"div", "section", "article", "main", "td", "th", "header", "body", "center", "details"}
_EMPTY = Line("")


def lines_of(page: str) -> tuple[list[Line], bool]:
    """(lines, whether the page marks an article)."""
    out: list[Line] = []
    now = _Open(False)
    marked = False
    inside: list[str] = []  # open article and main elements
    homes, made = [(0, "")], 0  # open elements that hold blocks
    skip, depth, link = "", 0, 0
    low = None

    def close() -> None:
        nonlocal now
        text = " ".join(html.unescape("".join(now.parts)).split())
        if text:
            out.append(Line(text, now.linked, now.inside, homes[-1][0], now.heading))
        now = _Open(bool(inside))

    at, end = 0, len(page)
    while at < end:
        m = _MARK.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not skip:
            now.parts.append(piece)
            if link:
                now.linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        closing, name, attrs = bool(m[1]), name.lower(), m[3] or ""
        if name in _RAW and not closing and not attrs.endswith("/"):
            if low is None:
                low = page.lower() if page.isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), page)
            k = low.find(f"</{name}", at)
            if k < 0:
                break
            k = low.find(">", k)
            at = end if k < 0 else k + 1
            continue
        if skip:
            if name == skip:
                depth += -1 if closing else not attrs.endswith("/")
                if depth <= 0:
                    skip = ""
                    continue
            elif skip in ("p", "li") and name in _BLOCK or closing and name in ("body", "html"):
                skip = ""  # a paragraph left open ends where a block does
            if skip:
                continue
        if closing:
            if name in ("article", "main") or (inside and inside[-1] == name):
                if name in inside:
                    while inside and inside.pop() != name:
                        pass
                close()
            elif name == "a":
                link = max(0, link - 1)
            elif name in _BLOCK:
                close()
            if name in _HOLD and any(x == name for _, x in homes):
                while homes.pop()[1] != name:
                    pass
            continue
        if name == "br" or name in ("td", "th"):
            now.parts.append(" ")
            continue
        bad = name in _DROP or name == "header" and not inside
        if not bad and attrs and name not in ("body", "html", "main"):
            names = " ".join(x for a, b, c in _NAME.findall(attrs) for x in (a or b or c).split() if not re.match("(?i:has|with|no|is)-", x))
            bad = bool(names and _BAD.search(names)) or bool(_HIDE.search(attrs))
        if bad and name not in _VOID:
            if name in _BLOCK:
                close()
                out.append(_EMPTY)
            if not attrs.endswith("/"):
                skip, depth = name, 1
            continue
        if name == "a":
            link += 1
        if name in _BLOCK:
            close()
            now.heading = name in ("h1", "h2", "h3")
            if name in _HOLD and not attrs.endswith("/"):
                made += 1
                homes.append((made, name))
            if name in ("article", "main") or _CONTAIN.search(attrs):
                inside.append(name)
                marked = True
                now.inside = True
            elif inside and name == inside[-1]:
                inside.append(name)  # nested elements of the same name close in turn
    close()
    return out, marked


def bounds(size: np.ndarray, window: int, surge: int) -> tuple[int, int, np.ndarray]:
    """(surge, dive, whether a line is in a window without any text) of lines' lengths: the article is [surge, dive)."""
    n = len(size)
    padded = np.concatenate([size, np.zeros(window - 1, np.int64)])
    near = np.convolve(padded, np.ones(window, np.int64), "valid")  # of a line and those after it
    gap = np.convolve(np.convolve(size, np.ones(window, np.int64), "valid") == 0, np.ones(window, np.int64)) > 0 if n >= window else np.zeros(n, bool)
    if not near.any():
        return 0, 0, gap
    some = np.flatnonzero(near >= min(surge, int(near.max())))
    at, end = int(some[0]), min(int(some[-1]) + window, n)
    while at > 0 and not gap[at - 1]:
        at -= 1
    while end < n and not gap[end]:
        end += 1
    return at, end, gap


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's article: its blocks, joined by two newlines."""
    if not page:
        return ""
    lines, marked = lines_of(page)
    marked = marked and any(x.inside and x.text for x in lines)
    size = np.array([0 if 2 * x.linked > len(x.text) or marked and not x.inside else len(x.text) for x in lines], np.int64)
    if not size.any():  # links alone, or nothing
        size = np.array([len(x.text) if x.inside or not marked else 0 for x in lines], np.int64)
    at, end, gap = bounds(size, window, surge)
    if not marked and end:
        held: dict[int, int] = {}
        for x, n in zip(lines[at:end], size[at:end].tolist(), strict=True):
            held[x.home] = held.get(x.home, 0) + n
        home = {x.home for x, n in zip(lines[at:end], size[at:end].tolist(), strict=True) if 2 * n >= surge} or {max(held, key=lambda k: held[k])}
        while lines[at].home not in home and not (lines[at].heading and lines[at].text):
            at += 1
        while lines[end - 1].home not in home:
            end -= 1
    return "\n\n".join(x.text for x, cut in zip(lines[at:end], gap[at:end].tolist(), strict=True) if x.text and not cut and (x.inside or not marked))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """The `keep` columns, text and n_chars of every page."""

    keep = C.unclashing(keep, ("text", "n_chars"))
    x = C.spare("html", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _ in C.slices(batches, x):
            texts = [main_text(page.as_py()) for page in b.column(x)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    took = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias(x))
    return took.mapInArrow(run, T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
