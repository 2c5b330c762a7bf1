"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line weighs as many characters as it has outside
links. Markup only sets weights: where the page names its article (<article> or <main>), each character in it weighs
SURGE and what lies outside weighs nothing; lines that the markup says are no article text (menus, headers, footers,
sidebars, notices, adverts, forms, comments, nested teaser articles) weigh nothing and are never kept. The weights of
WINDOW lines from each line on are summed; a surge point is where the sum rises to the threshold SURGE, a dive point
where it falls to nothing. All stretches between them are kept, each from its first to its last line of any weight.
Where no sum of a page rises to SURGE, any weight makes a surge.

Defined cases: null html is empty text; malformed markup is read as far as it goes, to any depth and length; a page
without any line of article text gives an empty string. Stretches of equal weight are all kept. Rows that repeat are
extracted one by one; an empty table gives no rows. Other columns, whatever their names, are carried along untouched,
but for html, text and n_chars, in whose place the results stand.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.common import column, small_batches, table, text_udf

#: Lines in a window, and the characters in a window that make a surge where the page names no article.
WINDOW, SURGE = 3, 80

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no article text, wherever they stand.
_NEVER = frozenset("nav footer aside form head button select dialog menu fieldset audio video".split())
_HOME = frozenset(("article", "main"))
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments disqus reply replies respond social share sharing related recommended recommendations newsletter subscribe subscription signup login search toolbar widget pagination pager legal copyright disclaimer complementary contentinfo".split()
)
#: Hints that count only where a name ends in them: "legal-analysis" is no legal notice.
_WEAK = frozenset("legal notice notices search copyright disclaimer login signup toolbar widget social share sharing related promotion promo banner consent reply replies respond menu modal overlay header".split())
_TALK = frozenset("comment comments disqus reply replies respond".split())
#: Words that say nothing about what an element holds, and words of the article itself, whose header is no site header.
_PLAIN = frozenset("wrapper wrap container box block area section inner outer row col column list item group panel top bottom left right main".split())
_ARTICLE = frozenset("article post entry story content page".split())


@lru_cache(1 << 16)
def _hinted(name: str) -> tuple[bool, bool, bool]:
    """Of one class, id or role: whether it names comments, something beside the article, a site header."""
    words = [w.lower() for w in _WORDS.findall(name)]
    told = [w for w in words if w not in _PLAIN] or words
    last = told[-1:]
    talk = any(w in _TALK and (w not in _WEAK or [w] == last) for w in told)
    beside = any(w in _HINTS and (w not in _WEAK or [w] == last) for w in told)
    return talk, beside, last == ["header"] and not _ARTICLE & set(words)


def _kind(tag: str, attrs: str, at_home: bool) -> int:
    """0: may hold article text; 1: hinted that it doesn't, unless an article starts inside; 2: doesn't."""
    if tag in _NEVER or tag == "header" and not at_home:
        return 2
    if not attrs or tag in ("html", "body"):
        return 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return 2
        if name in ("class", "id", "role"):
            talk, beside, header = (any(x) for x in zip(*map(_hinted, value.split()), strict=True)) if value.split() else (False, False, False)
            if talk or beside and at_home and tag in _HOME:
                return 2
            if beside and tag not in _HOME or header and not at_home:
                return 1
    return 0


def page_lines(html: str) -> list[tuple[str, int, bool, bool]]:
    """Lines of the page: text, characters outside links, whether it may be article text, whether it stands in an article."""
    lines: list[tuple[str, int, bool, bool]] = []
    words: list[str] = []
    linked = 0
    # Open elements: tag; whether in an article; whether of kind 2, or of kind 1 since the article began; links around.
    open_: list[tuple[str, bool, bool, bool, int]] = [("", False, False, False, 0)]
    count: Counter[str] = Counter()

    def end_line() -> None:
        nonlocal linked
        if words:
            text = " ".join(unescape("".join(words)).split())
            if text:
                _, home, never, hinted, _ = open_[-1]
                lines.append((text, max(0, len(text) - linked), not (never or hinted), home))
            words.clear()
        linked = 0

    at, size = 0, len(html)
    while at < size:
        m = _MARK.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            words.append(text)
            if open_[-1][4]:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag not in _INLINE:
            end_line()
        if closing:
            if count[tag]:
                while True:
                    last = open_.pop()[0]
                    count[last] -= 1
                    if last == tag:
                        break
        elif tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else size
        elif tag not in _VOID and not (m[3] or "").endswith("/"):
            if tag in ("p", "li") and open_[-1][0] == tag:
                open_.pop()
                count[tag] -= 1
            if tag not in _INLINE or tag == "a" or m[3]:
                if tag == "a" and count["a"]:
                    continue
                _, home, never, hinted, links = open_[-1]
                kind = _kind(tag, m[3] or "", home)
                starts = tag in _HOME
                open_.append((tag, home or starts, never or kind == 2, not starts and (hinted or kind == 1), links + (tag == "a")))
                count[tag] += 1
    end_line()
    return lines


def line_weights(lines: list[tuple[str, int, bool, bool]], surge: int) -> list[int]:
    named = any(fit and inside for _, _, fit, inside in lines)
    return [fit * (inside * len(text) * surge if named else chars) for text, chars, fit, inside in lines]


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = page_lines(html or "")
    weights = line_weights(lines, surge)
    upto = [0, *accumulate(weights)]
    sums = [upto[min(i + window, len(weights))] - upto[i] for i in range(len(weights))]
    if max(sums, default=0) < surge:
        surge = 1
    named = any(fit and inside for _, _, fit, inside in lines)
    kept: list[str] = []
    i = 0
    while i < len(sums):
        if sums[i] < surge:
            i += 1
            continue
        start = i
        while i < len(sums) and sums[i] > 0:
            i += 1
        weighty = [k for k in range(start, i) if weights[k]]
        kept += [lines[k][0] for k in range(weighty[0], weighty[-1] + 1) if lines[k][2] and (weights[k] or not named)]
    return " ".join(kept)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars in place of the html."""

    def texts(html: pd.Series) -> pd.Series:
        return html.map(main_text, na_action=None).astype(object)

    small_batches(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(F.struct(*[column(c) for c in others]).alias("_row") if others else F.lit(0).alias("_row"), text_udf(texts, "string")(column(html_col)).alias("_text"))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in others], F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
