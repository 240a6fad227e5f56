"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass classifies each block by itself: link density, length
and the density of stop words (English, French, German, Spanish) make it good, bad, nearly good or short. Markup that
names something beside the text (nav, footer, a class such as "sidebar") makes it bad. Markup that names the text
(article, main) decides nothing: it lowers the thresholds and is a good neighbour at its limits. In the second pass the
blocks left undecided take the label of the nearest decided neighbours: of both where they agree, of the good one for
a nearly good block or a heading before text, else bad. A page without any undecided block never needs the second pass. A
page in a language without a stop list, or with short paragraphs only, has no good block; there the passes run again
without the stop words, and what is neither linked nor named is text where even that leaves nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from granary.llm.common import text_column

# fixed values: frequent function words of four languages
_STOP = frozenset(
    """
    a about after all also an and any are as at be because been but by can could for from had has have he her his if in
    into is it its more no not of on one or our out she so some such than that the their them then there these they this
    to up was we were what when which who will with would you your
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour
    qu que qui sa se ses son sont sur un une vous à été
    aber als am an auch auf aus bei bis das dass dem den der des die ein eine einen einer es für hat ich im ist mit nach
    nicht noch nur oder sich sie sind so und von vor war was wie wir wird zu zum zur über
    al como con del el ella en entre es esta este fue ha hay la las lo los más me mi muy no o para pero por que se ser
    si sin sobre su sus también un una y ya
    """.split()
)
_SKIP = "script style noscript template svg math iframe object textarea select canvas audio video title".split()
_BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot
    th thead tr ul
    """.split()
)
_KEPT_OPEN = frozenset("article aside blockquote body details dialog div fieldset figure footer form header main menu nav ol section table td ul a button".split())
_LISTS = frozenset("ul ol menu table nav".split())
_ITEMS = frozenset("li dt dd option tr td th".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAGS = frozenset("nav footer aside form menu button dialog".split())
_MAIN_TAGS = frozenset(("article", "main"))
# whole words of class, id and role that name something beside the text
_BOILER_WORDS = frozenset(
    """
    ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist
    consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr header masthead menu menubar modal nav navbar
    navigation newsletter notice notices notification overlay paywall popup promo promoted promotion recommended related
    reply replies respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription tags
    toolbar warning widget widgets
    """.split()
)
# of these, what is never the text however long it is
_NEVER_WORDS = frozenset(
    """
    ad ads advert adverts advertisement advertisements advertising comment comments commentlist consent cookie cookies disqus
    gdpr newsletter notice notices paywall promo promoted promotion replies respond sidebar sidebars sponsor sponsored
    """.split()
)
# words that make a name say what a wrapper has or lacks
_HAVING_WORDS = frozenset("allow closed count disabled enabled has have hide is layout no off on open show with without".split())
_MAIN_WORDS = frozenset("articlebody main mainentity".split())
# a quote opens a value only behind =; possessive, so that no tag is tried twice
_ATTRIBUTES = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(_SKIP) + r")(?![\w:-])" + _ATTRIBUTES + r"(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(" + _ATTRIBUTES + r")(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ROLE = re.compile(r"(?<![\w-])(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"
SHORT_CHARS, LONG_CHARS = 70, 140
STOP_LOW, STOP_HIGH = 0.30, 0.32
LINKS = 0.2
# inside article and main
MAIN_STOP, MAIN_LINKS = 0.15, 0.5


def _role(tag: str, attributes: str) -> tuple[str | None, str]:
    """"bad" or "main" where the tag or its names say so, and how its names say "bad" of it: "never" the text, a "whole" name,
    a "part" of one (or a form), or not at all."""
    if tag in _BOILER_TAGS and tag != "form":
        return BAD, ""
    role, bad = "main" if tag in _MAIN_TAGS else None, "part" if tag == "form" else ""
    if attributes:
        values = [m[1].strip("\"'") for m in _ROLE.finditer(attributes)]
        split = [[w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", name).replace("_", " "))] for value in values for name in value.split()]
        names = {w for words in split for w in words}
        role = "main" if (names | {v.lower() for v in values}) & _MAIN_WORDS else role
        if tag not in _MAIN_TAGS:
            if any(_NEVER_WORDS.intersection(words) and not _HAVING_WORDS.intersection(words) for words in split):
                bad = "never"
            elif names & _BOILER_WORDS:
                bad = "whole" if any(" ".join(value.lower().split()) in _BOILER_WORDS or _BOILER_WORDS.intersection(value.lower().split()) for value in values) else "part"
        bad = bad or ("part" if _HIDDEN.search(attributes) else "")
    return role, "" if tag == "body" else bad


def blocks(page: str) -> list[tuple[str, float, str | None, bool, bool]]:
    """(text, link density, what its containers say, heading, in a list or menu) of every block with text, in page order.

    Names and forms decide nothing on body, article and main, around main, or on a container of most of the text: pages
    name their wrappers by what they have or lack. A name that is such a word as a whole holds where article stands
    elsewhere, and comments, adverts, notices and sidebars are never the text. Any element can have such a name: a paragraph
    or list item is a container then, and the text of an inline element is left out of its block.
    """
    out: list = []
    parts: list[str] = []
    linked: list[str] = []
    containers: list[tuple[int, str, str | None, str]] = [(0, "", None, "")]  # outer one, tag, what it says, what its names say
    stack = [0]  # open containers
    at, heading, in_link = 0, False, 0
    muted: list[str] = []  # open inline elements from the first one that is named as beside the text

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                links = len(" ".join(html.unescape(" ".join(linked)).split())) / len(text) if linked else 0.0
                listed = any(containers[c][1] in _LISTS for c in stack)
                out.append((text, min(1.0, links), stack[-1], heading, listed))
            parts.clear()
            linked.clear()

    def put(text: str) -> None:
        if text and not muted:
            parts.append(text)
            if in_link:
                linked.append(text)

    for token in _TOKEN.finditer(page):
        put(page[at : token.start()])
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(token[2])
        if tag in _BLOCK_TAGS:
            flush()
            muted.clear()  # an inline element does not go on into the next block
            # a paragraph ends where any block begins or ends, an item where the next begins
            if containers[stack[-1]][1] in (("p", tag) if tag in _ITEMS and not closing else ("p",)):
                stack.pop()
            if tag[0] == "h" and tag[1:].isdigit():
                heading = not closing
        if muted:
            if tag == muted[0]:
                muted = muted[:-1] if closing else [*muted, tag]
            if muted or closing:
                continue
        if token[4].endswith("/") and tag not in _BLOCK_TAGS:
            continue
        if tag not in _KEPT_OPEN:
            if closing:
                if not any(containers[c][1] == tag for c in stack):
                    continue
            elif tag in _VOID or _role(tag, token[4])[1] not in ("never", "whole"):
                continue
            elif tag not in _BLOCK_TAGS:
                muted = [tag]
                continue
        if not closing:
            containers.append((stack[-1], tag, *_role(tag, token[4])))
            stack.append(len(containers) - 1)
            in_link += tag == "a"
        elif any(containers[c][1] == tag for c in stack):
            while True:
                name = containers[stack.pop()][1]
                in_link -= name == "a"
                if name == tag:
                    break
    put(page[at:])
    flush()
    said = _said(containers, out)
    return [(text, links, said[c], heading, listed) for text, links, c, heading, listed in out]


def _said(containers: list[tuple[int, str, str | None, str]], found: list[tuple[str, float, int, bool, bool]]) -> list[str | None]:
    """What each container says of its text, inherited."""
    n = len(containers)
    # unlinked text outside nav, footer and the like, and what of it stands in article or main; outer containers come first
    held, marked = [0.0] * n, [0.0] * n
    beside, inside, around = [False] * n, [False] * n, [False] * n
    for i, (outer, _, role, _) in enumerate(containers):
        beside[i] = role == BAD or beside[outer]
        inside[i] = role == "main" or inside[outer]
    for text, links, c, _, _ in found:
        if not beside[c]:
            held[c] += len(text) * (1 - links)
            marked[c] += len(text) * (1 - links) * inside[c]
    for i in range(n - 1, 0, -1):
        outer, tag, role, _ = containers[i]
        held[outer] += held[i]
        marked[outer] += marked[i]
        around[outer] |= around[i] or (role == "main" and tag != "article")
    said: list[str | None] = [None]
    for i, (outer, tag, role, named) in enumerate(containers[1:], 1):
        before = said[outer]
        most = named != "never" and 2 * held[i] > held[0] and (named != "whole" or 2 * marked[i] >= marked[0])
        bad = bool(named) or (tag == "header" and before != "main")
        own = BAD if bad and not most and not around[i] else role
        said.append(BAD if before == BAD else own or before)
    return said


def first_pass(text: str, links: float, role: str | None, heading: bool, listed: bool = False, stop_words: bool = True) -> str:
    if role == BAD:
        return BAD
    inside = role == "main"
    if links > (MAIN_LINKS if inside else LINKS):
        if inside and not listed:  # the title of a text may link to it, and a paragraph may have many links
            return SHORT if heading else NEAR
        return BAD
    if len(text) < SHORT_CHARS:
        return NEAR if inside and not heading else SHORT
    if not stop_words:
        return GOOD
    words = _WORDS.findall(text.lower())
    density = sum(w in _STOP for w in words) / len(words) if words else 0.0
    if inside:
        return GOOD if density >= MAIN_STOP else NEAR
    if density >= STOP_HIGH:
        return GOOD if len(text) > LONG_CHARS else NEAR
    return NEAR if density >= STOP_LOW else BAD


def second_pass(labels: list[str], headings: list[bool], inside: list[bool] | None = None) -> list[str]:
    """Undecided blocks inherit: nearly good ones first, so that short ones see them decided.

    The limits of article and main, whose blocks are ``inside``, are good neighbours.
    """
    inside = inside or [False] * len(labels)
    for kind in (NEAR, SHORT):
        before, after = [], []
        last = None
        for i, x in enumerate(labels):
            if inside[i] and not (i and inside[i - 1]):
                last = GOOD
            before.append(last)
            last = x if x in (GOOD, BAD) else last
        last = None
        for i in reversed(range(len(labels))):
            if inside[i] and not (i + 1 < len(labels) and inside[i + 1]):
                last = GOOD
            after.append(last)
            last = labels[i] if labels[i] in (GOOD, BAD) else last
        after.reverse()

        def inherit(b, a, heading, kind=kind):
            if kind == NEAR:
                return BAD if b == BAD and a == BAD else GOOD
            return GOOD if (b == GOOD and a == GOOD) or (heading and a == GOOD) else BAD

        labels = [inherit(b, a, h) if x == kind else x for x, b, a, h in zip(labels, before, after, headings, strict=True)]
    return labels


def main_text(page: str) -> str:
    found = blocks(page)
    for stop_words in (True, False):
        labels = [first_pass(*b, stop_words) for b in found]
        if NEAR in labels or SHORT in labels:
            labels = second_pass(labels, [b[3] for b in found], [b[2] == "main" for b in found])
        if GOOD in labels:
            return " ".join(b[0] for b, x in zip(found, labels, strict=True) if x == GOOD)
    return " ".join(text for text, links, role, _, _ in found if role != BAD and links <= LINKS)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row: the main text of the whole page, empty where there is none.

    Null counts as an empty page; null ids and urls stay null; repeated rows stay. Pages of any length are read whole. Character references are decoded,
    white space inside a block becomes one space, and blocks are joined by one space in page order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x) for x in batch.html]
            yield pd.DataFrame({"page_id": batch.page_id.astype("Int64"), "url": batch.url, "text": text, "n_chars": [len(x) for x in text]})

    chosen = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_column(html_col).alias("html"))
    return chosen.mapInPandas(run, "page_id long, url string, text string, n_chars long")
