"""Main text of web pages by block rules in two passes.

A page becomes blocks at block-level tags. What sits inside menus, page
headers and footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments is left out by its element, role or class. A class, an id or a form
may also stand on what holds the whole page, so these are given up where they
hold most of the text (:func:`lifted`). Pass 1 classifies
every other block by length, link density and stop-word density as good, bad,
near (nearly good) or short; pass 2 gives near and short blocks the label of
the nearest decided blocks before and after them. A page with <article> or
<main> takes its blocks from there, and stop words do not decide inside it.

White space inside a block becomes one space, blocks are joined by one newline
in page order, character references are decoded. Null or empty pages give the
empty text; broken markup (open tags, comments or quotes) is read to the end
of the page in linear time. Repeated rows are extracted on their own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.llm.common import add_columns, table

LINKS_HIGH = 0.33       # share of a block's characters inside links
SHORT, LONG = 70, 200   # characters
STOP_LOW, STOP_HIGH = 0.15, 0.28
HEADING_REACH = 200     # characters between a heading and a good block

# Element names of HTML.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol
optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg math iframe object noembed noframes xmp canvas title".split())
DROPPED = frozenset("nav header footer aside form button select dialog menu head datalist audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
INLINE = frozenset("""a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark picture q s samp small
span strong sub sup time tt u var""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"},
          "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}

# Words in class or id names that mark what is not the article.
HINTS = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored
sponsors promo promotion banner cookie cookies cookiebar consent gdpr notice notices alert popup modal overlay newsletter
subscribe subscription signup nav navbar navigation menu submenu breadcrumb breadcrumbs masthead header footer copyright
sidebar widget widgets related recommended recommendations share sharing social comments comment commentlist respond
replies disqus pagination pager skip toolbar login""".split())
COMMENTS = frozenset("comments comment commentlist respond replies disqus".split())
OWN_HEADER = frozenset("article post entry content story page".split())
NOT_HINT = frozenset("has with no without hide".split())
ROOTS = frozenset("html body main article".split())

# Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset("""the of and to in a is that it for was on are as with his they be at this have from or had by but
not what all were we when your can there an which their if will how he she you its about out up them then so some her
would these has more no than been who now my over did down only may after
le la les de des du un une et en est que qui dans pour pas sur au aux avec par ce se il elle ne plus son ses sont mais ou
comme leur cette tout nous vous être fait
der die das und ist nicht ein eine zu den von mit sich auf für im dem auch als wie es an werden aus er hat dass sie nach
bei um einer noch über so zum war haben nur oder aber vor zur
el los las y no con una su para lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta
hay donde quien desde todo""".split())
LETTERS = re.compile(r"[^\W\d_]+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)""", re.I)
SPLIT_NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def tokens(page: str):
    """("text", s), ("open", name, attributes), ("close", name) in page order."""
    at, n = 0, len(page)
    absent = {}  # quote or end tag -> position after which there is none

    def seek(what: str, start: int, text: str) -> int:
        if absent.get(what, n + 1) <= start:
            return -1
        found = text.find(what, start)
        if found < 0:
            absent[what] = start
        return found

    lower = page.lower() if len(page.lower()) == n else re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:]
            return
        if lt > at:
            yield "text", page[at:lt]
        nxt = page[lt + 1:lt + 2]
        if page.startswith("<!--", lt):
            end = seek("-->", lt + 4, page)
            short = page.startswith((">", "->"), lt + 4)
            at = lt + (5 if page[lt + 4:lt + 5] == ">" else 6) if short else n if end < 0 else end + 3
        elif nxt in ("!", "?"):
            end = seek(">", lt + 2, page)
            at = n if end < 0 else end + 1
        elif nxt == "/" or nxt.isalpha() and nxt.isascii():
            closing = nxt == "/"
            m = NAME.match(page, lt + 1 + closing)
            if not m:  # "</" before no name: a comment up to the next ">"
                end = seek(">", lt + 2, page)
                at = n if end < 0 else end + 1
                continue
            name, i = m[0].lower(), m.end()
            while True:
                stop = TAG_STOP.search(page, i)
                if not stop or stop[0] == ">":
                    break
                end = seek(stop[0], stop.end(), page) if page[max(0, stop.start() - 40):stop.start()].rstrip()[-1:] == "=" else -1
                i = stop.end() if end < 0 else end + 1
            end = stop.start() if stop else n
            at = end + 1
            if closing:
                yield "close", name
                continue
            yield "open", name, page[m.end():end]
            if name in RAW and not (name in ("svg", "math") and page[end - 1:end] == "/"):
                shut = seek("</" + name, at, lower)
                at = n if shut < 0 else shut
        else:
            yield "text", "<"
            at = lt + 1


def hidden(name: str, attributes: str) -> str:
    """Why this element and what is inside is not part of the article: "" (it
    is), "always", or "form", "hint" or "comment", which may be given up."""
    if name in RAW or name in DROPPED and name != "form":
        return "always"
    why = "form" if name == "form" else ""
    if not attributes or attributes.isspace():
        return why
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" and name not in ROOTS:
            return "always"
        if key == "aria-hidden" and value.lower() == "true" and name not in ROOTS:
            return "always"
        if key == "style" and name not in ROOTS and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "always"
        if key == "role" and value.lower() in DROPPED_ROLES and name not in ROOTS:
            return "always"
        if key in ("class", "id"):
            hints = COMMENTS if name in ROOTS else HINTS
            if name in ("html", "body"):
                continue
            for one in value.split():
                parts = [p.lower() for p in SPLIT_NAME.split(one) if p]
                for k, part in enumerate(parts):
                    if part not in hints or k and parts[k - 1] in NOT_HINT:
                        continue
                    if part == "header" and OWN_HEADER & set(parts):
                        continue
                    why = "comment" if part in COMMENTS else why if why == "comment" else "hint"
    return why


class Block:
    __slots__ = ("text", "linked", "inside", "heading", "label", "holder")

    def __init__(self, text, linked, inside, heading, holder):
        self.text, self.linked, self.inside, self.heading, self.label, self.holder = text, linked, inside, heading, "", holder


class Holder:
    """An element that hides what is inside unless :func:`lifted`; ``above`` is
    the number of the one around it, -1 for none."""

    __slots__ = ("why", "above", "article", "long", "all")

    def __init__(self, why, above):
        self.why, self.above, self.article, self.long, self.all = why, above, False, 0, 0


def lifted(found: list[Block], holders: list[Holder]) -> list[bool]:
    """For each holder, whether it and those around it are given up. A form
    is where it holds an <article> or <main> or most of the page's long,
    link-poor text; a hint where it holds most of that text, or an <article> or
    <main> while no other one has such text; one for comments only where next
    to nothing is outside."""
    long, every, seen = 0, 0, False
    for b in found:
        if b.linked <= LINKS_HIGH * len(b.text):
            n = len(b.text) if len(b.text) >= SHORT else 0
            long, every = long + n, every + len(b.text)
            if b.holder >= 0:
                holders[b.holder].long += n
                holders[b.holder].all += len(b.text)
    for h in reversed(holders):  # those inside come after
        if h.above >= 0:
            up = holders[h.above]
            up.long, up.all = up.long + h.long, up.all + h.all

    def open_ones(rule):
        out = []
        for h in holders:
            out.append((h.above < 0 or out[h.above]) and rule(h))
        return out

    form = open_ones(lambda h: h.why == "form" and h.article)
    seen = any(b.inside and len(b.text) >= SHORT and b.linked <= LINKS_HIGH * len(b.text) for b in found
               if b.holder < 0 or form[b.holder])

    def rule(h):
        if h.why == "comment":
            return h.long > 0 and every - h.all < SHORT
        return 2 * h.long > long or h.article and (h.why == "form" or not seen)

    return open_ones(rule)


def blocks(page: str) -> list[Block]:
    """Blocks with text that no hidden element holds."""
    out: list[Block] = []
    holders: list[Holder] = []
    stack: list[tuple[str, str]] = []  # (element, why it hides)
    places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by name
    hiding = depth_article = links = 0
    holder = -1
    parts: list[str] = []
    linked: list[str] = []
    heading = False

    def flush():
        nonlocal parts, linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(Block(text, len(" ".join(unescape("".join(linked)).split())), depth_article > 0, heading, holder))
        parts, linked = [], []

    def pop():
        nonlocal hiding, depth_article, links, heading, holder
        name, hides = stack.pop()
        places[name].pop()
        if hides and hides != "always":  # other text may follow without a new block
            flush()
        hiding -= hides == "always"
        if hides and hides != "always":
            holder = holders[holder].above
        depth_article -= name in ("article", "main") and not hides
        links -= name == "a"
        heading = heading and name not in HEADINGS

    for token in tokens(page):
        kind, name = token[0], token[1]
        if kind == "text":
            if not hiding:
                parts.append(name)
                if links:
                    linked.append(name)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if kind == "open":
            ends = {"p"} if name in BLOCKS and name not in CLOSES else CLOSES.get(name, set())
            if any(places[x] for x in ends):
                fences = FENCES.get(name, set()) | {"article", "main", "div", "section", "body", "table", "nav", "aside"}
                fence = max((places[x][-1] for x in fences if places[x]), default=-1)
                inner = [places[x][k] for x in ends if (k := bisect_right(places[x], fence)) < len(places[x])]
                while inner and len(stack) > min(inner):
                    pop()
            if name in VOID:
                continue
            hides = hidden(name, token[2])
            if hides and name in INLINE:  # part of a block, not what holds a page
                hides = "always"
            if hides and hides != "always":
                flush()
                holders.append(Holder(hides, holder))
                holder = len(holders) - 1
            places[name].append(len(stack))
            stack.append((name, hides))
            hiding += hides == "always"
            if name in ("article", "main") and not hides and not hiding:
                k = holder
                while k >= 0 and not holders[k].article:
                    holders[k].article, k = True, holders[k].above
            depth_article += name in ("article", "main") and not hides
            links += name == "a"
            heading = heading or name in HEADINGS
        elif places[name]:
            while stack[-1][0] != name:
                pop()
            pop()
    flush()
    shown = lifted(out, holders)
    return [b for b in out if b.holder < 0 or shown[b.holder]]


def classify(found: list[Block]) -> None:
    """Pass 1: each block by itself."""
    ws = [[w.lower() for w in LETTERS.findall(b.text)] for b in found]
    n_all = sum(map(len, ws))
    density = [sum(w in STOP_WORDS for w in x) / max(1, len(x)) for x in ws]
    known = n_all and sum(sum(w in STOP_WORDS for w in x) for x in ws) >= 0.1 * n_all  # a language of the list
    main = any(b.inside for b in found)
    for b, d in zip(found, density):
        n, links = len(b.text), b.linked / len(b.text)
        if main and not b.inside:
            b.label = "bad"
        elif links > LINKS_HIGH:
            b.label = "bad" if not b.inside or links > 0.8 and n < LONG else "near"
        elif b.inside:
            b.label = "good" if n >= SHORT else "short"
        elif n < SHORT:
            b.label = "bad" if b.linked else "short"
        elif not known or d >= STOP_HIGH:
            b.label = "good" if n > LONG or not known else "near"
        else:
            b.label = "near" if d >= STOP_LOW else "bad"


def inherit(found: list[Block]) -> None:
    """Pass 2: undecided blocks take the label of their nearest decided
    neighbours; where these differ, near is good and short is bad. A heading
    close before a good block is good. Without any decided block, blocks of
    the article and nearly good ones stay."""
    first = [b.label for b in found]
    decided = [k for k, x in enumerate(first) if x in ("good", "bad")]
    if not decided:
        for b in found:
            b.label = "good" if b.inside or b.label == "near" else "bad"
        return
    before, after, last = [None] * len(found), [None] * len(found), None
    for k, x in enumerate(first):
        before[k] = last
        last = x if x in ("good", "bad") else last
    last, reach = None, HEADING_REACH + 1
    near_good = [False] * len(found)
    for k in range(len(found) - 1, -1, -1):
        after[k], near_good[k] = last, reach <= HEADING_REACH
        last = first[k] if first[k] in ("good", "bad") else last
        reach = 0 if first[k] == "good" else reach + len(found[k].text)
    for k, b in enumerate(found):
        if first[k] in ("near", "short"):
            around = {x for x in (before[k], after[k]) if x}
            if b.inside:  # the article's own blocks are bad only where every decided neighbour is
                b.label = "good" if around != {"bad"} or b.heading or first[k] == "short" else "bad"
            elif b.heading and near_good[k]:
                b.label = "good"
            else:
                b.label = "good" if around == {"good"} or first[k] == "near" and "good" in around else "bad"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    classify(found)
    inherit(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Every row with ``text``, the main text of its page."""
    return add_columns(df, [html], lambda pages: [[main_text(p) for p in pages]], [T.StructField("text", T.StringType())])


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
