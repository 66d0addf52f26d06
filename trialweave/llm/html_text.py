"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. Menus, footers, hidden parts and scripts are no text by what they are. Boxes of other kinds (forms, asides,
headers) or of a plain name (adverts, notices, comments) are left out beside an article, but none of them may empty a page: the largest of those side by
side, if it holds the text that density finds, with next to none around it, is a box like any other, and so is one around a <main>. The first pass decides a block where it
can, by its share of link characters, its share of stop words and its length, with thresholds that are easier inside what the markup names an article, and
harder outside it and where a name raises doubts. Where a page has none of the listed stop words, links and length decide alone. Short blocks
without evidence stay open; the second pass gives them the label of the nearest decided blocks around them.

Pages are read in one pass whose time grows with their length, whatever is unclosed or nested.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Thresholds of the rules: share of link characters, shares of stop words, characters.
LINKS, STOP_LOW, STOP_HIGH, SHORT, LONG = 0.4, 0.12, 0.25, 60, 180
#: The share of link characters that a block of a named article may have.
LINKS_INSIDE = 0.6
#: Share of stop words in a page's longer blocks below which its language is none of the listed ones, and how many of one language's there must be.
UNLISTED, LISTED_WORDS = 0.04, 4
#: How many times the text around a box it must hold so that it isn't left out.
MOSTLY = 4
#: Stop words of some languages, a line a language.
STOP_LISTS = tuple(frozenset(words.split()) for words in (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were what when which who will with you",
    "aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nicht oder sich sie sind und uns von vor war wie wir zu zum zur",
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous",
    "al como con de del el ella en era es esta este ha la las lo los más me no o para pero por que se sin sobre su sus también un una y ya",
    "che da dei della di e gli i il la le non per si sono un una",
    "a as de do dos e em na nas não no o os por que se um uma",
    "aan dat de een en het in is met niet op te van voor zijn",
))
STOP_WORDS = frozenset().union(*STOP_LISTS)
#: HTML elements that start and end blocks, that have no content of their own, whose content is characters only, whose content
#: is left out without ending a block, those of their kind that end one another, and those whose content is never article text.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHARACTERS = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("noscript template object svg math canvas video audio select button".split())
SERIES = frozenset("li dt dd tr td th option".split())
NEVER = frozenset("nav footer option optgroup label legend".split())
SELDOM = frozenset("header aside form menu dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
REMARKS = frozenset("comment comments disqus replies reply respond".split())
#: Names of parts that are no article text, names that only raise doubts, and those that say what kind of box it is. A class or id is
#: such a name if its words are, but for leading words of place.
PLAIN = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner banners nav navs navbar navigation menu menus breadcrumb "
    "breadcrumbs header masthead topbar footer sidebar sidebars widget widgets cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal modals newsletter "
    "newsletters subscribe subscription signup login search form forms comment comments disqus replies reply respond pagination pager paging hidden".split())
DOUBTFUL = frozenset("side rail related recommended recommendations more share sharing social disclaimer copyright legal overlay discussion tags toolbar skip".split())
PLACES = frozenset("site page main top bottom left right global primary secondary user reader js the google text article post blog".split())
BOXES = frozenset("bar box container wrapper wrap inner outer list item items area block section content body text slot unit link links menu message msg form panel thread top bottom left right main page site".split())
GOOD = frozenset("article post story entry".split())
GOOD_BOXES = frozenset("content body text main".split())
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(\s*=\s*)?)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_END_TAG, _LINK_TAG = re.compile(r"</([a-zA-Z][^\s/>]*)"), re.compile(r"<(/?)a(?=[\s/>])", re.I)
_OF_USE = frozenset("class id role hidden aria-hidden style itemprop href name".split())
_DENSE = re.compile("[\u2e80-\ua4cf\uac00-\ud7ff\uf900-\ufaff\uff00-\uffef]")
#: What an element makes of its content; EXCLUDED parts are never text, LEFT_OUT ones only if the page has text without them. ASIDE is a doubtful part of an article.
ASIDE, TEXT, OPEN, BOILERPLATE, EXCLUDED, LEFT_OUT, REMARK = 2, 1, 0, -1, -2, -3, -4


@functools.lru_cache(4096)
def _named(value: str) -> int:
    """What a class or id says; its digits and separators don't matter."""
    words = [w.lower() for w in _NAME_WORDS.findall(value[:80])]
    if words in (["content"], ["articlebody"]) or words and len(words) <= 2 and words[0] in GOOD and all(w in GOOD_BOXES for w in words[1:]):
        return TEXT
    if len(words) == 2 and words[0] in ("main", "page", "body") and words[1] in ("content", "text", "body"):
        return TEXT
    # parts written together, as in navbox
    words = [x for w in words for x in ([w] if w in PLAIN or w in DOUBTFUL else next(([w[:k], w[k:]] for k in range(2, len(w) - 1) if w[:k] in PLAIN and w[k:] in BOXES or w[:k] in PLACES and w[k:] in PLAIN), [w]))]
    while len(words) > 1 and words[0] in PLACES and words[1] in PLAIN | DOUBTFUL | PLACES:
        words.pop(0)
    if not words or not all(w in PLAIN or w in DOUBTFUL or w in BOXES for w in words[1:]):
        return OPEN
    return REMARK if words[0] in REMARKS else LEFT_OUT if words[0] in PLAIN else BOILERPLATE if words[0] in DOUBTFUL else OPEN


def _standing(tag: str, attributes: dict[str, str]) -> int:
    """What an element is by itself: by its kind, its role, and the strongest of its names."""
    if tag in NEVER:
        return EXCLUDED
    found = TEXT if tag in ("article", "main") else OPEN
    doubt, left_out = False, LEFT_OUT if tag in SELDOM else OPEN
    for name, value in attributes.items():
        if name == "role":
            if value.lower() in ROLES:
                left_out = LEFT_OUT
            if value.lower() in ("main", "article"):
                found = TEXT
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN_STYLE.search(value):
            return EXCLUDED
        elif name in ("class", "id") and tag not in ("article", "main", "body", "html"):
            for x in value.split():
                said = _named(x)
                if said in (LEFT_OUT, REMARK):
                    left_out = min(left_out, said)
                else:
                    doubt |= said == BOILERPLATE
                    found = max(found, said)
        elif name == "itemprop" and value.lower() == "articlebody":
            found = TEXT
    return left_out or (BOILERPLATE if doubt and found == OPEN else found)


def blocks(page: str | None) -> list[tuple[str, int, int]]:
    """(text, standing, link characters) of the blocks in order, where boxes that are left out are told from those that hold the page's text."""
    found, boxes = _parsed(page)
    outer = [b[0] for b in boxes]
    here = [0] * (len(boxes) + 1)  # characters that density finds directly in a box, or in none (the last)
    named = [False] * (len(boxes) + 1)  # whether an article is
    if boxes:
        for text, standing, links, box in found:
            if standing == EXCLUDED:
                continue
            size = _size(text)
            if standing in (TEXT, ASIDE):
                named[box] = True
                here[box] += size
            elif links <= LINKS * len(text) and (size >= LONG or size >= SHORT and _stop_share(text) >= STOP_HIGH):
                here[box] += size
    inside = here[:]
    for k in range(len(boxes) - 1, -1, -1):  # a box comes after the one around it
        if outer[k] >= 0:
            inside[outer[k]] += inside[k]
    largest: dict[int, int] = {}  # of the boxes side by side in one box, the one with most text
    for k, up in enumerate(outer):
        if inside[k] > inside[largest.setdefault(up, k)]:
            largest[up] = k
    kept, around, article = [True] * (len(boxes) + 1), [here[-1]] * (len(boxes) + 1), [named[-1]] * (len(boxes) + 1)
    for k, (up, kind) in enumerate(boxes):
        if up >= 0:
            around[k], article[k] = around[up] + here[up], article[up] or named[up]
        beside = around[k] > 0 if kind == REMARK else around[k] * MOSTLY >= inside[k]
        kept[k] = (up < 0 or kept[up]) and largest[up] == k and inside[k] > 0 and not article[k] and not beside
    return [(text, standing if kept[box] else EXCLUDED, links) for text, standing, links, box in found]


def _size(text: str) -> int:
    """Length, in letters of an alphabet: a sign that stands for a syllable or a word counts as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def _stop_share(text: str) -> float:
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _parsed(page: str | None) -> tuple[list[tuple[str, int, int, int]], list[tuple[int, int]]]:
    """(text, standing, link characters, innermost box that may be left out or -1) of the blocks in order; white space inside is one space, references
    are decoded. Then these boxes: (the next one around it or -1, kind).

    A tag ends at the first > outside quoted values; a quote that isn't closed counts as a character. Comments, scripts and the like that aren't
    closed take the rest of the page; an element that excludes its content and isn't closed excludes nothing, but for footers. A paragraph ends
    at the next block, an item of a series at the next one, an element at the end of one around it.
    """
    page = page or ""
    out: list[tuple[str, int, int, int]] = []
    boxes: list[tuple[int, int]] = []
    stack: list[tuple[str, int, int]] = []
    opened: Counter = Counter()
    standing, box = OPEN, -1
    parts: list[str] = []
    links, linked, at, size = 0, False, 0, len(page)
    last = {m[1].lower(): m.start() for m in _END_TAG.finditer(page)}
    absent: set[str] = set()  # quotes that don't come any more

    def flush():
        nonlocal links
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((text, standing, min(links, len(text)), box))
            parts.clear()
        links = 0

    def take(text: str):
        nonlocal links
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if linked:
            links += len(text.strip())

    def pop():
        nonlocal standing, box
        opened[stack.pop()[0]] -= 1
        if (standing, box) != (outer := stack[-1][1:] if stack else (OPEN, -1)):
            flush()
            standing, box = outer

    def after(text: str, start: int) -> int:
        return size if (k := page.find(text, start)) < 0 else k + len(text)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            take(page[at:lt])
        if lt == size:
            break
        m = _TAG.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                at = lt + 5 if page.startswith("<!-->", lt) else after("-->", lt + 4)
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = after(">", lt + 2)
            else:
                take("<")
                at = lt + 1
            continue
        closing, tag, at = m[1], m[2].lower(), m.end()
        attributes: dict[str, str] = {}
        slash = False
        while at < size:
            a = _ATTRIBUTE.match(page, at)
            at = a.end()
            if a[1] is None:
                slash = page[a.start() : at].endswith("/")
                break
            value = ""
            if a[2]:
                quote = page[at : at + 1]
                end = -1
                if quote in ('"', "'") and quote not in absent:
                    if (end := page.find(quote, at + 1)) < 0:
                        absent.add(quote)
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    v = _UNQUOTED.match(page, at)
                    value, at = v[0].strip("\"'"), v.end()
            if (name := a[1].lower()) in _OF_USE:
                attributes.setdefault(name, value)
        at += 1  # past the >
        if tag == "a":  # an anchor is no link
            near = None if closing or "href" not in attributes and not {"name", "id"}.isdisjoint(attributes) else _LINK_TAG.search(page, at)
            linked = near is not None and near[1] == "/"
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            flush()
        if closing:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in EMPTY:
            continue
        if tag in CHARACTERS:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at) if tag in last else None
            at = after(">", end.end()) if end else size
            continue
        if slash:
            continue
        if tag in SKIPPED:
            if last.get(tag, -1) >= at:
                depth = 1
                for e in re.compile(rf"<(/?){tag}(?=[\s/>])", re.I).finditer(page, at):
                    depth += -1 if e[1] else 1
                    at = e.end()
                    if not depth:
                        break
                at = after(">", at)
            continue
        if tag in BLOCK and stack and (stack[-1][0] == "p" or tag in SERIES and stack[-1][0] == tag):
            pop()
        own = _standing(tag, attributes)
        if own <= EXCLUDED and tag != "footer" and last.get(tag, -1) < at and tag not in SERIES and tag != "p":
            own = BOILERPLATE
        if tag in BLOCK or own <= EXCLUDED:
            # nothing below an excluded element is text, and what raises doubts stays doubtful, but for a page's main part
            main = own == TEXT and (tag == "main" or attributes.get("role", "").lower() == "main")
            new, inner = standing, box
            if EXCLUDED in (standing, own):
                new = EXCLUDED
            elif own < EXCLUDED:
                inner = len(boxes)
                boxes.append((box, own))
            elif main:
                new, inner = TEXT, -1
            elif own == BOILERPLATE:
                new = ASIDE if standing in (TEXT, ASIDE) else BOILERPLATE
            elif standing not in (BOILERPLATE, ASIDE):
                new = own or standing
            if (new, inner) != (standing, box):
                flush()
                standing, box = new, inner
            stack.append((tag, standing, box))
            opened[tag] += 1
    flush()
    return out, boxes


def _first(size: int, links: int, stop: float, prior: int, usual: float) -> bool | None:
    """The first pass for a block; `prior` says what the markup makes of it and moves the thresholds, `usual` is the article's share of stop words."""
    if prior in (TEXT, ASIDE):  # few stop words speak against it only where the article has them, and with links
        if links > (LINKS_INSIDE if prior == TEXT else LINKS / 2) * size:
            return False
        if size < SHORT:
            return None
        return True if stop >= min(STOP_LOW, usual / 2) else False if links > LINKS / 2 * size else None
    if links > (LINKS if prior == OPEN else LINKS / 2) * size:
        return False
    if size < SHORT or STOP_LOW <= stop < STOP_HIGH and size < LONG:
        return None
    if prior == BOILERPLATE and STOP_LOW <= stop and (size < LONG or stop < STOP_HIGH):  # outside an article text must be plainer
        return None
    return stop >= STOP_HIGH or stop >= STOP_LOW and size >= LONG


def first_pass(page: list[tuple[str, int, int]]) -> tuple[list[bool | None], bool]:
    """Labels of the blocks that the rules decide, None for the open ones, and whether text is looked for outside named articles too.

    What stands outside a named article has the thresholds of a page without one if it holds at least half as much text as the article does.
    """
    counted, seen = [], set()
    sizes = [_size(text) for text, _, _ in page]
    for (text, standing, _), size in zip(page, sizes):
        words = _WORDS.findall(text.lower()) if standing != EXCLUDED else []
        stop = [w for w in words if w in STOP_WORDS]
        if size >= SHORT:
            seen.update(stop)
        counted.append((len(stop), len(words)))
    telling = [c for c, size in zip(counted, sizes) if c[1] and size >= SHORT]
    few = max(len(seen & own) for own in STOP_LISTS) < LISTED_WORDS
    unlisted = bool(telling) and (few or sum(stop for stop, _ in telling) < UNLISTED * sum(n for _, n in telling))
    # without listed stop words, length alone stands for their share
    shares = [(STOP_HIGH if size >= LONG else STOP_LOW) if unlisted else stop / max(1, n) for (stop, n), size in zip(counted, sizes)]
    inside = [k for k, (_, standing, _) in enumerate(page) if standing in (TEXT, ASIDE)]
    usual = sum(counted[k][0] for k in inside) / max(1, sum(counted[k][1] for k in inside))
    outer = sum(len(text) for (text, standing, links), stop, size in zip(page, shares, sizes) if standing == OPEN and _first(size, links, stop, OPEN, 0.0))
    everywhere = not inside or 2 * outer >= sum(len(page[k][0]) for k in inside)
    prior = lambda standing: standing or (OPEN if everywhere else BOILERPLATE)
    return [False if standing == EXCLUDED else _first(size, links, stop, prior(standing), usual) for (_, standing, links), stop, size in zip(page, shares, sizes)], everywhere


def decide(page: list[tuple[str, int, int]]) -> list[bool]:
    """Which blocks are main text: the rules decide on all that markup doesn't exclude; an article's name moves their thresholds."""
    labels, everywhere = first_pass(page)
    out = list(labels)
    # the second pass; parts that markup excludes inside an article (adverts, forms) say nothing of the article's blocks
    for own in (True, False):
        decided = [k for k, x in enumerate(labels) if x is not None and not (own and page[k][1] not in (TEXT, ASIDE))]
        before = None
        after = iter(decided)
        nxt = next(after, None)
        for k, x in enumerate(labels):
            while nxt is not None and nxt < k:
                before = nxt
                nxt = next(after, None)
            if x is not None or own != (page[k][1] in (TEXT, ASIDE)):
                continue
            easy = page[k][1] == TEXT or everywhere and page[k][1] == OPEN
            if before is None or nxt is None:
                near = before if nxt is None else nxt
                # a page of short blocks alone is text; outside an article a block must have text on both sides
                out[k] = (near is None or labels[near]) and easy
            elif labels[before] == labels[nxt]:
                out[k] = labels[before]
            else:  # between text and boilerplate the nearer side counts, of equally near ones the text, or what the markup says
                gap = (k - before) - (nxt - k)
                out[k] = labels[before] if gap < 0 else labels[nxt] if gap > 0 else easy
    return out


def main_text(page: str | None) -> str:
    found = blocks(page)
    return "\n".join(text for (text, _, _), keep in zip(found, decide(found)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of (page_id, url, html), whole pages.

    A null or empty html and one without text give an empty text. Scripts, comments and the like that aren't closed take the rest of the page;
    other unclosed markup loses no text (see `blocks`). Repeated rows are extracted alike, rows are independent, nulls in other columns stay,
    columns beyond these three are ignored, and an empty table gives no rows.
    """

    def make():
        def one(page_id, url, page):
            text = main_text(page)
            return page_id, url, text, len(text)

        return one

    return map_rows(pages.select("page_id", "url", F.col("html")), make, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
