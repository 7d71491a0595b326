"""The main text of HTML pages: blocks are classed by stop words, length and links, then short ones take after their neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|(?<==)"[^"]*+"|(?<==)'[^']*+'|(?<=[=]\s)"[^"]*+"|["'])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))|([^\s"'>/=]++)""")
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What these elements hold is no text of the page.
SILENT = frozenset("audio canvas iframe math noembed noframes noscript object script style svg template textarea video".split())
#: Where they end. The page itself is searched: lower-casing it would move what follows each U+0130.
SILENT_END = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in SILENT}
#: Those whose text the browser does not read as markup: without an end they run to that of the page. The others then hold nothing.
RAW = frozenset("iframe noembed noframes script style textarea".split())
#: What these hold is never main text; a header may be, inside an article.
OUTSIDE = frozenset("aside button dialog footer form head menu nav optgroup option search select title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that mark what is not main text.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus feedback footer gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond reviews search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud taboola toolbar topbar widget widgets".split()
)
#: Words that say no more about what is in a box: a name made of these and of MARKS bars; with other words too, as in market-share, the text decides.
PLAIN = frozenset(
    "a action actions active area article articles b bar big block body bottom box btn button buttons col column container content desktop entry fixed floating form frame full group guest holder icon icons inline inner item items js layer layout leave left link links list main member mobile mod module new news outer page pane panel post posts primary reader readers region right row secondary section set side site slot small stack sticky stories story tab text title toggle tools top unit user users view visitor visitors wp wrap wrapper your zone".split()
)
#: Those of MARKS that mark what readers write, which may well be longer than the article.
READERS = frozenset("comment comments commentlist disqus feedback replies reply respond reviews".split())
#: Words of class and id that mark the main text.
MAIN_MARKS = frozenset("article articlebody entry post postbody story storybody".split())
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our she so than that the their there they this to was we were which who will with would you
    aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sein sich sie sind über um und von vor war wie wird zu zum zur
    au aux avec ce ces cette comme dans de du elle en est et il ils je la le les leur lui mais même ne nous ou où par pas plus pour qui que sa se ses son sont sur un une vous
    al como con del el ella ellos entre era esta este hay las lo los muy o para pero por porque sin sobre su sus también todo una y ya""".split()
)
#: Scripts that set no space between words: two letters count as a word, and common particles as stop words.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
PARTICLES = re.compile("[的了是在和有不这這我他她也为為与與及のはにをたがでてとしるもな]|ที่|และ|ของ|เป็น|ใน")
SENTENCE_END = re.compile("[.!?…。！？।؟]")
SHORT, LONG = 10, 30  # words
MENU = 3  # blocks of links in a row
LINKS = 0.4  # of a block's characters
FRAME = 0.6  # of a page's text
STOPS_LOW, STOPS_HIGH = 0.15, 0.3  # of a block's words
GOOD, BAD, UNSURE = 1, -1, 0


@dataclass
class Element:
    tag: str
    index: int
    marked: bool = False  # by its tag, role, class or id not main text
    soft: bool = False  # by class or id alone: void if it turns out to hold the article, or most of the page
    weak: bool = False  # by a part of a name only: void if the text speaks against it
    readers: bool = False
    main: bool = False
    hidden: bool = False


@dataclass
class Block:
    path: tuple[Element, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    text: str = ""
    label: int = UNSURE
    barred: bool = False
    words: int = 0
    links: float = 0.0
    stops: float = 0.0

    def measure(self) -> None:
        words = self.text.split()
        letters = len(UNSPACED.findall(self.text))
        self.words = len(words) + letters // 2
        self.links = self.linked / max(1, len("".join(words)))
        particles = len(PARTICLES.findall(self.text)) if letters else 0
        self.stops = (sum(w.strip(".,;:!?()[]\"'*#$%&|-").lower() in STOP_WORDS for w in words) + particles) / max(1, self.words)


def _names(attributes: dict[str, str]) -> list[list[str]]:
    """The words of each class and of the id: cut at signs and at capitals; then each name whole."""
    out = []
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        out.append([w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()) if w and not w.isdigit()])
        out.append([name.lower().replace("-", "").replace("_", "")])
    return out


def _element(tag: str, raw: str, index: int, inside_main: bool) -> Element:
    attributes = {}
    if raw:
        for m in ATTRIBUTE.finditer(raw):
            attributes.setdefault((m[1] or m[5]).lower(), html.unescape(next((v for v in (m[2], m[3], m[4]) if v is not None), "")))
    e = Element(tag, index)
    role = attributes.get("role", "").lower()
    names = _names(attributes) if "class" in attributes or "id" in attributes else []
    marks = MARKS - {"header"} if inside_main else MARKS
    e.hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")))
    named = [n for n in names if not marks.isdisjoint(n)] if tag not in ("html", "body", "main") else []
    e.soft = any(marks.issuperset(w for w in n if w not in PLAIN) for n in named)
    e.weak = bool(named) and not e.soft
    e.readers = e.soft and any(not READERS.isdisjoint(n) for n in named)
    e.marked = e.soft or tag in OUTSIDE or role in ROLES or tag == "header" and not inside_main
    e.main = not e.marked and (tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody" or any(not MAIN_MARKS.isdisjoint(n) for n in names) and not e.weak and tag in ("div", "section", "td"))
    return e


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page in order, each with the elements around it. Unclosed elements, comments and tags end with the page."""
    stack: list[Element] = []
    out: list[Block] = []
    now, at, count, links, breaks = Block(()), 0, 0, 0, 0  # links: how many of the open elements are links

    def end() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                out.append(now)
        now = Block(tuple(stack), heading=bool(stack) and stack[-1].tag in HEADINGS)

    def say(text: str) -> None:
        nonlocal breaks
        text = html.unescape(text)
        if text:
            now.parts.append(text)
            if not text.isspace():
                breaks = 0
            if links:
                now.linked += len("".join(text.split()))

    def drop(k: int) -> None:
        nonlocal links
        links -= sum(e.tag == "a" for e in stack[k:])
        del stack[k:]

    while at < len(page):
        to = page.find("<", at)
        if to < 0:
            say(page[at:])
            break
        if to > at:
            say(page[at:to])
        after = page[to + 1 : to + 2]
        if page.startswith("<!--", to):
            stop = page.find("-->", to + 4)
            at = len(page) if stop < 0 else stop + 3
            continue
        if after in ("!", "?") or after == "/" and not page[to + 2 : to + 3].isalpha():
            stop = page.find(">", to)
            at = len(page) if stop < 0 else stop + 1
            continue
        if not (after.isascii() and after.isalpha()) and after != "/":
            say("<")
            at = to + 1
            continue
        m = TAG.match(page, to)
        if not m:  # no end: the page was cut inside a tag
            break
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                end()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    drop(k)
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS:
                    break  # an inline end tag closes no block
            if tag in BLOCKS:
                now = Block(tuple(stack), heading=bool(stack) and stack[-1].tag in HEADINGS)
            continue
        if tag in SILENT:
            if not m[3].endswith("/"):
                stop = SILENT_END[tag].search(page, at)
                close = page.find(">", stop.start()) if stop else -1
                if close >= 0 or tag in RAW:
                    at = len(page) if close < 0 else close + 1
            continue
        if tag == "br":
            now.parts.append(" ")
            breaks += 1
            if breaks > 1:
                end()
            continue
        if tag in VOID:
            if tag == "hr":
                end()
            continue
        if tag == "a":
            # a link ends where the next begins, unless a block stands between; one without an address is a mark in the text
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == "a" or stack[k].tag in BLOCKS), -1)
            if k >= 0 and stack[k].tag == "a":
                drop(k)
            if not re.search(r"\bhref\b", m[3], re.IGNORECASE):
                continue
        if tag in BLOCKS:
            # a paragraph, item, cell or row ends where the next begins
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p" or stack[k].tag in ends:
                    drop(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "div", "section", "article", "select") or stack[k].tag in BLOCKS and not ends:
                    break
        e = _element(tag, m[3], count, any(s.main for s in stack))
        count += 1
        if tag in BLOCKS or e.marked or e.main or e.hidden:
            stack.append(e)
            end()
        elif not m[3].endswith("/"):
            stack.append(e)
            links += tag == "a"
    end()
    return out


def _first_pass(every: list[Block]) -> None:
    """Decide what a block's surroundings, links, length and stop words decide."""
    holds = set()  # elements that hold an article
    for b in every:
        for k, e in enumerate(b.path):
            if e.main and e.tag in ("article", "main") and not e.soft:
                holds.update(x.index for x in b.path[:k])
    # an element marked by a name alone, such as header-wrap, that holds most of what is not barred otherwise, is the page's frame
    size, total = Counter(), 0
    for b in every:
        if not any(e.hidden or e.marked and not e.soft or e.readers for e in b.path):
            total += len(b.text)
            size.update({e.index: len(b.text) for e in b.path if e.soft})
    holds.update(i for i, n in size.items() if n > FRAME * total)
    for b in every:
        b.measure()
        b.barred = any(e.hidden or e.marked and not (e.soft and not e.readers and e.tag not in OUTSIDE and e.index in holds) for e in b.path)
    texts = [b for b in every if not b.barred and b.links <= LINKS]
    # a language whose stop words are not known shows in long blocks that hold few: there, length, links and the ends of sentences decide
    known = not any(b.words >= LONG for b in texts) or any(b.words >= SHORT and b.stops >= STOPS_LOW for b in texts)
    speaks = lambda b: b.words >= SHORT and b.stops >= STOPS_LOW or b.words >= LONG and not known or b.words >= 2 * LONG and not b.links
    kept = {e.index for b in texts if speaks(b) for e in b.path}
    for b in every:
        b.barred = b.barred or any(e.weak and e.index not in kept for e in b.path)
    has_main = any(not b.barred and any(e.main for e in b.path) for b in every)
    for i, b in enumerate(every):
        inside = any(e.main for e in b.path)
        if b.barred or has_main and not inside:
            b.label = BAD
        elif b.links > LINKS:
            # one link or two in an article are part of it, more in a row are a menu
            b.label = UNSURE if inside and not _in_menu(every, i) else BAD
        elif b.text.startswith(("©", "(c) ", "Copyright ")) and not has_main:
            b.label = BAD
        elif b.words >= LONG or speaks(b) or not known and b.words >= SHORT and SENTENCE_END.search(b.text):
            b.label = GOOD if has_main or speaks(b) or not known else UNSURE
        elif b.words >= SHORT and has_main:
            b.label = GOOD


def _in_menu(every: list[Block], i: int) -> bool:
    first = last = i
    while first and every[first - 1].links > LINKS and not every[first - 1].barred:
        first -= 1
    while last + 1 < len(every) and every[last + 1].links > LINKS and not every[last + 1].barred and last - first < MENU:
        last += 1
    return last - first + 1 >= MENU


def _second_pass(every: list[Block]) -> None:
    """Blocks still open take the label of the nearest decided block; of two as near, the one in the same surroundings, then good.

    A heading takes after what follows it. In a main element, an open block beside a good one of
    that element is good. In a page whose main element has no decided block of its own, and in a
    page without any good block, all open blocks are the main text.
    """
    labels = [b.label for b in every]
    within = any(e.main for b in every if not b.barred for e in b.path)
    told = [0 if b.barred and within else b.label for b in every]  # what is barred by name says nothing about an article around it
    home = [next((e.index for e in reversed(b.path) if e.main), -1) for b in every]
    settled = {h for h, x in zip(home, labels, strict=True) if x == GOOD}
    before, last = [], None
    for i, x in enumerate(told):
        before.append(last)
        last = i if x else last
    after, last = [None] * len(every), None
    for i in range(len(every) - 1, -1, -1):
        after[i] = last
        last = i if told[i] else last
    for i, b in enumerate(every):
        if labels[i]:
            continue
        if home[i] >= 0 and home[i] not in settled or not settled:
            b.label = GOOD
            continue
        if home[i] >= 0 and not b.heading and any(j is not None and labels[j] == GOOD and home[j] == home[i] for j in (before[i], after[i])):
            b.label = GOOD
            continue
        near = [(j - i if b.heading and j is after[i] and j > i and labels[j] == GOOD and j - i <= 2 else 2 * abs(j - i) + (home[j] != home[i]) * 1000 * (home[i] >= 0), -labels[j], labels[j]) for j in (before[i], after[i]) if j is not None]
        b.label = min(near)[2] if near else GOOD


def main_text(page: str | None) -> str:
    """The article of a page as text: blocks joined by two line ends, each with single spaces. Null or empty: empty."""
    every = blocks(page or "")
    _first_pass(every)
    _second_pass(every)
    return "\n\n".join(b.text for b in every if b.label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``; n_chars counts code points.

    A page is read whole and by itself, so nothing is shuffled. Nulls: null html is an
    empty page with an empty text; ids and urls may be null or repeat and are passed on. Other
    columns are left out. An empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = dict(plain.dtypes)["page_id"]
    return plain.mapInArrow(rows, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
