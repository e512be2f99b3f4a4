"""Main text of web pages: site templates found by counting subtrees, and structural rules.

A page is cut into blocks (headings, paragraphs, list items and so on). Elements that are never main
text (menus, headers, footers, sidebars, forms, scripts, adverts, notices, comments) go by their tag,
role, class or id. If the page has an ``article`` or ``main`` element, only what is inside counts.

What is left may still be boilerplate of the site. Every block element of the page, also one that the rules
above drop, is hashed as a subtree (tags, classes and text); Spark counts on how many different pages of a
host each subtree occurs, and subtrees that recur on a share of them are deleted. So a box that is in the
sidebar of most pages also goes where it is in the text. Pages with the same main text count once, so
copies of one article do not look like a template. Paragraphs and the like, and whole articles, are prose,
which several pages may share, so they need a larger share.

Defined results: a null html is the empty page and has the empty text; a null url is a host of its own;
repeated rows get the same text and count as one page; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.url_filter import with_host
from emberlog.session import stage

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead title tr ul option optgroup select".split()
)
# A start tag of the left closes an open element of the right.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
BARRIERS = frozenset("ul ol dl table article main section div body html td th blockquote".split())
# Elements that are never main text.
DROPPED = frozenset(
    "head script style noscript template nav header footer aside form button select option textarea input iframe object "
    "embed svg canvas audio video map menu dialog search noembed noframes datalist".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split()
)
# Words of class and id attributes of such elements.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices "
    "alert popup modal newsletter subscribe subscription signup login share sharing social related recommended comment "
    "comments discussion replies respond disqus pagination pager toolbar skip".split()
)
MAIN = frozenset(["article", "main"])
PROSE = MAIN | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody".split())
# Never counted: pages with an equal body have the same main text, so they count as one page.
WHOLE = frozenset(["body", "html", "head"])
# This bit of the hash of a subtree says whether it is prose.
PROSE_BIT = 1

# A comment or declaration as a whole, or the beginning of a tag.
OPENING = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)(?=[A-Za-z])", re.S)
NAME_END = re.compile(r"[\s/>]")
# Where the attributes of a tag end, or a quoted value begins.
STOP = re.compile(r"[>\"']")
NAME_ATTRIBUTES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class _Tags:
    """Where tags end, found in time proportional to the page however many tags never end.

    A tag ends at the first > that is not in quotes. Every search is remembered: the next name end and
    the next stop serve all places before them, and a stop from which no tag ends is not tried again.
    """

    def __init__(self, source: str):
        self.source = source
        self.names = (0, -1)  # no name ends in source[a:b]; at b one does
        self.stops = (0, -1)
        self.endless: set[int] = set()

    def _next(self, pattern: re.Pattern, known: tuple[int, int], at: int) -> tuple[int, int]:
        if known[0] <= at <= known[1]:
            return known
        m = pattern.search(self.source, at)
        return at, m.start() if m else len(self.source)

    def end(self, start: int) -> tuple[int, int] | None:
        """(end of the name, place of the >) of the tag whose name starts here; none if it never ends."""
        size = len(self.source)
        self.names = self._next(NAME_END, self.names, start)
        name_end = self.names[1]
        if name_end == size:
            return None
        self.stops = self._next(STOP, self.stops, name_end)
        at, tried = self.stops[1], []
        while at < size and at not in self.endless:
            if self.source[at] == ">":
                return name_end, at
            tried.append(at)
            close = self.source.find(self.source[at], at + 1)
            if close < 0:
                break
            m = STOP.search(self.source, close + 1)
            at = m.start() if m else size
        self.endless.update(tried)
        return None


@dataclass
class _Element:
    tag: str
    dropped: bool
    own: bool  # dropped by its own tag or attributes, not only by those of an element around it
    main: bool
    key: str
    first: int  # number of the first block inside
    parts: list[str] = field(default_factory=list)
    words: bool = False  # has text inside


@dataclass
class Block:
    """A block of text; ``number`` counts all blocks of the page."""

    text: str
    main: bool
    number: int = 0


def _names(attributes: str) -> tuple[str, bool]:
    """The class and id of an element, and whether it is to be dropped for them or its role."""
    key, dropped = [], bool(HIDDEN.search(attributes))
    for m in NAME_ATTRIBUTES.finditer(attributes):
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            dropped |= value.strip() in DROPPED_ROLES
        else:
            key.append(value)
            dropped |= not DROPPED_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value))
    return " ".join(key), dropped


class _Page:
    """Builds the blocks of one page from its tags, closing elements the way browsers do."""

    def __init__(self):
        self.open = [_Element("#page", False, False, False, "", 0)]
        self.opened: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.buffer: list[str] = []
        self.seen: dict[int, int] = {}  # the hashes of all subtrees, of dropped ones too, numbered
        self.runs: list[tuple[int, int, int]] = []  # subtrees that may be templates: number, first block, block after
        self.has_main = False

    def text(self, raw: str) -> None:
        if not raw:
            return
        above = self.open[-1]
        if not above.dropped:
            self.buffer.append(raw)
        elif above.tag not in RAW and (text := " ".join(html.unescape(raw).split())):
            above.parts.append(text)
            above.words = True

    def flush(self) -> None:
        """Ends the current block."""
        if self.buffer:
            text = " ".join(html.unescape("".join(self.buffer)).split())
            self.buffer.clear()
            if text:
                self.blocks.append(Block(text, self.open[-1].main, len(self.blocks)))
                self.open[-1].parts.append(text)
                self.open[-1].words = True

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag != "p":
                self._close_until(CLOSES.get(tag, frozenset()))
            if self.opened["p"]:
                self._pop("p")
        elif tag == "br":
            self.text(" ")
        if tag in VOID:
            return
        above = self.open[-1]
        key, dropped = _names(attributes) if attributes else ("", False)
        # The page itself is never dropped for a class of its body.
        own = tag in DROPPED or (dropped and tag not in ("html", "body", *MAIN))
        dropped = above.dropped or own
        main = not dropped and (above.main or tag in MAIN)
        self.has_main |= main
        self.open.append(_Element(tag, dropped, own, main, key, len(self.blocks)))
        self.opened[tag] += 1

    def _close_until(self, tags: frozenset[str]) -> None:
        """Closes the innermost open element of ``tags``, unless a barrier is open inside it."""
        if not any(self.opened[tag] for tag in tags):
            return
        for element in reversed(self.open):
            if element.tag in tags:
                self._pop(element.tag)
                return
            if element.tag in BARRIERS:
                return

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.opened[tag]:
            self._pop(tag)

    def _pop(self, tag: str) -> None:
        """Closes the innermost element with the tag and all that is open inside it.

        Formatting elements that a block leaves open do not matter for the text, so they are closed.
        """
        while len(self.open) > 1:
            if self.open[-1].tag in BLOCKS:
                self.flush()
            element = self.open.pop()
            self.opened[element.tag] -= 1
            self._mark(element)
            if element.tag == tag:
                return

    def _mark(self, element: _Element) -> None:
        """Hashes a closed subtree from its text and the hashes of its children, and notes which blocks it has.

        What the rules drop is no part of the subtree around it, so adverts do not make equal boxes differ.
        """
        content = "\n".join([f"{element.tag} {element.key}", *element.parts])
        print_ = xxhash.xxh64_intdigest(content.encode("utf-8", "surrogatepass")) - 2**63
        print_ = print_ | PROSE_BIT if element.tag in PROSE else print_ & ~PROSE_BIT
        if not element.own:
            self.open[-1].parts.append(str(print_))
            self.open[-1].words |= element.words
        if element.tag not in BLOCKS or element.tag in WHOLE or not element.words:
            return
        number = self.seen.setdefault(print_, len(self.seen))
        if not element.dropped and element.first < len(self.blocks):
            self.runs.append((number, element.first, len(self.blocks)))

    def close(self) -> list[Block]:
        self.flush()
        while len(self.open) > 1:
            self._pop(self.open[-1].tag)
        return [b for b in self.blocks if b.main] if self.has_main else self.blocks


def blocks_of(source: str) -> list[Block]:
    """The blocks of a page that may be main text, in page order."""
    return parse_page(source)[0]


def parse_page(source: str) -> tuple[list[Block], list[int], list[tuple[int, int, int]]]:
    """The blocks of a page that may be main text, the hashes of all its subtrees by number, and the runs
    of blocks of those that may be templates."""
    page, tags, at, size = _Page(), _Tags(source), 0, len(source)
    looked = 0
    while at < size:
        m = OPENING.search(source, looked)
        if m is None:
            page.text(source[at:])
            break
        if m[1] is None:  # a comment or declaration
            page.text(source[at : m.start()])
            at = looked = m.end()
            continue
        place = tags.end(m.end())
        if place is None:  # never ends, so its < is text
            looked = m.end()
            continue
        page.text(source[at : m.start()])
        tag, attributes = source[m.end() : place[0]].lower(), source[place[0] : place[1]]
        at = looked = place[1] + 1
        if m[1]:
            page.end(tag)
            continue
        page.start(tag, attributes)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            inside = source[at : end.start()] if end else source[at:]
            page.text(inside)
            at = looked = end.end() if end else size
            page.end(tag)
    return page.close(), list(page.seen), page.runs


BLOCK_ROWS = (
    "page_id long, url string, host string, page_print long, seen array<long>, "
    "blocks array<struct<text: string, number: int>>, runs array<struct<number: int, low: int, high: int>>"
)


def _parsed(pages: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("number", pa.int32())]))
        run = pa.list_(pa.struct([("number", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]))
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                blocks, prints, subtrees, runs = [], [], [], []
                for source in part.column(3):
                    found, seen, within = parse_page(source.as_py() or "")
                    subtrees.append(seen)
                    runs.append([{"number": n, "low": a, "high": b} for n, a, b in within])
                    blocks.append([{"text": b.text, "number": b.number} for b in found])
                    prints.append(xxhash.xxh64_intdigest("\n".join(b.text for b in found).encode("utf-8", "surrogatepass")) - 2**63)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array(prints, pa.int64()),
                        pa.array(subtrees, pa.list_(pa.int64())),
                        pa.array(blocks, kind),
                        pa.array(runs, run),
                    ],
                    names=["page_id", "url", "host", "page_print", "seen", "blocks", "runs"],
                )

    return pages.select("page_id", "url", "host", "html").mapInArrow(parse, BLOCK_ROWS)


def main_text(
    pages: DataFrame,
    least_pages: int = 10,
    least_share: float = 0.1,
    few_pages: int = 5,
    prose_pages: int = 20,
    prose_share: float = 0.5,
    id_column: str = "page_id",
    url: str = "url",
    source: str = "html",
) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A subtree is a template when it occurs on ``least_share`` of the different pages of its host, whatever
    their number, and on ``least_pages`` at least; on hosts of fewer than twice as many pages half of the pages
    are enough, but never fewer than ``few_pages``. For prose (see PROSE) the share is ``prose_share`` and
    the least number ``prose_pages``.
    """
    slim = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html")
    )
    parsed = stage(_parsed(with_host(slim)), "page-blocks")
    marks = parsed.select("host", "page_print", F.explode("seen").alias("mark"))
    # Most subtrees are on too few rows to be on enough pages, so their pages need no counting.
    often = marks.groupBy("host", "mark").agg(F.count("*").alias("_rows")).where(F.col("_rows") >= min(few_pages, prose_pages))
    often = stage(often.select("host", "mark"), "page-recurring")
    seen = marks.join(often, ["host", "mark"]).distinct()
    known = parsed.select("host", "page_print").distinct().groupBy("host").agg(F.count("*").alias("_pages"))
    counts = seen.groupBy("host", "mark").agg(F.count("*").alias("_on"))
    few = F.greatest(F.lit(few_pages), F.least(F.lit(least_pages), F.ceil(F.col("_pages") / 2)))
    needed = F.when(
        F.col("mark").bitwiseAND(PROSE_BIT) != 0, F.greatest(F.lit(prose_pages), F.ceil(F.col("_pages") * prose_share))
    ).otherwise(F.greatest(few, F.ceil(F.col("_pages") * least_share)))
    templates = stage(counts.join(known, "host").where(F.col("_on") >= needed).select("host", "mark"), "page-templates")
    # Which templates a page has: by its print, so that copies share the answer.
    # Written, so that its size is known and few templates do not make the texts travel.
    of_page = marks.join(templates, ["host", "mark"]).groupBy("host", "page_print").agg(F.collect_set("mark").alias("gone"))
    rows = parsed.join(stage(of_page, "pages-with-templates"), ["host", "page_print"], "left")
    cut = F.filter("runs", lambda r: F.array_contains("gone", F.element_at("seen", r["number"] + 1)))
    rows = rows.withColumn("cut", F.when(F.col("gone").isNotNull(), cut))
    outside = lambda b: ~F.exists("cut", lambda r: (r["low"] <= b["number"]) & (b["number"] < r["high"]))
    kept = F.when(F.col("cut").isNull(), F.col("blocks")).otherwise(F.filter("blocks", outside))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
