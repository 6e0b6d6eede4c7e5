"""Main text of web pages by nearest-URL page differencing.

Each page is cut into text lines (its blocks, in page order), every line with
the kind of place it stands in. Pages are paired with the neighbours by URL
path on the same host, the nearest on each side whose lines differ; the lines
of a pair are aligned by longest common subsequence, and lines that a page
shares with a neighbour are template and go.

Differencing alone cannot give the article: menus, adverts and footers may
differ from page to page, and articles may be copies of each other. So two
rules go with it. Lines in places that the markup itself names as no part of
the article (navigation, header, footer, sidebar, forms, notices, adverts,
comments) go in any case, and where the markup names the article, its own
lines stay in any case. A name (class, id, role) is weaker evidence than an
element: an article inside a wrapper dropped by its name is taken if the page
names no other. Differencing decides everywhere else. Among those
lines a pair of pages that shares most of its long lines is taken for two
copies of one article, and the shared long lines stay; without long lines a
pair that shares nine tenths of its characters is, and all its lines stay but
those that the other neighbour shares too.

Pages may be long: reading one is linear in its length, and the alignment
takes memory in proportion to the lines.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafsift.llm.common import only, staged
from leafsift.llm.language_id import host_of

#: Comments, declarations, elements whose content is no running text, and tags. What is never closed reaches to the end.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<head\b[^>]*+>.*?(?:</head\s*>|(?=<body\b)|\Z)"
    r"|<(script|style|template|noscript|svg|math|iframe|object|select|textarea|title|button)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[A-Za-z][^>]*+(?:>|\Z)", re.I | re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that can hold a region of the page; others are not tracked unless their names mark them.
REGIONS = frozenset("article aside details dialog div dl fieldset figure footer form header li main menu nav ol section table td ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Elements, and words in class, id and role, of what is no part of an article.
ASIDE_TAGS = frozenset("nav aside footer form menu dialog".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments disqus respond replies pagination pager "
    "widget toolbar search skip".split())
HEAD_NAMES = frozenset("header masthead topbar".split())
#: Names of what may hold articles of its own, none of them the page's.
FOREIGN_NAMES = frozenset("related recommended comment comments disqus respond replies".split())
#: A name that begins or ends so tells how a wrapper looks, not what it is: has-sidebar, search-page.
LOOK_BEGINS = frozenset("has with without no is".split())
LOOK_ENDS = frozenset("page layout".split())

#: Where a line stands; a wrapper is dropped by its name alone, and an article inside one is wrapped.
DROPPED, ARTICLE, ELSEWHERE, WRAPPER, WRAPPED = 0, 1, 2, 3, 4
LONG_WORDS = 20
COPY_SHARE = 0.9
#: Bits of an alignment table that is held at once; larger ones are divided.
TABLE_BITS = 1 << 24
#: A line at more places than this keeps its row of bits.
MANY_PLACES = 64


def _names(attributes: str) -> set[str]:
    found = set()
    for groups in NAMES.findall(attributes):
        for name in "".join(groups).split():
            parts = [w.lower() for w in PARTS.findall(name)]
            if not (len(parts) > 1 and (parts[0] in LOOK_BEGINS or parts[-1] in LOOK_ENDS)):
                found.update(parts)
    return found


def page_lines(source: str) -> list[tuple[str, int, bool]]:
    """The text lines of a page in order: text, place, and whether the line is a paragraph or heading."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, str]] = []  # open elements: tag, place, tag of the innermost element dropped for its own sake
    open_tags: Counter[str] = Counter()
    place, prose, at = ELSEWHERE, False, 0

    def end_line() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append((text, place, prose))

    def leave() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    for m in MARKUP.finditer(source):
        if m.start() > at:
            parts.append(source[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        block = tag in BLOCKS
        if block:
            end_line()
        if m[2]:
            if block:
                prose = False
            if open_tags[tag]:
                while leave() != tag:
                    pass
            else:
                continue
        elif tag not in VOID:
            while block and stack and stack[-1][0] not in REGIONS and stack[-1][0] not in ("body", "html"):
                leave()  # a paragraph or inline element that was never closed
            if block:
                prose = tag in PROSE
            here, within = stack[-1][1:] if stack else (ELSEWHERE, "")
            names = _names(m[4]) if m[4] and tag not in ("html", "body") else set()
            if tag in ("article", "main") and not names & ASIDE_NAMES:
                # Begins the article even in an unclosed header or menu, but not among comments or in a sidebar.
                if here in (WRAPPER, WRAPPED):
                    here = WRAPPED
                else:
                    here = ARTICLE if within in ("", "nav", "header", "menu", "form") else DROPPED
                within = within if here == DROPPED else ""
            elif (tag in ASIDE_TAGS or names & FOREIGN_NAMES or m[4] and HIDDEN.search(m[4])
                  or here not in (ARTICLE, WRAPPED) and tag == "header"):
                here, within = DROPPED, tag
            elif names & ASIDE_NAMES or here not in (ARTICLE, WRAPPED) and names & HEAD_NAMES:
                # Inside the article and what is dropped in any case, a name decides for good.
                here, within = (WRAPPER, "") if here in (ELSEWHERE, WRAPPER) else (DROPPED, within or tag)
            elif tag not in REGIONS:
                place = stack[-1][1] if stack else ELSEWHERE
                continue
            if not block:
                end_line()
            stack.append((tag, here, within))
            open_tags[tag] += 1
        else:
            continue
        if not block and parts:
            end_line()
        place = stack[-1][1] if stack else ELSEWHERE
    parts.append(source[at:])
    end_line()
    return lines


def candidate_lines(source: str) -> list[tuple[str, bool]]:
    """Lines that may be article text, each with whether differencing decides about it."""
    lines = page_lines(source)
    for named in (ARTICLE, WRAPPED):
        if any(place == named for _, place, _ in lines):
            return [(text, not prose) for text, place, prose in lines if place == named]
    return [(text, True) for text, place, _ in lines if place == ELSEWHERE]


def _masks(b: list[int]) -> Callable[[int], int]:
    """The places of a line in ``b`` as a row of bits; rows are kept only for lines at many places."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(b):
        places.setdefault(x, []).append(i)

    def row(at: list[int]) -> int:
        bits = np.zeros(len(b), np.uint8)
        bits[at] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    kept = {x: row(at) for x, at in places.items() if len(at) > MANY_PLACES}
    return lambda x: kept[x] if x in kept else sum(1 << i for i in places.get(x, ()))


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each beginning of ``a`` a row of bits: bit j is 0 where line j of ``b`` lengthens the common subsequence."""
    mask, full = _masks(b), (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & mask(x)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[int], b: list[int]) -> set[int]:
    """Places of ``a`` in a longest common subsequence; too large a table is divided at the middle of ``a``."""
    if not a or not b:
        return set()
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[:half - 1:-1], b[::-1])[::-1]))
        return _aligned(a[:half], b[:cut]) | {half + i for i in _aligned(a[half:], b[cut:])}
    rows = list(_rows(a, b))
    found, i, j = set(), len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                found.add(i)
                j -= 1
    return found


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places of ``a`` in a longest common subsequence of ``a`` and ``b``.

    Equal beginnings and ends belong to it, and lines that only one side has
    do not; rows of bits align the rest.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middle = range(head, len(a) - tail)
    in_b, in_a = set(b[head:len(b) - tail]), {a[i] for i in middle}
    at = [i for i in middle if a[i] in in_b]
    inner = _aligned([a[i] for i in at], [x for x in b[head:len(b) - tail] if x in in_a])
    return {*range(head), *range(len(a) - tail, len(a)), *(at[i] for i in inner)}


def differenced(lines: list[tuple[str, bool]], own: list[int], neighbours: list[list[int]]) -> str:
    """The lines that stay, as one text. ``own`` and ``neighbours`` are the hashes of the pages' lines."""
    size = [len(text) for text, _ in lines]
    long = {i: size[i] for i, (text, _) in enumerate(lines) if text.count(" ") >= LONG_WORDS - 1}
    marked = not all(open_ for _, open_ in lines)  # the markup names the article
    gone: set[int] = set()
    for other in neighbours:
        if other == own:  # the page itself again tells nothing
            continue
        shared = common_lines(own, other)
        if 2 * sum(long.get(i, 0) for i in shared) > sum(long.values()):  # copies of one article
            shared = set() if marked else shared - long.keys()
        elif not long and sum(size[i] for i in shared) > COPY_SHARE * sum(size):
            shared = set()
        gone |= shared
    return "\n".join(text for i, (text, open_) in enumerate(lines) if not (open_ and i in gone))


def _hash(line: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def _cut(pages: DataFrame) -> DataFrame:
    """``page_id, url, key`` with the text of pages that need no neighbour, else the lines; and the lines' hashes."""
    fields = "page_id long, url string, key long, text string, lines array<struct<text:string,undecided:boolean>>, hashes array<long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, hashes = [], [], []
            for source in batch.column(3):
                own = candidate_lines(source.as_py() or "")
                hashes.append([_hash(text) for text, _ in own])
                need = any(undecided for _, undecided in own)
                texts.append(None if need else "\n".join(text for text, _ in own))
                lines.append([{"text": t, "undecided": u} for t, u in own] if need else None)
            kind = pa.list_(pa.struct([("text", pa.string()), ("undecided", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(texts, pa.string()), pa.array(lines, kind), pa.array(hashes, pa.list_(pa.int64()))],
                ["page_id", "url", "key", "text", "lines", "hashes"])

    rows = only(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), "url", F.xxhash64("page_id", "url", "html").alias("key"), "html")
    return rows.mapInArrow(cut, fields)


def _neighbours(cut: DataFrame) -> DataFrame:
    """``key, before, after``: for each page the keys of the nearest pages by path on its host whose lines differ.

    One total order by host, path and page is dealt by range, so a large host
    spreads over many tasks. Pages in a row with equal lines form a run; a page
    looks past its run. For runs that reach the border of a range the answer
    comes from a table of the ranges: two keys on each side, one row a range.
    """
    path = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "")
    place = ["host", "path", "page_id", "key"]
    placed = staged(
        cut.filter("size(hashes) > 0").select(host_of(F.col("url")).alias("host"), path.alias("path"), "page_id", "key", F.xxhash64("hashes").alias("lines"))
        .filter("host <> ''").distinct().repartitionByRange(*place).withColumn("range", F.spark_partition_id()), "page-order")
    run = F.struct("host", "lines", "key")
    differ = lambda a, b: (a["host"] != b["host"]) | (a["lines"] != b["lines"])

    def looking_back(columns: list, name: str) -> DataFrame:
        """Per page the last page before its run in its range, null if its run begins the range."""
        order = Window.partitionBy("range").orderBy(*columns)
        last = placed.withColumn("_last", F.lag(run).over(order))
        fresh = F.when(F.col("_last").isNotNull() & differ(F.col("_last"), run), F.col("_last"))
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return last.select("range", *place, "lines", F.last(fresh, ignorenulls=True).over(upto).alias(name))

    def carried(side: DataFrame, name: str, forwards: bool) -> DataFrame:
        """Per range the page that its first run (seen in this direction) looks back to, in the ranges before."""
        where = F.struct(*place)
        first, last = (F.min_by, F.max_by) if forwards else (F.max_by, F.min_by)
        ends = side.groupBy("range").agg(first(run, where).alias("first"), last(run, where).alias("last"), last(name, where).alias("second"))
        order = Window.orderBy("range" if forwards else F.desc("range"))  # one row per range
        ends = ends.select("range", "first", F.lag("last").over(order).alias("l"), F.lag("second").over(order).alias("s"))
        # The range before may hold nothing but the same run: then what that one looks back to.
        found = F.when(F.col("l").isNotNull() & differ(F.col("l"), F.col("first")), F.col("l")).otherwise(F.col("s"))
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return ends.select("range", F.last(found, ignorenulls=True).over(upto).alias("_border"))

    sides = []
    for name, forwards in (("before", True), ("after", False)):
        side = looking_back([*place] if forwards else [F.desc(c) for c in place], name)
        side = side.join(carried(side, name, forwards), "range")
        seen = F.coalesce(name, "_border")
        sides.append(side.select("key", F.when(seen["host"] == F.col("host"), seen["key"]).alias(name)))
    return sides[0].join(sides[1], "key")


def _with_neighbours(open_: DataFrame, cut: DataFrame) -> DataFrame:
    """``open_`` with the line hashes of the pages' neighbours. Copies share neighbours, so the join is salted by page."""
    pages = open_.join(_neighbours(cut), "key", "left").withColumn("_salt", F.pmod("key", F.lit(16)))
    hashes = cut.groupBy("key").agg(F.first("hashes").alias("_hashes"))
    for name in ("before", "after"):
        asked = pages.select(F.col(name).alias("_key"), "_salt").filter("_key IS NOT NULL").distinct()
        answer = asked.join(hashes, F.col("_key") == hashes["key"]).select(F.col("_key").alias(name), "_salt", F.col("_hashes").alias(f"{name}_lines"))
        pages = pages.join(answer, [name, "_salt"], "left")
    return pages


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    Null and empty html gives an empty text. Pages without a host in their URL
    (or with a null one) have no neighbours and keep all undecided lines, as
    do single pages of a host. Repeated rows count once as neighbours and get
    the same text; an empty table gives no rows; further columns are left out.
    Pages of hundreds of thousands of lines are read whole.
    """
    cut = staged(_cut(pages), "page-lines")
    known = cut.filter(F.col("text").isNotNull()).select("page_id", "url", "text")
    open_ = _with_neighbours(cut.filter(F.col("text").isNull()), cut).select("page_id", "url", "lines", "hashes", "before_lines", "after_lines")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for lines, own, before, after in zip(*(batch.column(i) for i in (2, 3, 4, 5))):
                pairs = [(x["text"], x["undecided"]) for x in lines.as_py()]
                texts.append(differenced(pairs, own.as_py(), [n for n in (before.as_py(), after.as_py()) if n]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    text = known.unionByName(open_.mapInArrow(decide, "page_id long, url string, text string"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
